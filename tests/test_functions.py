import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmerge.functions import kmers, nt, phred, seqid, tables


def test_quality_tables():
    assert phred.QUAL_NN == -1.38629
    assert phred.QUAL_SCORE[:6].tolist() == [-2, -1.58147, -0.996843, -0.695524, -0.507676, -0.38013]
    assert phred.QUAL_SCORE[[30, 40, 46]].tolist() == [-0.0010005, -0.000100005, -2.51192e-05]
    assert phred.QUAL_SCORE_ERR[[0, 1, 2, 40, 46]].tolist() == [0, -0.230259, -0.460517, -9.21034, -10.5919]


@pytest.mark.parametrize(
    "name, values",
    [
        ("MATCH_BAYES", [-1.31343, -0.996886, -0.996886, -0.000200007, -5.02381e-05]),
        ("MISMATCH_BAYES", [-1.41181, -1.5591, -1.5591, -9.61587, -10.9974]),
        ("MATCH_PEAR", [-0.205179, -0.345751, -0.345751, -0.251343, -0.251322]),
        ("MISMATCH_PEAR", [-1.03765, -1.55902, -1.55902, -9.61583, -10.9974]),
        ("MISMATCH_RDP_ASSEMBLED", [-1.14416, -0.000125161, -0.000125161, -0.693181, -0.693156]),
        ("MATCH_UPARSE", [-708.396, -0.000170993, -0.000170993, -1.0002e-08, -6.30989e-10]),
        ("MISMATCH_UPARSE", [-708.396, -708.396, -0.40569, -1.09875, -1.09865]),
    ],
)
def test_matrices(name, values):
    t = getattr(tables, name)
    assert [t[2, 2], t[2, 40], t[40, 2], t[40, 40], t[46, 46]] == values


def test_requantise_rules():
    q = phred.QUAL_SCORE
    assert phred.requantise_array(np.array([-3.0, -2.0, q[46], -1e-9, q[5], q[45]])).tolist() == [1, 1, 45, 45, 5, 45]
    between = [(q[i] + q[i + 1]) / 2 for i in range(45)]
    assert phred.requantise_array(np.array(between)).tolist() == [i if i % 3 == 0 else i + 1 for i in range(45)]


def test_requantise_column_equals_array(spark):
    p = [-3.0, -2.0, *(phred.QUAL_SCORE[1:] + 0).tolist(), *np.linspace(-2.5, -1e-6, 200).tolist()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double").orderBy("i").select(phred.requantise(F.col("p"))).collect()]
    assert got == phred.requantise_array(np.array(p)).tolist()


def test_index_of_caps(spark):
    rows = spark.createDataFrame([("!",), ("I",), ("O",), ("P",), ("~",)], "c string")
    assert [r[0] for r in rows.select(phred.index_of(F.col("c"))).collect()] == [0, 40, 46, 13, 13]
    assert [r[0] for r in rows.select(phred.index_of(F.col("c"), 64)).collect()] == [0, 9, 15, 16, -18]
    assert phred.index_table(33)[[ord(c) for c in "!IOP~"]].tolist() == [0, 40, 46, 13, 13]


def test_log1mexp(spark):
    one = spark.range(1).select(phred.log1mexp(F.lit(1.0)), phred.log1mexp(F.lit(0.5)), phred.log1mexp(F.lit(-0.5))).first()
    assert one[0] == pytest.approx(math.log(1 - math.exp(-1)))
    assert one[1] == pytest.approx(math.log(1 - math.exp(-0.5)))
    assert math.isnan(one[2])


def test_nucleotides(spark):
    assert [int(nt.FROM_ASCII[ord(c)]) for c in "ACGTUNX.-4aE"] == [1, 2, 4, 8, 8, 15, 15, 15, 3, 8, 1, 0]
    assert [int(nt.FROM_ASCII_COMPLEMENT[ord(c)]) for c in "ACGTRYVB"] == [8, 4, 2, 1, 10, 5, 14, 7]
    row = spark.range(1).select(nt.reverse_complement(F.lit("aCGTN")), nt.to_ascii(F.lit(15)), nt.to_ascii(F.lit(99)), nt.is_degenerate(F.lit(0)), nt.matches(F.lit(15), F.lit(4)), nt.count_degenerate(F.lit("ACNRu"))).first()
    assert list(row) == ["NACGT", "N", "N", True, True, 2]


CASES = [
    ("M01271:10:000000000-A3WGH:1:1101:18786:6175 1:N:0:1", "present", 1, "1.7+", "M01271:10:000000000-A3WGH:1:1101:18786:6175:1"),
    ("ILLUMINA-BE9C3F:29:FC:3:1:2462:1120 1:N:0:GCTATA", "present", 1, "1.7+", "ILLUMINA-BE9C3F:29:FC:3:1:2462:1120:GCTATA"),
    ("M00958:47:000000000-A3GH7:1:1101:15028:1512 2:N:0:3", "present", 2, "1.7+", "M00958:47:000000000-A3GH7:1:1101:15028:1512:3"),
    ("1468:1:1:12675:1118#ATCACGA/1", "present", 1, "1.4", "1468:::1:1:12675:1118:ATCACGA"),
    ("1468:1:1:12675:1118#ATCACGA/2", "present", 2, "1.4", "1468:::1:1:12675:1118:ATCACGA"),
    ("MISEQ03:18:000000000-A1REG:1:1101:14774:1712#GATAGTGCCAC/1", "present", 1, "converted", "MISEQ03:18:000000000-A1REG:1:1101:14774:1712:GATAGTGCCAC"),
    ("SRR001666.1 x", "present", 1, "SRA", "SRR1666:::1:0:0:0:"),
    ("SRR001666.1", "present", 0, "unknown", None),
    ("ERR12.3 y", "absent", 1, "EBI", "ERR12:::3:0:0:0:"),
    ("1468:1:1:12675:1118/2", "present", 0, "unknown", None),
    ("1468:1:1:12675:1118/2", "optional", 2, "1.4", "1468:::1:1:12675:1118:"),
    ("1468:1:1:12675:1118#ATCACGA/1", "absent", 0, "unknown", None),
    ("1468:x:1:12675:1118#A/1", "present", 0, "unknown", None),
    ("1468::1:12675:1118#A/1", "present", 1, "1.4", "1468:::0:1:12675:1118:A"),
    (None, "present", 0, "unknown", None),
]


@pytest.mark.parametrize("header, tag, mate, form, text", CASES)
def test_headers(spark, header, tag, mate, form, text):
    r = spark.range(1).select(seqid.parse(F.lit(header).cast("string"), tag).alias("r")).select("r.mate", "r.format", F.when(F.col("r.id").isNotNull(), seqid.to_string(F.col("r.id")))).first()
    assert tuple(r) == (mate, form, text)


def test_kmers_skip_the_first_and_those_at_n(spark):
    seq = "ACGTACGTAC" + "N" + "ACGTACGTACG"
    got = [(r["posn"], r["kmer"]) for r in spark.range(1).select(F.explode(kmers.kmers(F.lit(seq))).alias("k")).select("k.*").collect()]
    code, ok = kmers.kmer_codes(nt.FROM_ASCII[np.frombuffer(seq.encode(), np.uint8)][None, :])
    assert [p for p, _ in got] == np.flatnonzero(ok[0]).tolist() == [8, 9, 19, 20, 21]
    assert got[0][1] == "CGTACGTA"
    assert code[0, 8] == int("".join({"A": "00", "C": "01", "G": "10", "T": "11"}[c] for c in "CGTACGTA"), 2)


def test_reaches_equals_requantise(spark):
    from readmerge.operators.filters import reaches

    p = [-3.0, -2.0, *phred.QUAL_SCORE[1:].tolist(), *np.linspace(-2.2, -1e-6, 300).tolist()]
    rows = spark.createDataFrame([(x,) for x in p], "p double")
    for v in (0, 1, 2, 3, 4, 5, 20, 45, 46):
        assert [r[0] for r in rows.select(reaches(F.col("p"), v)).collect()] == (phred.requantise_array(np.array(p)) >= v).tolist()


def test_identifiers_compare_field_by_field(spark):
    from readmerge.functions import seqid

    heads = ["M1:2:FC:1:5:10:20 1:N:0:AC", "M1:2:FC:1:5:9:20 1:N:0:AC", "M1:2:FC:1:5:10:20 2:N:0:AC", "M1:10:FC:1:5:10:20 1:N:0:AC", "bad"]
    ids = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "n int, h string").select("n", seqid.parse(F.col("h"))["id"].alias("i"))
    a, b = ids.alias("a"), ids.alias("b")
    got = {(r.x, r.y): (r.c, r.e) for r in a.join(b).select(F.col("a.n").alias("x"), F.col("b.n").alias("y"), seqid.compare(F.col("a.i"), F.col("b.i")).alias("c"), seqid.equal(F.col("a.i"), F.col("b.i")).alias("e")).collect()}
    assert got[0, 1] == (1, False) and got[1, 0] == (-1, False) and got[0, 2] == (0, True) and got[3, 0] == (-1, False) and got[0, 4] == (None, None)
    names = spark.range(7).select(seqid.format_name(F.col("id").cast("int"))).collect()
    assert [r[0] for r in names] == ["unknown", "SRA", "EBI", "1.4", "1.7+", "converted", "unknown"]


def test_key_values_and_log_lines(spark):
    from readmerge.functions import logs
    from readmerge.operators.filters import key_values

    assert key_values("a=1,b=x=y") == {"a": "1", "b": "x=y"} and key_values("") == {}
    for bad in ("a", "a=1,a=2", "=1"):
        with pytest.raises(ValueError):
            key_values(bad)
    codes = spark.createDataFrame([("BADID",), ("STAT",), ("?",)], "c string").select(logs.line(F.col("c")), logs.hint(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["ERR\tBADID", "STAT", "ERR\tUNKNOWN ERROR"] and codes[0][1] and codes[1][1] is None
