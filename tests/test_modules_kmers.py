"""Batch modules and their Column twins, k-mers of any length, places of overlaps."""

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import readmerge
from readmerge.functions import kmers, seqid
from readmerge.operators import diff, filters
from readmerge.operators.assemble import assemble, overlap_offsets
from readmerge.operators.config import AssemblerConfig
from readmerge.plans import sim


@pytest.fixture(scope="module")
def pairs(spark, data):
    df = sim.read_pairs(spark, data).where("ordinal between 1 and 400").select("ordinal", "id", "f_seq", "f_qual", "r_seq", "r_qual")
    odd = [(9001, None), (9002, "A"), (9003, "")]
    more = spark.createDataFrame(odd, "ordinal long, f_seq string").select("ordinal", F.lit(None).cast(df.schema["id"].dataType).alias("id"), "f_seq", *[F.lit(x).alias(c) for c, x in (("f_qual", "I"), ("r_seq", "AC"), ("r_qual", "II"))])
    return df.union(more).cache()


LONG = filters.batch_module("LONG", "check", ("sequence_length",), lambda b: b.column("sequence_length").to_numpy() <= 100)
TAG = filters.batch_module("tag", "precheck", ("id", "ordinal"), lambda b: pc.starts_with(pc.struct_field(b.column("id"), "tag"), "A"))


def outcome(df):
    return sorted(map(tuple, df.select("ordinal", "status", "reject_module", "sequence").collect()))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_batch_modules_equal_columns(pairs, order):
    """The same modules as batches and as Columns, in any order."""
    tag = filters.precheck("tag", F.col("id")["tag"].startswith("A"))
    long = filters.check("LONG", F.col("sequence_length") <= 100)
    short, few = filters.load("short:85"), filters.load("completely_miss_the_point:0")
    contains = filters.precheck("contains", F.contains("f_seq", F.lit("AC")))
    mixed = [(TAG, contains, short, LONG, few), (contains, TAG, LONG, few, short), (LONG, few, contains, TAG, short)][order]
    plain = tuple({"tag": tag, "LONG": long}.get(m.name, m) if m.batch else m for m in mixed)
    got, want = outcome(assemble(pairs, AssemblerConfig(modules=mixed))), outcome(assemble(pairs, AssemblerConfig(modules=plain)))
    assert got == want and len({r[2] for r in got}) > 4
    one, two = AssemblerConfig(modules=mixed), AssemblerConfig(modules=plain, min_overlap=30)
    three = AssemblerConfig(modules=plain)
    assert sorted(map(tuple, diff.diff(pairs, one, two).select("ordinal", "kind").collect())) == sorted(map(tuple, diff.diff(pairs, three, two).select("ordinal", "kind").collect()))


def test_batch_modules_see_only_open_rows(pairs):
    never = filters.batch_module("never", "precheck", ("f_seq",), lambda b: [False] * len(b))
    fails = filters.batch_module("fails", "check", ("logp",), lambda b: 1 / 0)
    assert {r[1] for r in outcome(assemble(pairs, AssemblerConfig(modules=(never, fails))))} == {"MODULE", "BADR"}
    short = filters.batch_module("short", "precheck", ("f_seq",), lambda b: [True])
    with pytest.raises(Exception, match="returned 1 values"):
        assemble(pairs, AssemblerConfig(modules=(short,))).count()
    with pytest.raises(ValueError, match="can read"):
        filters.batch_module("x", "precheck", ("sequence",), len)


def naive(seq, k, reverse):
    """The places and codes of k-mers, base by base."""
    out, bad, code = [], k, 0
    for p in range(len(seq) - 1, -1, -1) if reverse else range(len(seq)):
        code = (code << 2 | {"C": 1, "G": 2, "T": 3}.get(seq[p].upper(), 0)) & ((1 << 2 * k) - 1)
        if seq[p] in "Nn.":
            bad = k
        elif bad:
            bad -= 1
        else:
            out.append((p, code))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 16, 31])
@pytest.mark.parametrize("reverse", [False, True])
def test_kmers_of_any_length(spark, k, reverse):
    rng = np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGTacgtN."), p=[0.24] * 4 + [0.005] * 4 + [0.01] * 2, size=n)) for n in (0, 1, k, k + 1, 64, 64, 200, 1000)] + [None, "N" * 40, "ACGR" * 20]
    df = spark.createDataFrame(list(enumerate(seqs)), "ordinal long, s string").withColumn("kmer", F.lit("own"))
    got = sorted(map(tuple, kmers.kmer_table(df, "s", k, reverse=reverse).collect()))
    assert got == sorted((i, p, c) for i, s in enumerate(seqs) if s for p, c in naive(s, k, reverse))
    iterated = {tuple(r[:2]): r[2] for r in kmers.kmer_table(df, "s", k, reverse=reverse, as_iterated=True).collect()}
    step = 1 if reverse else -1
    assert iterated == {(i, p): c & 3 if (i, p + step) in iterated else c for i, p, c in got}


def test_kmers_of_a_complement(spark):
    df = spark.createDataFrame([(1, "AACGTT")], "ordinal long, s string")
    assert [r.kmer for r in kmers.kmer_table(df, "s", 2, complement=True).orderBy("posn").collect()] == [c for _, c in naive("TTGCAA", 2, False)]
    with pytest.raises(ValueError, match="between"):
        kmers.kmer_table(df, "s", 32)


def test_places_of_overlaps(pairs):
    rows = overlap_offsets(assemble(pairs, AssemblerConfig(forward_trim=5), keep_reads=True)).where("sequence is not null").collect()
    assert len(rows) > 200
    for r in rows:
        assert r.overlap_forward_offset == len(r.f_seq) - r.overlap and r.overlap_reverse_offset == len(r.r_seq) - r.overlap
        assert r.overlap_offset == r.overlap_forward_offset - 5


def test_introspection(spark):
    assert readmerge.__version__ and readmerge.API_VERSION == filters.API_VERSION and readmerge.MAX_LEN == 450
    assert readmerge.default_parallelism() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 15])
def test_id_sets_behind_a_bloom_filter(spark, pairs, most_bits, monkeypatch):
    ids = pairs.where("ordinal % 10 = 3").select("id").union(pairs.where("ordinal % 10 = 3").select("id")).union(pairs.where("id is null").select("id"))
    key = seqid.to_string(F.col("id"))
    told = filters.maybe_members(pairs, key, ids.select(key.alias("key")).where("key is not null").distinct(), most_bits)
    n = pairs.count()
    assert told.count() == n and told.where("_maybe").count() <= 0.13 * n
    assert told.where("_maybe").join(ids.distinct(), "id").count() == pairs.where("ordinal % 10 = 3 and id is not null").count()
    got, want = (outcome(assemble(pairs, AssemblerConfig(modules=(filters.id_set(ids, thin=t), LONG)))) for t in (True, False))
    assert got == want and sum(r[1] == "OK" for r in got) > 5
    none = assemble(pairs, AssemblerConfig(modules=(filters.id_set(ids.where("false"), thin=True),)))
    assert none.where("status = 'OK'").count() == 0 and none.count() == n
