import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmerge.functions import nt, phred
from readmerge.operators import clip, diff, filters, stats
from readmerge.operators.algorithms import algorithm
from readmerge.operators.assemble import assemble
from readmerge.operators.config import AssemblerConfig, nucleotides
from readmerge.plans import sim


@pytest.fixture(scope="module")
def pairs(spark, data):
    return sim.read_pairs(spark, data).where("ordinal between 1 and 400").cache()


def test_modules_reject_in_order_and_once(pairs):
    cfg = AssemblerConfig(modules=(filters.load("validtag:A:C"), filters.load("short:100"), filters.load("long:90")))
    out = assemble(pairs, cfg, with_logp=False).cache()
    tags = out.where("substr(id.tag, 1, 1) in ('G', 'T')")
    assert tags.where("status <> 'MODULE' or reject_module <> 'validtag'").count() == 0
    counted = {r["module"]: r["rejected"] for r in stats.reject_counts(out).collect()}
    assert set(counted) == {"validtag", "SHORT", "LONG"}
    assert sum(counted.values()) == out.where("status = 'MODULE'").count()


@pytest.mark.parametrize("spec", ["nothing", "validtag:A:CC", "validtag:", "other_primer:x:AC", "other_primer:f:", "min_phred:200", "pear_test:gamma=1", "pear_test:cutoff=2"])
def test_bad_modules(spec):
    with pytest.raises(ValueError):
        filters.load(spec)


def test_module_listing_and_registration():
    assert {"short", "after", "pear_test"} <= {m["name"] for m in filters.describe()}

    @filters.filter_module("odd", "none")
    def odd(args):
        """Odd lengths."""
        return filters.check("odd", F.col("sequence_length") % 2 == 1)

    assert filters.load("odd").stage == "check"
    del filters.REGISTRY["odd"]


def test_id_set_from_a_file(spark, pairs, tmp_path):
    heads = [f"@SIM:{r['id']['run']}:FC:{r['id']['lane']}:{r['id']['tile']}:{r['id']['x']}:{r['id']['y']} 1:N:0:{r['id']['tag']}" for r in pairs.where("ordinal <= 5").collect()]
    (tmp_path / "ids").write_text("\n".join([*heads, heads[0], "not a header"]) + "\n")
    out = assemble(pairs, AssemblerConfig(modules=(filters.load(f"filter:{tmp_path}/ids"),)), with_logp=False)
    assert sorted(r[0] for r in out.where("reject_module is null").select("ordinal").collect()) == [1, 2, 3, 4, 5]


def test_primer_offsets_against_loops():
    rng = np.random.default_rng(3)
    bases = np.array([1, 2, 4, 8, 15], np.uint8)
    for primer in ("ACG", "ACGTN", "NRY", "A"):
        want = nucleotides(primer)
        mask, q = bases[rng.integers(0, 5, (40, 17))], rng.integers(0, 45, (40, 17))
        t, penalty = math.log(0.5), 0.01
        got = clip.primer_offsets(mask, phred.QUAL_SCORE[q], phred.QUAL_SCORE_ERR[q], want, t, penalty)
        for row, quality, found in zip(mask, q, got, strict=True):
            best, place = math.exp(len(want) * t), 0
            for s in range(len(row) - len(want)):  # the last place is never tried
                total = sum((phred.QUAL_SCORE if row[s + x] & w else phred.QUAL_SCORE_ERR)[quality[s + x]] for x, w in enumerate(want) if w != 15)
                e = s + len(want)
                v = math.exp(total / (e + 1)) - e * penalty
                if v > best + 1e-15:
                    best, place = v, e + 1
            assert found == place
    assert clip.primer_offsets(mask[:, :2], *(phred.QUAL_SCORE[q[:, :2]],) * 2, nucleotides("ACG"), t, 0.0).tolist() == [0] * 40


def test_overhangs_and_primers_after(spark):
    row = ("GGGGGGGGGGACGTTTTT", "I" * 18)
    kind = "ordinal long, id struct<instrument:string,run:string,flowcell:string,lane:int,tile:int,x:int,y:int,tag:string>, f_seq string, f_qual string, r_seq string, r_qual string"
    df = spark.createDataFrame([(1, None, *row, "GGGGCCCC", "I" * 8), (2, None, "GGGG", "IIII", "GGGGCCCC", "I" * 8)], kind)
    kept = clip.trim_overhangs(df, forward="ACGT").collect()
    assert [(r["ordinal"], r["f_seq"], len(r["f_qual"])) for r in kept] == [(1, "GGGGGGGGGG", 10)]
    assert clip.trim_overhangs(df, forward="ACGT", skip=True).count() == 2
    template = "GATTACAGGCTTAACCGTGTACCTGAGTCATGCAAGTCCG"
    one = spark.createDataFrame([(1, None, template[:28], "I" * 28, "CGGACTTGCATGACTCAGGTACACGGTT", "I" * 28)], kind)
    r = assemble(one, AssemblerConfig(forward_primer="GATTA", primers_after=True)).first()
    assert (r["status"], r["forward_offset"], r["sequence"]) == ("OK", 5, template[5:])
    assert assemble(one, AssemblerConfig(forward_primer="GGGGG", primers_after=True)).first()["status"] == "NOFP"
    # divided by the place instead of the primer's length, five mismatches late in the read still pass
    assert assemble(one, AssemblerConfig(reverse_primer="TTTTT")).first()["status"] == "NOALGN"
    assert assemble(one, AssemblerConfig(reverse_primer="TTTTT", algorithm=algorithm("simple_bayesian", "paper"))).first()["status"] == "NORP"


def test_histograms_have_no_holes(pairs):
    out = assemble(pairs, with_logp=False)
    for h, first in ((stats.overlap_histogram(out), 0), (stats.examined_histogram(out), 1)):
        rows = sorted(tuple(r) for r in h.collect())
        assert [v for v, _ in rows] == list(range(first, first + len(rows))) and sum(n for _, n in rows) == out.where("status = 'OK'").count()
    assert stats.overlap_histogram(out.where("false")).count() == 0


def test_histograms_assemble_once(pairs):
    out = assemble(pairs, with_logp=False)
    for h in (stats.overlap_histogram(out), stats.examined_histogram(out)):
        assert h._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_phred_warning(spark):
    shape = "f_qual string, r_qual string"
    assert tuple(stats.phred_offset_warning(spark.createDataFrame([("hhhh", "ffff")], shape)).first()) == (102, True)
    assert tuple(stats.phred_offset_warning(spark.createDataFrame([("hh#h", "ffff")], shape)).first()) == (35, False)
    assert tuple(stats.phred_offset_warning(spark.createDataFrame([("", "")], shape)).first()) == (None, False)


def test_mean_quality(spark):
    assert stats.mean_quality(spark.createDataFrame([("I!",)], "q string"), "q").first()["mean_quality"] == 20.0


def test_diff_of_equal_settings_is_empty(pairs):
    same = diff.diff_summary(diff.diff(pairs, AssemblerConfig(), AssemblerConfig())).first().asDict()
    assert same["total"] == same["equal"] == 400 and not any(same[k] for k in ("better", "worse", "changed", "gained", "lost"))
    other = diff.diff(pairs, AssemblerConfig(), AssemblerConfig(modules=(filters.load("long:95"),)))
    kinds = {r["kind"]: r["count"] for r in other.groupBy("kind").count().collect()}
    assert kinds.get("lost", 0) > 0 and "gained" not in kinds


def test_pear_p_value():
    # with no tail beyond the overlap the product is empty
    assert filters.pear_p_value(np.array([10]), np.array([0]), np.array([10]), 1, -1).tolist() == [0.0]
    three = filters.pear_p_value(np.array([12, 10, 8]), np.array([4, 4, 3]), np.array([64, 64, 64]), 1, -1)
    assert [round(float(x), 4) for x in three] == [0.1375, 0.5468, 0.6781]  # computed by hand: terms below l, not up to it
    p = filters.pear_p_value(np.array([10, 10]), np.array([0, 5]), np.array([12, 12]), 1, -1)
    assert 0 <= p[0] < p[1] <= 1
    assert nt.LETTERS[15] == "N"


def test_diff_sends_no_reads_back(pairs):
    line = next(x for x in diff.diff(pairs, AssemblerConfig(), AssemblerConfig(min_overlap=30))._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x)
    assert "f_seq" not in line.split("],")[-1] and "r_qual" not in line.split("],")[-1].split("struct")[0]


def test_bloom_filter_takes_keys_again(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) AS key")
    some, blocks = filters.bloom_filter(keys)
    again, same = filters.bloom_filter(keys.union(keys), blocks * filters.BLOCK_BITS)
    assert same == blocks and sorted(map(tuple, some.collect())) == sorted(map(tuple, again.collect()))
    assert filters.maybe_members(keys, F.col("key"), keys).where("not _maybe").count() == 0
