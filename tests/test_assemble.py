"""The kernel against the worked pairs and against a scalar model written from the semantics."""

import random

import numpy as np
import pytest

from readmerge.functions import nt, phred
from readmerge.operators.algorithms import REGISTRY, algorithm
from readmerge.operators.assemble import assemble, assemble_pair
from readmerge.operators.config import AssemblerConfig

TEMPLATE = "GATTACAGGCTTAACCGTGTACCTGAGTCATGCAAGTCCG"
FORWARD, REVERSE = TEMPLATE[:28], "CGGACTTGCATGACTCAGGTACACGGTT"


def output(row):
    return "".join(chr(33 + v) for v in phred.requantise_array(row["logp"]))


@pytest.mark.parametrize(
    "name, score, probability, qual",
    [
        ("simple_bayesian", -69.73286, 0.999863, "I" * 12 + "E" * 16 + "I" * 12), ("ea_util", -2.77259, 0.999902, "I" * 40), ("pear", -4.02149, 0.906519, "I" * 12 + "'" * 16 + "I" * 12),
        ("rdp_mle", 22.17744, 0.999902, "I" * 40), ("stitch", -1.25276, 0.999863, "I" * 12 + "E" * 16 + "I" * 12), ("uparse", -34.23856, 0.999941, "I" * 12 + "N" * 16 + "I" * 12),
    ],
)
def test_perfect_overlap(name, score, probability, qual):
    r = assemble_pair(FORWARD, "I" * 28, REVERSE, "I" * 28, AssemblerConfig(algorithm=algorithm(name)))
    assert (r["status"], r["overlap"], r["sequence"], r["overlaps_examined"], r["slow"]) == ("OK", 16, TEMPLATE, 1, False)
    assert r["overlap_score"] == pytest.approx(score, abs=1e-5)
    assert np.exp(r["quality"]) == pytest.approx(probability, abs=1e-6)
    assert output(r) == qual


def test_flash_rejects_a_perfect_overlap_unless_by_the_paper():
    assert assemble_pair(FORWARD, "I" * 28, REVERSE, "I" * 28, AssemblerConfig(algorithm=algorithm("flash")))["status"] == "NOALGN"
    assert assemble_pair(FORWARD, "I" * 28, REVERSE, "I" * 28, AssemblerConfig(algorithm=algorithm("flash", "paper")))["overlap"] == 16


def test_mismatch_and_masks():
    bad = assemble_pair(FORWARD, "I" * 28, REVERSE[:19] + "A" + REVERSE[20:], "I" * 19 + "+" + "I" * 8)
    assert (bad["overlaps_examined"], bad["slow"], bad["overlap_mismatches"], bad["sequence"]) == (27, True, 1, TEMPLATE)
    assert output(bad)[20] == '"' and np.exp(bad["quality"]) == pytest.approx(0.920290, abs=1e-6)
    unknown = assemble_pair(FORWARD[:16] + "N" + FORWARD[17:], "I" * 16 + "#" + "I" * 11, REVERSE, "I" * 28)
    assert (unknown["degenerates"], unknown["overlap_mismatches"], output(unknown)[16]) == (0, 0, "#")
    cliff = assemble_pair(FORWARD, "I" * 24 + "####", REVERSE, "I" * 28)
    assert output(cliff)[24:28] == "IIII" and np.exp(cliff["quality"]) == pytest.approx(0.999873, abs=1e-6)


def test_no_overlap_and_homopolymers():
    none = assemble_pair("A" * 20, "I" * 20, "A" * 20, "I" * 20)
    assert (none["status"], none["overlaps_examined"]) == ("NOALGN", 19)
    same = assemble_pair("A" * 20, "I" * 20, "T" * 20, "I" * 20)
    assert (same["overlap"], same["overlaps_examined"], len(same["sequence"])) == (20, 2, 20)


# --- a scalar model, base by base -----------------------------------------------------------------------------------


def scalar_candidates(f, r, low, high, keep=2):
    def places(seq):
        bad, code, out = 8, "", []
        for i, v in enumerate(seq):
            code = (code + {2: "C", 4: "G", 8: "T"}.get(v, "A"))[-8:]
            if v == 15:
                bad = 8
            elif bad:
                bad -= 1
            else:
                out.append((i, code))
        return out

    seen = {}
    for i, c in places(f):
        if len(seen.setdefault(c, [])) < keep:
            seen[c].append(i)
    found = set()
    for j, c in places(r[::-1]):
        for i in seen.get(c, []):
            o = len(f) + len(r) - (len(r) - 1 - j) - i - 1
            if low <= o <= max(high, low):
                found.add(o)
    return sorted(found) or list(range(low, max(high, low) + 1))


def scalar_best(f, fq, r, rq, cfg, fo=0, ro=0):
    from readmerge.operators.kernel import Reads, paired

    n, m = len(f), len(r)
    if cfg.min_overlap + fo >= n or cfg.min_overlap + ro >= m:
        return None, 0
    high = min(n, m) if not cfg.max_overlap else min(n + m - cfg.min_overlap - fo - ro - 1, cfg.max_overlap)
    best, where = phred.QUAL_NN * (n + m), None
    tried = scalar_candidates(f, r, cfg.min_overlap, high)
    for o in tried:
        # the score of one pair alone, with positions listed one by one
        reads = Reads(np.array([f], np.uint8), np.array([fq]), np.array([r], np.uint8), np.array([rq]))
        p = paired(reads, o)
        listed = [(n + i - o, m - i - 1) for i in range(o) if 0 <= n + i - o < n and 0 <= m - i - 1 < m]
        assert p.f[0].tolist() == [f[a] for a, _ in listed] and p.r[0].tolist() == [r[b] for _, b in listed]
        s = float(cfg.algorithm.score(p)[0])
        if s > best:
            best, where = s, o
    return where, len(tried)


def scalar_merge(f, fq, r, rq, o, cfg, fo=0, ro=0):
    n, m = len(f), len(r)
    df, dr = n - fo - o, m - ro - o
    score = lambda q: float(phred.QUAL_SCORE[min(max(q, 0), 46)])
    fu, ru = n, m
    while fu and fq[fu - 1] == 2:
        fu -= 1
    while ru and rq[ru - 1] == 2:
        ru -= 1
    out = {}
    for i in range(max(df, 0)):
        out[i] = (f[fo + i], score(fq[fo + i]))
    for i in range(max(0, o + min(df, 0) + min(dr, 0))):
        a, b = fo + max(df, 0) + i, m - i - 1 + min(df, 0)
        if not (0 <= a < n and 0 <= b < m):
            continue
        same = (f[a] & r[b]) != 0
        if a >= fu and b >= ru:
            p = phred.QUAL_NN
        elif a >= fu:
            p = score(rq[b])
        elif b >= ru:
            p = score(fq[a])
        else:
            p = float(cfg.algorithm.match(np.array(same), np.array(fq[a]), np.array(rq[b])))
        out[max(df, 0) + i] = (f[a] & r[b] if same else r[b] if fq[a] < rq[b] else f[a], p)
    for i in range(max(dr, 0)):
        out[df + o + i] = (r[m - o - i - 1], score(rq[m - o - i - 1]))
    return out


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_kernel_equals_scalar_model(name):
    rng = random.Random(name)
    cfg = AssemblerConfig(algorithm=algorithm(name), threshold=1e-9)
    for trial in range(25):
        n, m = rng.randrange(12, 40), rng.randrange(12, 40)
        template = "".join(rng.choice("ACGT") for _ in range(60))
        o = rng.randrange(9, min(n, m) + 1)
        f = list(template[:n])
        rc = list(template[n - o : n - o + m].ljust(m, "A"))
        for s in (f, rc):
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
        q = [[rng.choice([2, 2, 10, 20, 40]) for _ in range(k)] for k in (n, m)]
        local = AssemblerConfig(**{**cfg.__dict__, "max_overlap": rng.choice([0, 0, 50]), "forward_trim": rng.choice([0, 3]), "reverse_trim": rng.choice([0, 2])})
        reverse = "".join(rc)[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
        got = assemble_pair("".join(f), "".join(chr(33 + x) for x in q[0]), reverse, "".join(chr(33 + x) for x in q[1]), local)
        fm, rm = [int(nt.FROM_ASCII[ord(c)]) for c in f], [int(nt.FROM_ASCII_COMPLEMENT[ord(c)]) for c in reverse]
        where, tried = scalar_best(fm, q[0], rm, q[1], local, local.forward_trim, local.reverse_trim)
        if where is None:
            assert got["status"] == "NOALGN"
            continue
        size = n - local.forward_trim - where + m - local.reverse_trim
        if size + 1 <= 0:
            assert got["status"] == "NOALGN"
            continue
        assert (got["overlap"], got["overlaps_examined"]) == (where, tried)
        want = scalar_merge(fm, q[0], rm, q[1], where, local, local.forward_trim, local.reverse_trim)
        assert got["sequence"] == "".join(nt.LETTERS[want[i][0]] for i in sorted(want))
        assert np.allclose(got["logp"], [want[i][1] for i in sorted(want)])
        assert got["quality"] == pytest.approx(sum(p for _, p in want.values()) / (size + 1))


def test_spark_rows_and_invariants(spark, data):
    from readmerge.operators import filters, stats
    from readmerge.plans import sim

    pairs = sim.read_pairs(spark, data).cache()
    out = assemble(pairs, AssemblerConfig(modules=(filters.load("short:100"),)), keep_reads=True).cache()
    counts = {r["code"]: r["value"] for r in stats.stat_counts(out).collect()}
    assert counts["READS"] == pairs.count() == sum(v for k, v in counts.items() if k not in ("READS", "SLOW"))
    ok = out.where("status = 'OK'")
    assert ok.where("sequence_length <> 128 - overlap - forward_offset - reverse_offset").count() == 0
    assert ok.where("size(logp) <> sequence_length or sequence_length < 100").count() == 0
    sample = ok.orderBy("ordinal").limit(20).collect()
    for r in sample:
        assert assemble_pair(r["f_seq"], r["f_qual"], r["r_seq"], r["r_qual"])["sequence"] == r["sequence"]


def test_short_empty_and_null_reads(spark):
    from readmerge.operators.assemble import empty_pairs

    base = empty_pairs(spark)
    rows = spark.createDataFrame([(1, None, "A", "I", "ACGT", "IIII"), (2, None, None, None, "ACGT", "IIII"), (3, None, "", "", "", ""), (4, None, "ACGTACGTAC", "IIIIIIIIII", "GTACGTACGT", "IIIIIIIIII")], base.schema)
    assert {r["ordinal"]: r["status"] for r in assemble(rows).collect()} == {1: "BADR", 2: "BADR", 3: "BADR", 4: "OK"}
    assert assemble(base).count() == 0


def test_settings_are_checked():
    for bad in ({"threshold": 1.0}, {"primer_penalty": 1.0}, {"min_overlap": 1}, {"forward_primer": "AC", "forward_trim": 2}, {"forward_primer": "AZ"}):
        with pytest.raises(ValueError):
            AssemblerConfig(**bad)
    for bad in ("nothing", "flash:1", "pear:2"):
        with pytest.raises(ValueError):
            algorithm(bad)
    assert AssemblerConfig.primer_or_trim("12") == (None, 12) and AssemblerConfig.primer_or_trim("ACN") == ("ACN", 0)


def test_only_places_of_both_reads_are_matched(monkeypatch):
    from readmerge.operators.algorithms import SimpleBayesian

    sizes, match = [], SimpleBayesian.match
    monkeypatch.setattr(SimpleBayesian, "match", lambda self, same, a, b: sizes.append(len(same)) or match(self, same, a, b))
    template = "GATTACAGGCTTAACCGTGTACCTGAGTCATGCAAGTCCG"
    got = assemble_pair(template[:28], "I" * 28, "CGGACTTGCATGACTCAGGTACACGGTT", "I" * 28)
    assert got["sequence"] == template and sizes == [got["overlap"]] == [16]
