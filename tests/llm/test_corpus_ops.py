"""Operators that compare all documents, and the pipeline, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readmerge.llm import classes, components, decontaminate, jaccard, quality, scratch, suffix

from .test_text_ops import ODD, check_packed, rows_of, same, table


@pytest.fixture
def many_groups(monkeypatch):
    """Many groups and buckets for small tables, so that all exchanges are used."""
    monkeypatch.setattr(classes, "group_count", lambda docs, size: 37)


def documents(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


# --- repeats --------------------------------------------------------------------------------------------------------


def test_repeats_data(spark, data):
    same(suffix.op4_suffix(spark, data), suffix.brute_force(documents(spark, data)))


def repeated_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab c") for _ in range(300))
    rows = [(None, base), (5, base), (5, base + "x"), (5, base), (3, None), (4, ""), (9, "a" * 500), (10, "a" * 49), (11, "b" + "a" * 60), (2, base[100:170] + "é" * 40), (1, "zz" + base[20:75]), (7, "ab" * 200), (8, "ba" * 30), (None, base)]
    for _ in range(80):
        a, b = sorted(rng.sample(range(300), 2))
        rows.append((rng.randrange(100), rng.choice(["", "q", "ab"]) + base[a:b] + rng.choice(["", "cc", "a" * 30]) + base[b // 2 : b]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_odd_rows(spark, many_groups, seed):
    rows = repeated_rows(seed)
    same(suffix.repeats_by_row(table(spark, rows)), suffix.brute_force(rows))


def test_repeats_shared_by_many(spark, many_groups):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, f"{word()} {word()} {passage} {word()} {word()}") for i in range(150)]
    same(suffix.repeats_by_row(table(spark, rows)), suffix.brute_force(rows))


def test_contexts_of_one_place_whose_hashes_agree_in_32_bits(spark, many_groups):
    import numpy as np

    a = ("wjpgmkmjawsiziondyjiywmaniopaubmaguygspgzicjbqmmfc", "ydfwhahxcuqvyaaqxyjiywmaniopaubmazxjrehdzpyxxxkknb", "mufoolxutftshswvnyjiywmaniopaubmaxtzcroerpuouniwnb")
    b = ("uhenejktzjkijgrbsyjiywmaniopaubmapdvdqtzphlfanjmav", "zamqupbzlvjorcmhsyjiywmaniopaubmabhoqchxnvhrqtibky", "qcfwnwhjyqzindpblyjiywmaniopaubmaotcjhjovqzynlzmod")
    s = suffix.stretches(np.frombuffer("".join(a + b).encode(), np.uint8), np.arange(0, 301, 50))
    assert len(set(s.h.tolist())) == 1 and len(set(s.seg.tolist())) == 6
    rows = list(enumerate(a + b))
    same(suffix.repeats_by_row(table(spark, rows)), suffix.brute_force(rows))


def test_levels_find_smaller_keys():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 3000
    h, seg, key = rng.integers(0, 400, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint32), rng.integers(0, 500, n)
    full, shared = suffix.scan_levels(h, seg, key)
    least, keys = {}, {}
    for a, s, k in zip(h, seg, key, strict=True):
        least[a, s] = min(least.get((a, s), 10**9), k)
        keys.setdefault(a, set()).add(k)
    assert (full == [k > least[a, s] for a, s, k in zip(h, seg, key, strict=True)]).all()
    told = {(a, s) for x, a, s, k in zip(shared, h, seg, key, strict=True) if x and k == least[a, s]}  # one entry of equals is enough
    assert all((a, s) in told for a, s in least if len(keys[a]) > 1)
    assert not any(x for x, a in zip(shared, h, strict=True) if len(keys[a]) == 1)


def test_cut_keeps_columns_and_empty_tables(spark, many_groups):
    docs = table(spark, repeated_rows(0))
    cut = suffix.cut_repeats(docs, n_chars="n")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert suffix.repeats_by_row(table(spark, [])).count() == 0
    assert suffix.cut_repeats(table(spark, [])).count() == 0
    want = {(r[0], r[1]) for r in suffix.brute_force(repeated_rows(0))}
    assert {r["doc_id"] for r in cut.collect()} == {k for k, _ in want}


@pytest.mark.parametrize("seed", range(2))
def test_cut_rows_one_by_one(spark, many_groups, seed):
    """Every row of odd tables: copies under several keys, several rows of one key, null keys, null and short texts."""
    rows = repeated_rows(seed)
    rows += [(3, rows[20][1] + "y" * 50), (3, rows[20][1] + "y" * 50), (200, rows[20][1] + "y" * 50), (None, "only here " * 6), (None, "only here " * 6)]
    docs = spark.createDataFrame([(k, t, i, None if i % 5 else {"a": i}) for i, (k, t) in enumerate(rows)], "doc_id long, text string, digest int, `group` map<string, int>")
    want = {}
    for i, ((k, t), (_, _, lost, _, kept)) in enumerate(zip(rows, suffix.brute_force(rows), strict=True)):
        want[i] = (k, t, lost, kept)
    got = suffix.cut_repeats(docs, n_chars="digest").select("doc_id", "text", "digest", "group").collect()
    assert len(got) == len(rows)
    named = suffix.cut_repeats(docs).collect()
    assert sorted(r["digest"] for r in named) == list(range(len(rows)))
    for r in named:
        k, t, lost, kept = want[r["digest"]]
        assert r["doc_id"] == k and r["group"] == (None if r["digest"] % 5 else {"a": r["digest"]})
        assert (r["text"] is None) == (t is None)
        if not lost or "é" not in t:
            assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == kept
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] and r["text"]) == sorted((r["doc_id"], r["text"]) for r in named if r["doc_id"] and r["text"])
    assert all(r["digest"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_cut_texts_do_not_move_again(spark, many_groups):
    """Texts are sent to their groups and nowhere else: no join or aggregate has them."""
    docs = table(spark, [(i, f"{i} " + "same words in all texts, more than fifty bytes of them; " + "x" * i) for i in range(20)])
    plan = suffix.cut_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroupsInArrow") >= 3


# --- near duplicates ------------------------------------------------------------------------------------------------


def test_near_duplicates_data(spark, data):
    same(jaccard.op6_jaccard(spark, data), jaccard.brute_force(documents(spark, data)))


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [(None, "a b"), (5, "A b"), (7, "a  b\n"), (3, None), (4, ""), (8, ""), (9, "  "), (9, "x y z w"), (10, "x y z w v"), (11, "é ü ß"), (12, "É ü ß"), (None, "q r s t u v")]
    for _ in range(150):
        d = list(base[: rng.randrange(5, 60)])
        for _ in range(rng.randrange(0, 6)):
            d[rng.randrange(len(d))] = rng.choice(words)
        rows.append((rng.randrange(200), " ".join(d)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_odd(spark, many_groups, seed):
    rows = near_rows(seed)
    same(jaccard.near_duplicates_by_row(table(spark, rows)).drop("digest"), jaccard.brute_force(rows))


def test_a_chain_is_one_component(spark, many_groups):
    """Each document links with the next only; ends are far apart, and one line is common to all."""
    line = "this line stands in every document"
    rows = [(i, line + " " + " ".join(f"s{j}" for j in range(4 * i, 4 * i + 60))) for i in range(30)]
    rows += [(100 + i, line + f" other{i} text{i} here{i}") for i in range(40)]
    want = jaccard.brute_force(rows)
    same(jaccard.near_duplicates_by_row(table(spark, rows)).drop("digest"), want)
    assert {c for k, _, c in want if k < 30} == {0}


def line_texts(count):
    """Texts of ten lines out of forty common ones: all share shingles, hardly any link."""
    rng = random.Random(7)
    lines = [" ".join(f"l{i}w{j}" for j in range(9)) for i in range(40)]
    return [(i, " ".join(rng.sample(lines, 10))) for i in range(count)]


@pytest.mark.parametrize("part", [2048, 16])
def test_crowded_shingles(spark, many_groups, monkeypatch, part):
    """Common lines that link nothing, among near copies; also with members of a shingle in many blocks."""
    monkeypatch.setattr(jaccard, "JOB_PART", part)
    rows = line_texts(300) + [(1000 + i, t + " and a few more words") for i, t in line_texts(40)] + near_rows(5)
    same(jaccard.near_duplicates_by_row(table(spark, rows)).drop("digest"), jaccard.brute_force(rows))


@pytest.mark.parametrize("part", [2048, 5])
def test_jobs_have_every_undecided_pair(monkeypatch, part):
    import numpy as np

    monkeypatch.setattr(jaccard, "JOB_PART", part)
    rng = np.random.default_rng(part)
    h, n, ids = np.sort(rng.integers(0, 12, 400)).astype(np.uint64), rng.integers(20, 60, 400), np.arange(400)
    order = np.lexsort((ids, n, h))
    h, n, label = h[order], n[order], rng.integers(0, 5, 400)
    lead = jaccard.stars(h, n, ids)
    task, job, cut = jaccard.undecided(h, n, ids, label, lead, 7)
    assert len(task) == len(job) and set(task) <= set(range(7))
    got = set()
    for (s, m, t, k), c in zip(job.tolist(), cut.tolist(), strict=True):
        at = [*range(s, s + m), *range(t, t + k)]
        pairs = [(x, y) for x in at[:c] for y in at[c:]] if c else [(x, y) for i, x in enumerate(at) for y in at[i + 1 :]]
        assert not got & set(pairs)
        got |= set(pairs)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if h[i] == h[j] and 3 * n[j] <= 4 * n[i] and label[i] != label[j] and lead[j] != i}
    assert want and want <= got


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (5, 60, 64, 65, 100, 1000, 5000):
        hashes = rng.integers(0, 2**63, n * 4 // 3).astype(np.uint64)
        sets = [hashes[:n], hashes[: n * 4 // 3], np.concatenate([hashes[: n * 6 // 7], rng.integers(0, 2**63, n - n * 6 // 7).astype(np.uint64)]), rng.integers(0, 2**63, n).astype(np.uint64)]
        made = jaccard.Sets.__new__(jaccard.Sets)
        made.n, made.h = np.array([len(s) for s in sets]), np.concatenate(sets)
        made.doc = np.repeat(np.arange(4), made.n)
        maps = made.bitmaps()
        start = np.cumsum([0, *(len(m) // 8 for m in maps[:-1])])
        allowed = jaccard.may_link(made.n, np.frombuffer(b"".join(maps), "<u8"), start, np.zeros(4, int), np.arange(4))
        assert allowed[:3].tolist() == [True, True, bool(100 * (n * 6 // 7) >= 75 * (2 * n - n * 6 // 7)) or allowed[2]]
        assert n < 60 or not allowed[3]


def test_pairs_asked_grow_below_the_square(spark):
    """Of the pairs of crowded shingles only those are listed whose bitmaps allow a link."""
    from pyspark.sql import Row

    asked = []
    real = jaccard._links

    def counted(texts, requests, *rest):
        asked.append(sum(len(classes.unpack(r.data)[0]) for r in requests.where("source = -1").collect()))
        return real(texts, requests, *rest)

    jaccard._links = counted
    try:
        for count in (500, 1000):
            jaccard.near_duplicates(spark.createDataFrame([Row(doc_id=k, text=t) for k, t in line_texts(count)]))
    finally:
        jaccard._links = real
    assert asked[1] < 500 * 40 and asked[3] < 1000 * 40  # 18,000 and 72,000 pairs would be listed without bitmaps


def test_keep_one_of_each(spark, many_groups):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "q w e r t"), (None, "q w e r t"), (4, None), (4, ""), (5, " ")]
    docs = table(spark, rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, rows[0][1]), (None, "q w e r t"), (4, None), (4, ""), (5, " ")], key=str)
    assert jaccard.keep_one_of_each(table(spark, [])).count() == 0
    assert jaccard.near_duplicates_by_row(table(spark, [])).count() == 0


def test_near_duplicates_leave_no_shingles_on_disk(spark, many_groups, monkeypatch):
    """Later steps find only what the rows are still read from: no blocks of shingles, and of ``keep_one_of_each`` the chosen rows."""
    from pathlib import Path

    made = []
    real = scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda session, name: made.append(real(session, name)) or made[-1])
    left = lambda: sorted(p.rpartition("/")[2] for p in made if any(Path(p.removeprefix("file://")).glob("part-*")))
    docs = table(spark, [(i, " ".join(f"w{i // 3}x{j}" for j in range(30)) + " tail" * (i % 3)) for i in range(60)])
    found = jaccard.near_duplicates(docs)
    assert left() == ["all-links", "all-roots", "every"] and found.count() == 60
    del made[:]
    kept = jaccard.keep_one_of_each(docs)
    assert left() == ["chosen"] and kept.count() == 20


def test_stars_cover_their_size_range():
    import numpy as np

    h = np.array([1, 1, 1, 1, 2, 3, 3], np.uint64)
    n = np.array([9, 12, 13, 40, 5, 3, 4])
    assert jaccard.stars(h, n, np.arange(7)).tolist() == [0, 0, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300 + i) for i in range(1, 40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_round_trip():
    import numpy as np

    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.array([3, 1], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(classes.unpack(classes.pack(*arrays)), arrays, strict=True))
    x = np.array([-5, 3, 3, 2**62])
    assert (classes.undelta(classes.deltas(x)) == x).all()


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.materialize(stage(spark, docs, data), "stage")
        seen[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, after = seen["quality classifier"]
    model = quality.train(before, spark.read.parquet(f"{data}/labels.parquet"))
    assert set(text(after)) == {r["doc_id"] for r in quality.score_quality(before, model).collect() if r["score"] >= 0.3}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert good <= set(text(after))

    before, after = seen["n-gram Jaccard join"]
    assert set(text(after)) == {k for k, _, c in jaccard.brute_force(list(text(before).items())) if k == c}

    before, after = seen["suffix-array dedup"]
    old, new = text(before), text(after)
    lost = {k: n for k, _, n, _, _ in suffix.brute_force(list(old.items()))}
    assert set(old) == set(new) and any(lost.values())
    for k in old:
        assert new[k] == old[k] if not lost[k] else 0 <= len(old[k].encode()) - lost[k] - len(new[k].encode()) <= 6 * 40

    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(text(after)) == {r[0] for r in decontaminate.brute_force(list(text(before).items()), items) if not r[-1]}

    before, after = seen["best-fit packing"]
    check_packed(after.collect(), list(text(before).items()), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 4096)


def test_pipeline_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.select("doc_id").distinct().count() <= 200


def test_odd_rows_pass_all_stages(spark, data, many_groups):
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in ODD], spark.read.parquet(f"{data}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = scratch.materialize(stage(spark, docs, data), "odd")
    assert docs.count() > 0
    assert rows_of(docs.where(F.col("offset") < 0)) == []
