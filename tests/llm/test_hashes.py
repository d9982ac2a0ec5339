"""Words that collide under sums of powers modulo 2**64 for any base, and what operators make of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmerge.llm import classes, decontaminate, jaccard, licenses, packing, quality, suffix, text as tx


def thue_morse(n, a="a", b="b"):
    t = a
    while len(t) < n:
        t += t.translate(str.maketrans(a + b, b + a))
    return t


T = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (512, 1024, 2048)]
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("pair", T)
def test_hashes_of_thue_morse_words(pair):
    buf = np.frombuffer(" ".join(pair).encode(), np.uint8)
    w = tx.words(buf, np.array([0, len(buf)]))
    assert w.hash[0] != w.hash[1]


def test_short_words_are_told_apart():
    ws = ["a", "aa", "a\0", "\0a", "\0", "\0\0", "abcdefgh", "abcdefgi", "abcdefghi", "é", "è"] + [f"{i:x}" for i in range(5000)]
    buf = np.frombuffer(b"".join(w.encode() for w in ws), np.uint8)
    end = np.cumsum([len(w.encode()) for w in ws])
    assert len(set(tx.word_hash(buf, np.concatenate([[0], end[:-1]]), end).tolist())) == len(set(ws))


@pytest.mark.parametrize("pair", T[1:])
def test_jaccard_of_thue_morse_words(spark, pair):
    rows = [(1, pair[0]), (2, pair[1]), (3, f"one two {pair[0]} three four"), (4, f"one two {pair[1]} three four"), (5, pair[0].upper())]
    got = sorted(map(tuple, jaccard.near_duplicates_by_row(spark.createDataFrame(rows, DOCS)).drop("digest").collect()))
    assert got == sorted(jaccard.brute_force(rows)) and [r[2] for r in got] == [1, 2, 3, 4, 1]


def test_packing_of_thue_morse_words_and_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    for words in [*T, ("Word", "word"), ("ISBN", "isbn")]:
        buf = np.frombuffer(" ".join(words).encode(), np.uint8)
        ids, n = tokens.lookup(buf, packing.chunks(buf, np.array([0, len(buf)]), tokens.fold))
        assert ids.tolist() == [i for w in words for i in tok.encode(w, add_special_tokens=False).ids] and n.sum() == len(ids)


def test_case_counts_unless_the_tokenizer_lower_cases(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.lower_cases(path)
    own = json.loads(open(path, encoding="utf-8").read())
    own["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(own))
    tok, tokens = Tokenizer.from_file(f"{tmp_path}/cased.json"), packing.WordTokens(f"{tmp_path}/cased.json")
    assert not tokens.fold
    buf = np.frombuffer(b"word Word WORD word", np.uint8)
    ids, _ = tokens.lookup(buf, packing.chunks(buf, np.array([0, len(buf)]), tokens.fold))
    assert ids.tolist() == [i for w in buf.tobytes().decode().split() for i in tok.encode(w, add_special_tokens=False).ids]


@pytest.mark.parametrize("pair", T[1:])
def test_windows_of_thue_morse_words(spark, pair):
    bench = spark.createDataFrame([(7, pair[0]), (8, f"a b c d {pair[0]} e f g h i j")], "item_id long, text string")
    rows = [(1, pair[0]), (2, pair[1]), (3, f"a b c d {pair[1]} e f g h i j"), (4, f"a b c d {pair[0]} e f g h i j")]
    found = decontaminate.digest_columns(decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), bench))
    hit = {r.doc_id for r in found.where("contaminated").collect()}
    assert hit == {1, 4}


def test_groups_by_bytes(spark):
    two = spark.createDataFrame([(1, "a" * 10), (2, None)], "key long, text string")
    assert classes.group_count(two, classes.GROUP_BYTES) == 16
    assert classes.group_count(two.select("key", F.repeat("text", 100_000).alias("text")), 10_000) == 100
    rows = [(1, "a b c d e f"), (2, "a b c d e f")]
    joined = spark.createDataFrame(rows, DOCS).join(spark.createDataFrame([(1,), (2,)], "doc_id long"), "doc_id")
    assert sorted(map(tuple, jaccard.near_duplicates_by_row(joined).drop("digest").collect())) == [(1, 2, 1), (2, 2, 1)]
    assert suffix.repeats_by_row(joined).count() == 2


def test_repeated_ids_count_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, y, **k: seen.update(n=len(x)))
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(40)] + [(1, None)], DOCS)
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"), max_labelled=4)
    assert 0 < seen["n"] <= 4


def test_reserved_rights_beside_a_licence(spark, tmp_path):
    texts = ["All rights reserved.", "Copyright. All rights reserved. This is under the BSD License.", "All rights reserved. MIT License"]
    rows = [(i, t) for i, t in enumerate(texts)]
    (tmp_path / "x").mkdir()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/x/documents.parquet")
    got = {r.doc_id: r.labels for r in licenses.op3_licenses(spark, f"{tmp_path}/x").collect()}
    assert got == {0: "proprietary", 1: "bsd", 2: "mit"} == {r[0]: r[6] for r in licenses.brute_force(rows)}
