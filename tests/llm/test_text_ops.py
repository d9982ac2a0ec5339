"""Operators on single texts against brute-force versions, and defined results of odd inputs."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readmerge.llm import decontaminate, licenses, media, packing, quality, shard, urlfilter, vp8l, warc

ODD = [(1, None), (1, ""), (2, "a b c"), (2, "A b, c d"), (None, "x a b c y"), (3, " ".join(["ha"] * 50)), (4, "é ü ß ç ñ á é í ó ú x"), (4, "é ü ß ç ñ á é í ó ú x"), (5, "The MIT License. Apache License, general public LICENSE mit license"), (6, "word " * 40_000)]


def table(spark, rows, extra=True):
    """Documents with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit("?").alias(c) for c in ("key", "digest", "row", "hits", "score", "t", "group", "data", "shard", "n")]) if extra else df


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(got, want):
    assert rows_of(got) == sorted(want, key=str)


# --- decontamination ------------------------------------------------------------------------------------------------


def test_decontaminate_data(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = decontaminate.brute_force(docs, items)
    same(decontaminate.op2_decontaminate(spark, data), want)
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_decontaminate_odd(spark, monkeypatch, bits):
    """Also with a bitmap that is full, so that every window is a candidate."""
    monkeypatch.setattr(decontaminate, "BITMAP", bits)
    items = [(1, "a b c"), (2, " ".join(["ha"] * 12)), (3, ""), (4, None), (5, "é ü ß ç ñ á é í ó ú"), (6, "a B c"), (10, "word word")]
    found = decontaminate.decontaminate(table(spark, ODD), spark.createDataFrame(items, "item_id long, text string"))
    same(decontaminate.digest_columns(found), decontaminate.brute_force(ODD, items))


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(table(spark, ODD), none)
    assert found.where("size(runs) > 0 or size(items) > 0").count() == 0 and found.count() == len(ODD)
    assert decontaminate.decontaminate(table(spark, []), none).count() == 0
    assert decontaminate.keep_clean(table(spark, ODD), none).columns == table(spark, ODD).columns


def test_runs_stay_in_their_document(spark):
    docs = [(i, "a b c") for i in range(5)] + [(9, "a b c a b c q")]
    found = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in found.collect()} == {**{i: [(0, 3)] for i in range(5)}, 9: [(0, 6)]}


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_decontaminate_random(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITMAP", bits)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 30]))) for i in range(40) if i % 10]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(3, "zz " + items[5][1] + " zz")] * 3
    want = decontaminate.brute_force(docs, items)
    found = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    same(decontaminate.digest_columns(found), want)
    items = [x for x in items if len(x[1].split()) > 8]
    want = decontaminate.brute_force(docs, items)
    kept = decontaminate.keep_clean(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert 0 < kept.count() < len(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[-1])


# --- licences -------------------------------------------------------------------------------------------------------


def licence_rows(rows):
    return sorted([(*r[:-1], round(r[-1], 8)) for r in rows], key=str)


def test_licenses_data(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert licence_rows(map(tuple, licenses.op3_licenses(spark, data).collect())) == licence_rows(licenses.brute_force(docs))


def licence_texts():
    """Whole sentences, sentences cut at both ends or changed inside, names, and odd texts."""
    rows = list(ODD) + [(7, "granted free of charge"), (8, "mit license " * 200), (9, "and use in source and binary forms with or without modification are permitted")]
    for t in licenses.templates():
        n = len(t.words)
        for ws in (t.words, t.words[max(1, n // 8) :], t.words[: n - max(1, n // 8)], t.words[: n // 2], t.words[n // 2 :], [*t.words[: n // 3], "zzz", *t.words[n // 3 + 1 :]], [*t.words[: n // 3], "zzz", *t.words[n // 3 :]]):
            rows.append((len(rows), " ".join(ws)))
    return rows


def licence_results(found):
    return {(r["doc_id"], r["n_words"], tuple((h["label"], h["start"], round(h["coverage"], 8)) for h in r["hits"]), round(r["score"], 8)) for r in found.collect()}


def test_licenses_cut_and_changed(spark, tmp_path):
    rows = licence_texts()
    table(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    got = licence_rows(map(tuple, licenses.op3_licenses(spark, str(tmp_path)).collect()))
    assert got == licence_rows(licenses.brute_force(rows))
    assert len({r[6] for r in got}) > 12 and any(0.8 <= r[7] < 1 for r in got)
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_licenses_do_not_depend_on_neighbours(spark):
    """Results stay the same in any order and for any size of batches."""
    rows = licence_texts()
    want = licence_results(licenses.scan_licenses(table(spark, rows).coalesce(1)))
    random.Random(1).shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert licence_results(licenses.scan_licenses(table(spark, rows).coalesce(1))) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# --- sharding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_minimax_capacity(seed):
    rng = random.Random(seed)
    names = sorted(f"{rng.getrandbits(64):016x}" for _ in range(rng.choice([3, 60, 3000])))
    mass = [rng.choice([1, 5, 50, 400]) * rng.randrange(1, 30) for _ in names]
    n = rng.choice([1, 2, 7, 16])

    def fetch(prefixes):
        out = {}
        for p in prefixes:
            for name, m in zip(names, mass, strict=True):
                if name.startswith(p):
                    k = name[: len(p) + shard.DIGITS]
                    a, b = out.get(k, (0, 0))
                    out[k] = a + m, b + 1
        return [(k, a, b) for k, (a, b) in out.items()]

    capacity, cuts = shard.minimax_cuts(shard.Ranges(fetch), n, max(mass))
    assert capacity == shard.brute_capacity(mass, n) and len(cuts) < n
    sums = [0] * n
    for name, m in zip(names, mass, strict=True):
        sums[sum(name >= c for c in cuts)] += m
    assert max(sums) <= capacity


def test_shards(spark, data):
    out = shard.op1_shard(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert (out["size"] == [len(text[i].encode()) + 1 for i in out.doc_id]).all()
    assert (out.text_crc32 == [zlib.crc32(text[i].encode()) for i in out.doc_id]).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby([text[i] for i in out.doc_id]).shard.nunique().max() == 1
    total = out.groupby("shard")["size"].sum()
    assert len(total) == 16 and total.max() <= out["size"].sum() / 16 + out.groupby([text[i] for i in out.doc_id])["size"].sum().max()


def test_shards_of_odd_rows(spark):
    hot = [(100 + i, "hot text") for i in range(60)]
    out = shard.shard_by_bytes(table(spark, [*ODD, *hot]), 4).toPandas()
    assert len(out) == len(ODD) + 60 and set(out.shard) <= set(range(4))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert out[out.doc_id >= 100].shard.nunique() == 1
    assert set(out[out["size"] == 1].text_crc32) == {0}
    assert shard.shard_by_bytes(table(spark, []), 4).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_separates_held_out(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    got = quality.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert got[got.quality == 1].predicted.mean() > 0.97


def test_quality_odd(spark):
    docs = table(spark, ODD)
    one = quality.train(docs, spark.createDataFrame([(1, 1), (2, None), (77, 0), (None, 0)], "doc_id long, quality int"))
    out = quality.score_quality(docs, one).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    kept = quality.keep_quality(docs, one, least=0.0)
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs)
    assert quality.score_quality(table(spark, []), one).count() == 0


def test_pairs_learn_what_features_alone_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=20, pairs=2)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    assert (0, 1) in [(a, b) for a, b, _ in m.pairs]


# --- packing --------------------------------------------------------------------------------------------------------


def test_fullest_and_pack():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
        room = rng.randrange(1, 60)
        best = {0}
        for k, n in counts.items():
            best = {s + k * j for s in best for j in range(n + 1) if s + k * j <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(best) and all(got.count(k) <= counts[k] for k in got)
    counts = {rng.randrange(1, 45): rng.randrange(1, 500) for _ in range(40)}
    patterns = packing.pack(dict(counts), 100)
    used = {}
    for times, p in patterns:
        assert sum(k * n for k, n in p.items()) <= 100
        for k, n in p.items():
            used[k] = used.get(k, 0) + times * n
    assert used == counts
    assert sum(t for t, _ in patterns) <= -(-sum(k * n for k, n in counts.items()) // 100) * 1.02 + 1


def check_packed(out, docs, tok, capacity):
    want = {}
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.setdefault((d, k // capacity, k, len(part), zlib.crc32(part.tobytes())), []).append(1)
    got = {}
    for r in out:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    assert got == want
    at = {}
    for r in out:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_packing(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = packing.op7_packing(spark, data).collect()
    used = check_packed(out, docs, tok, 4096)
    assert used <= -(-sum(r["length"] for r in out) // 4096) + 1
    rows = [*ODD, (11, "I'll don't \u2003 ABC\u00a0def Ǆ e\u0301 x\x1cy 3.14 ''s"), (12, "日本語 🙂🙂 ÀÉ"), (12, "日本語 🙂🙂 ÀÉ")]
    check_packed(packing.pack_documents(table(spark, rows), path, capacity=64).collect(), rows, tok, 64)
    assert packing.pack_documents(table(spark, []), path).count() == 0


@pytest.mark.parametrize("front", [False, True])
def test_cut_license_header_anywhere_in_a_batch(spark, front):
    texts = []
    for t in licenses.templates():
        if not t.base:
            n = len(t.words)
            texts += [" ".join(t.words[j:] if front else t.words[: n - j]) for j in range(1, n // 5 + 1)]
    rows = list(enumerate(texts))
    rows += [(len(rows), "nothing of the kind here")]
    seen = lambda r: ([(h.label, h.start, h.base, round(h.coverage, 9)) for h in r.hits], round(r.score, 9))
    batch = {r.doc_id: seen(r) for r in licenses.scan_licenses(table(spark, rows).coalesce(1)).collect()}
    apart = {r.doc_id: seen(r) for r in licenses.scan_licenses(table(spark, rows).repartition(1).orderBy(F.desc("doc_id")).coalesce(1)).collect()}
    assert batch == apart


# --- media ----------------------------------------------------------------------------------------------------------


def test_media(spark, data):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in media.op8_media(spark, data).collect():
        raw = docs[r["doc_id"]]
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))


def test_media_odd(spark):
    stored = media.to_media(table(spark, ODD))
    out = media.read_media(stored).collect()
    assert len(out) == len(ODD)
    by_text = {}
    for (_, t), r in zip(sorted(ODD, key=lambda x: len((x[1] or "").encode())), sorted(out, key=lambda r: r["n_bytes"]), strict=True):
        by_text.setdefault(len((t or "").encode()), set()).add(r["n_bytes"])
    assert all(v == {k} for k, v in by_text.items())
    for n in (64, 64 * 16384, 64 * 16385):
        payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.load(media.store(payload), n)[2] == payload


class Writer:
    """A plain bit writer for pictures that use the whole format."""

    def __init__(self):
        self.v = self.n = 0

    def put(self, value, bits):
        self.v |= value << self.n
        self.n += bits

    def code(self, lengths):
        """A normal code with lengths written one by one; returns symbol -> (code, bits)."""
        used = [i for i, x in enumerate(lengths) if x]
        if len(used) == 1 and used[0] < 256:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(used[0], 8)
            return {used[0]: (0, 0)}
        own = vp8l.huffman([lengths.count(k) + (k == 0) for k in range(16)] + [0] * 3, 7)
        self.put(0, 1), self.put(15, 4)
        for s in vp8l.CODE_LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        words = {s: (c, n) for s, n, c in vp8l.canonical(own)}
        if sum(map(bool, own)) == 1:
            words = {s: (0, 0) for s in words}
        for x in lengths:
            self.put(*words[x])
        return {s: (c, n) for s, n, c in vp8l.canonical(lengths)}

    def picture(self, items, cache_bits=0, main=False):
        """items: ('p', a, r, g, b), ('c', cache index) or ('b', length, distance code)."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        size = 280 + (1 << cache_bits if cache_bits else 0)
        count = [[0] * size, [0] * 256, [0] * 256, [0] * 256, [0] * 40]

        def number(v):  # symbol, extra value, extra bits
            for s in range(40):
                extra = max(0, (s - 2) >> 1)
                low = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + 1
                if low <= v < low + (1 << extra):
                    return s, v - low, extra

        for it in items:
            if it[0] == "p":
                for k, v in zip((3, 1, 0, 2), it[1:], strict=True):
                    count[k][v] += 1
            elif it[0] == "c":
                count[0][280 + it[1]] += 1
            else:
                count[0][256 + number(it[1])[0]] += 1
                count[4][number(it[2])[0]] += 1
        codes = [self.code([n or 0 for n in (vp8l.huffman(c) if sum(map(bool, c)) > 1 else [1 if (x or not any(c) and i == 0) else 0 for i, x in enumerate(c)])]) for c in count]
        for it in items:
            if it[0] == "p":
                for k, v in ((0, it[3]), (1, it[2]), (2, it[4]), (3, it[1])):
                    self.put(*codes[k][v])
            elif it[0] == "c":
                self.put(*codes[0][280 + it[1]])
            else:
                for k, base, v in ((0, 256, it[1]), (4, 0, it[2])):
                    s, extra, bits = number(v)
                    self.put(*codes[k][base + s])
                    self.put(extra, bits)

    def file(self):
        body = self.v.to_bytes(self.n // 8 + 1, "little")
        body += bytes(len(body) & 1)
        return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def start(width, height):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def literal(px):
    return [("p", *map(int, p)) for p in px]


def test_copies_and_colour_cache():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (8, 4), dtype=np.uint8)
    w = start(8, 4)
    w.put(0, 1)
    index = (vp8l.CACHE_FACTOR * int.from_bytes(base[3].tobytes(), "big") & 0xFFFFFFFF) >> (32 - 6)
    w.picture([*literal(base), ("b", 8, 1), ("c", index), ("b", 7, 2), ("b", 8, 120 + 16)], 6, True)
    width, height, px = vp8l.decode(w.file())
    want = [*base, *base]  # distance code 1 is the row above
    want.append(base[3])
    want += [base[3]] * 7  # distance code 2 is the pixel to the left
    want += want[8:16]
    assert (width, height) == (8, 4) and (px == np.array(want)).all()


def forward_predict(px, width, height, modes, block):
    p = px.astype(int).reshape(height, width, 4)
    out = p.copy()
    flat, res = p.reshape(-1, 4), out.reshape(-1, 4)
    wide = -(-width // (1 << block))
    for y in range(height):
        for x in range(width):
            i = y * width + x
            guess = np.array([255, 0, 0, 0]) if i == 0 else flat[i - 1] if y == 0 else flat[i - width] if x == 0 else vp8l._predict(int(modes[(y >> block) * wide + (x >> block)]), flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])
            res[i] = (flat[i] - guess) & 255
    return res


def test_transforms_are_inverted():
    rng = np.random.default_rng(5)
    width, height, block = 13, 11, 2
    px = (np.cumsum(rng.integers(-9, 10, (width * height, 4)), 0) & 255).astype(np.uint8)
    wide, tall = -(-width // 4), -(-height // 4)
    modes = rng.permutation(np.arange(wide * tall) % 14)
    factors = rng.integers(0, 256, (wide * tall, 4))
    y, x = np.divmod(np.arange(width * height), width)
    at = (y >> block) * wide + (x >> block)
    sign = lambda v: ((np.asarray(v) & 255) ^ 128) - 128
    # the encoder's order: predictor, then cross-colour, then subtract green; the decoder undoes them backwards
    a = forward_predict(px, width, height, modes, block)
    b = a.copy()
    b[:, 3] = (a[:, 3] - (sign(factors[at, 2]) * sign(a[:, 2]) >> 5) - (sign(factors[at, 1]) * sign(a[:, 1]) >> 5)) & 255
    b[:, 1] = (a[:, 1] - (sign(factors[at, 3]) * sign(a[:, 2]) >> 5)) & 255
    c = b.copy()
    c[:, 1], c[:, 3] = (b[:, 1] - b[:, 2]) & 255, (b[:, 3] - b[:, 2]) & 255
    w = start(width, height)
    w.put(1, 1), w.put(0, 2), w.put(block - 2, 3)
    w.picture(literal(np.stack([np.full_like(modes, 255), modes * 0, modes, modes * 0], 1)))
    w.put(1, 1), w.put(1, 2), w.put(block - 2, 3)
    w.picture(literal(factors))
    w.put(1, 1), w.put(2, 2)
    w.put(0, 1)
    w.picture(literal(c), main=True)
    assert (vp8l.decode(w.file())[2] == px).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    width, height = 11, 5
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    index = rng.integers(0, colours, (height, width))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, bits = 1 << packed, 8 >> packed
    cells = np.zeros((height, -(-width // per)), int)
    for i in range(width):
        cells[:, i // per] |= index[:, i] << (i % per * bits)
    w = start(width, height)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    w.picture(literal(np.diff(table.astype(int), axis=0, prepend=0) & 255))
    w.put(0, 1)
    w.picture([("p", 255, 0, int(g), 0) for g in cells.ravel()], main=True)
    assert (vp8l.decode(w.file())[2] == table[index.ravel()]).all()


def test_stored_pictures_use_the_format_where_it_shrinks_them(monkeypatch):
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(97, 123, 256, dtype=np.uint8))
    noise = rng.integers(0, 256, (1600, 4), dtype=np.uint8)
    green = rng.integers(0, 256, (1600, 1))
    slope = ((np.arange(64)[None] * 3 + np.arange(100)[:, None] * 5) & 255).astype(np.uint8).tobytes()
    used = []
    for name in ("_unindex", "_unpredict", "_uncross"):
        real = getattr(vp8l, name)
        monkeypatch.setattr(vp8l, name, lambda *a, real=real, name=name: used.append(name) or real(*a))

    def stored(payload, most):
        file = media.store(payload)
        assert media.load(file, len(payload))[2] == payload and len(file) < most
        return file

    stored(line * 20, 500)  # copies
    stored(noise[rng.integers(0, 40, 1600)].tobytes(), 1700)
    assert "_unindex" in used
    stored(slope, 400)
    assert "_unpredict" in used
    stored(np.concatenate([green, noise[:, :1], ((green.astype(np.uint8).view(np.int8).astype(int) * 24 >> 5) + rng.integers(0, 4, (1600, 1))) & 255, noise[:, 1:2] & 3], 1).astype(np.uint8).tobytes(), 4700)
    assert "_uncross" in used
    stored(noise.tobytes(), 6900)


def test_documents_are_smaller_than_by_a_fixed_code(spark, data):
    for r in media.op8_media(spark, data).collect():
        assert r.media_bytes < 0.7 * r.payload_bytes + 150


def test_broken_files_are_refused():
    good = media.store(bytes(range(64)))
    for bad in (b"", b"RIFF", good[:12], good[:40], good[:-20], good[:20] + b"\0" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            vp8l.decode(bad)


# --- URLs -----------------------------------------------------------------------------------------------------------


def test_url_filter(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    same(urlfilter.op9_url_filter(spark, data), con.execute(urlfilter.ORACLE).fetchall())


def test_url_filter_odd(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://x.Example.COM/en/1", "http://www.example.com/en/?q#f", "http://a.www.example.com/en/", "http://xexample.com/en/", "s://net?x=/es/", "s://a.net/es/x#y", "s://.net/fr/", "http://ÀB.net/fr/", "http://a.net/fr", "http://a.net\n/fr/x"]
    pages = spark.createDataFrame([(i % 9, u) for i, u in enumerate(urls * 2)], "page_id long, url string").withColumn("key", F.lit(0)).withColumn("host", F.lit("h"))
    got = rows_of(urlfilter.filter_urls(pages, urlfilter.rule_table(spark, urlfilter.RULES)))
    low = str.maketrans(urlfilter.UPPER, urlfilter.LOWER)
    want = []
    for i, u in enumerate(urls * 2):
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].translate(low), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(len(h + p), v, h + p) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        want.append((i % 9, host, path, best[2], best[1]))
    assert got == sorted(want, key=str)
    same(urlfilter.filter_urls(pages, urlfilter.rule_table(spark, urlfilter.RULES), broadcast_rules=0), want)
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


# --- archives -------------------------------------------------------------------------------------------------------


def test_warc(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    same(warc.op10_warc(spark, data), warc.brute_force([(r.page_id, r.html) for r in pages.collect()]))
    capture = warc.write_archives(pages)
    one = pages.first()
    assert any(p.decode() == one["html"] and h["x-page-key"] == str(one["page_id"]) for h, p in capture.lookup(one["url"]))
    warc.export(capture, f"file://{tmp_path}")
    import gzip

    files = list(tmp_path.glob("*.warc.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == pages.count()


@pytest.mark.parametrize(("hot", "lines"), [(1, 3000), (1000, 1), (2, 2)])
def test_warc_odd(spark, hot, lines):
    rows = [(1, "http://a.b/x", "q"), (2, "http://a.b/x", "q"), (2, "http://a.b/x", "q"), (None, None, None), (5, "u\nv://É.x/\r", ""), (6, "http://a.b", None), (7, "http://b.a/x", "é" * 50_000), (1, "http://c.d", "q"), (8, "http://a.b/" + "y" * 90, "z"), (9, "http://a.b/" + "y" * 91, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("sha", F.lit("s"))
    capture = warc.write_archives(pages, hot=hot, block_lines=lines)
    got = sorted(((r["key"] and int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers"] and int(r["refers"])) for r in capture.read(pages.select("url")).collect()), key=str)
    assert got == sorted(warc.brute_force([(r[0], r[2]) for r in rows]), key=str)
    assert sorted(h["x-page-key"] for h, _ in capture.lookup("http://a.b/x")) == ["1", "2", "2"]
    assert [h["x-page-key"] for h, _ in capture.lookup(rows[8][1])] == ["8"]
    assert capture.lookup("http://zz.zz/") == [] and capture.lookup("") is not None
    none = warc.write_archives(pages.where("false"))
    assert none.read(pages.select("url")).count() == 0


def test_warc_text_keys_come_back(spark):
    pages = spark.createDataFrame([("a %41 é", "http://x.y/1", "p"), ("b", "http://x.y/2", "p")], "page_id string, url string, html string")
    got = {(r["key"], r["refers"]) for r in warc.write_archives(pages).read(pages.select("url")).collect()}
    assert got == {("a %41 é", None), ("b", "a %41 é")}


def test_warc_leaves_archives_in_place(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    plan = warc.write_archives(pages).read(pages.select("url"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan
