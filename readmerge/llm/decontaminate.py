"""Benchmark decontamination by winnowing.

The fingerprint of a window of ``span`` words is the least of the hashes of its k-grams; a text keeps those of all its
windows.  Equal windows have equal fingerprints, so every shared window, and with it every longer shared span, meets.

1. The benchmark becomes a table of windows (fingerprint, hash of the window, set of items).  Windows that the same items
   have share one set, so the items of a line that very many items have are listed once, as rows, not for each of its windows.
   A bitmap of the fingerprints, of ``BITS`` bits a fingerprint, from ``LEAST`` to ``BITMAP`` bits, is broadcast.
2. One map over the documents winnows each text, keeps windows whose fingerprint is in the bitmap, and adds the hash of the
   whole window: a candidate of a distinct window is one row with all its places.  Texts without candidates are done.
3. Candidates are joined with the benchmark's table by fingerprint and window (128 bits).  Both sides carry a salt, so a
   passage that very many documents share is spread over ``SALTS`` tasks.  A text meets the items of each of its sets once.
4. Hits of a text are extended to maximal runs of hit words.

An item of fewer words than ``span`` is one window; its fingerprint is the least of its own k-grams (of fewer than k words:
its hash).  A larger bitmap load only sends more candidates to the join; results do not depend on it.

Defined cases: null and empty texts have no words and are clean; null or empty items are ignored; repeated rows each get a
result; equal items under several ids are all reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch, text as tx

#: Bits of the bitmap for each fingerprint, least and most bits (16 MB).
BITS, LEAST, BITMAP = 64, 1 << 24, 1 << 27
SALTS = 16
_CANDIDATES = "array<struct<h:bigint,w:bigint,size:int,starts:array<int>>>"
_RUNS = "array<struct<start:bigint,end:bigint>>"


def found(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in a sorted array of distinct values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def fingerprints(h: np.ndarray, size: int, k: int) -> np.ndarray:
    """The fingerprint of the window of ``size`` words from each word on (``h``: word hashes)."""
    return tx.slide(tx.grams(h, k), size - k + 1, np.minimum) if size > k and len(h) >= size else tx.grams(h, size)


def _windows(span: int, k: int):
    """Rows (id, h, w, size) of the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            for lo, hi in tx.slices(off):
                w = tx.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = np.diff(w.off)
                for size in sorted({min(x, span) for x in n.tolist() if x}):
                    which = np.flatnonzero(n >= size if size == span else n == size)
                    at = tx.expand(w.off[which], n[which] - size + 1)
                    item = np.repeat(which, n[which] - size + 1)
                    h, full = fingerprints(w.hash, size, k)[at], tx.grams(w.hash, size)[at]
                    _, one = np.unique(np.stack([item.astype(tx.U64), full], 1), axis=0, return_index=True)
                    ids = batch.column("id").slice(lo, hi - lo).take(pa.array(item[one]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(h[one].view(np.int64)), pa.array(full[one].view(np.int64)), pa.array(np.full(len(one), size), pa.int32())], ["id", "h", "w", "size"])

    return run


class Benchmark:
    """The benchmark's distinct windows (h, w, set), its sets of items as rows (set, id), its sizes of windows, and the bitmap of
    its fingerprints.

    A set is named by one of its windows (the least of those that the same items have).  That items are the same is told by
    their number and 120 bits: the exclusive or of digests of the ids.
    """

    def __init__(self, items: DataFrame, item_key: str, item_text: str, span: int, k: int):
        src = items.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null and id is not null")
        raw = scratch.materialize(src.mapInArrow(_windows(span, k), "id string, h long, w long, size int").distinct(), "benchmark-windows")
        half = [F.expr(f"bit_xor(cast(conv(substr(sha2(id, 256), {at}, 15), 16, 10) as long))").alias(x) for at, x in ((1, "x"), (16, "y"))]
        marked = raw.groupBy("h", "w").agg(F.count("*").alias("n"), *half)
        sets = marked.groupBy("n", "x", "y").agg(F.min(F.struct("h", "w")).alias("set"))
        self.table = scratch.materialize(marked.join(sets, ["n", "x", "y"]).select("h", "w", "set"), "benchmark-sets")
        named = self.table.where("set.h = h and set.w = w")
        self.members = scratch.materialize(raw.join(named, ["h", "w"]).select("set", "id"), "benchmark-items")
        self.sizes = sorted(r[0] for r in raw.select("size").distinct().collect())  # at most ``span`` of them
        n = self.table.select("h").distinct().count()
        self.bits = min(BITMAP, max(LEAST, 1 << (BITS * n).bit_length()))
        words = self.table.withColumn("bit", F.pmod(F.col("h"), F.lit(self.bits))).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
        got = words.toPandas()  # at most BITMAP / 64 rows
        bitmap = np.zeros(self.bits // 64, np.int64)
        bitmap[got["at"].to_numpy()] = got["bits"].to_numpy()
        self.bitmap = items.sparkSession.sparkContext.broadcast(bitmap.view(tx.U64))


def _kernel(bitmap, sizes: list[int], k: int):
    """Each row with n_words, sha (of texts with candidates, else null) and its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            for lo, hi in tx.slices(off):
                body, local = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                w = tx.words(body, local)
                doc, parts = w.doc, [np.zeros((0, 5), np.int64)]
                for size in sizes:
                    h = fingerprints(w.hash, size, k)
                    slot = h & tx.U64(64 * len(bits) - 1)
                    start = np.flatnonzero(bits[slot >> tx.U64(6)] >> (slot & tx.U64(63)) & tx.U64(1))
                    start = start[doc[start] == doc[start + size - 1]]
                    full = tx.grams(w.hash, size)[start] if len(start) else h[start]
                    parts.append(np.stack([doc[start], h[start].view(np.int64), full.view(np.int64), np.full(len(start), size), start - w.off[doc[start]]], 1))
                rows = np.concatenate(parts)
                rows = rows[np.lexsort(rows.T[::-1])]
                head = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(1)]) if len(rows) else np.zeros(0, np.int64)
                starts = pa.ListArray.from_arrays(pa.array(np.append(head, len(rows)), pa.int32()), pa.array(rows[:, 4], pa.int32()))
                fields = [pa.array(rows[head, 1]), pa.array(rows[head, 2]), pa.array(rows[head, 3], pa.int32()), starts]
                at = np.searchsorted(rows[head, 0], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["h", "w", "size", "starts"]))
                some = np.diff(at) > 0
                sha = [hashlib.sha256(body[a:b]).digest() if x else None for a, b, x in zip(local[:-1].tolist(), local[1:].tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(np.diff(w.off), pa.int64()), pa.array(sha, pa.binary()), lists], ["key", "n_words", "sha", "candidates"])

    return run


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text (arrays of start and size) joined to maximal runs."""
    for batch in batches:
        lists = batch.column("windows")
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        inner = lists.flatten()
        starts = inner.field("starts")
        many = np.diff(starts.offsets.to_numpy())
        row, size = np.repeat(row, many), np.repeat(inner.field("size").to_numpy(), many).astype(np.int64)
        start = starts.flatten().to_numpy().astype(np.int64)
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], (start + size)[order]
        base = row * (int(end.max(initial=0)) + 2)  # rows apart, so that one running maximum serves all
        top = np.maximum.accumulate(end + base)
        new = np.r_[True, start[1:] + base[1:] > top[:-1]] if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        fields = [pa.array(start[first]), pa.array(top[last] - base[last])]
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(batch) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column("sha"), runs], ["sha", "runs"])


def _marked(rows: DataFrame, bench: Benchmark, k: int) -> DataFrame:
    """``rows`` (key, text) as key, n_words, sha, candidates."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_kernel(bench.bitmap, bench.sizes, k), f"key {kind}, n_words long, sha binary, candidates {_CANDIDATES}")


def _over_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _met(marked: DataFrame, bench: Benchmark) -> DataFrame:
    """sha, size, starts, set, salt of each window that a text shares with items."""
    each = marked.where("size(candidates) > 0").select("sha", F.inline("candidates")).dropDuplicates(["sha", "h", "w"])
    each = each.withColumn("salt", F.pmod(F.xxhash64("sha"), F.lit(SALTS)).cast("int"))
    return each.join(_over_salts(bench.table), ["h", "w", "salt"]).select("sha", "size", "starts", "set", "salt")


def _hits(marked: DataFrame, bench: Benchmark) -> DataFrame:
    """sha, runs, items of the texts that share windows with items."""
    met = scratch.materialize(_met(marked, bench), "met")
    runs = met.groupBy("sha").agg(F.collect_list(F.struct("size", "starts")).alias("windows")).mapInArrow(_joined_runs, f"sha binary, runs {_RUNS}")
    ids = met.select("sha", "set", "salt").distinct().join(_over_salts(bench.members), ["set", "salt"])
    return runs.join(ids.groupBy("sha").agg(F.array_sort(F.collect_set("id")).alias("items")), "sha")


def _salted(rows: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """Rows joined with hits by sha, copies of one text spread over several tasks."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return rows.withColumn("salt", salt).join(hits.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS))))), ["sha", "salt"], how)


def decontaminate(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """One row per document: ``key``, n_words, runs (array of start, end of hit words) and items (sorted item ids as strings).

    ``span``: words of a window; ``k``: words of a k-gram.
    """
    bench = Benchmark(items, item_key, item_text, span, k)
    marked = scratch.materialize(_marked(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), bench, k), "candidates")
    none = [F.array().cast(_RUNS).alias("runs"), F.array().cast("array<string>").alias("items")]
    hits = scratch.materialize(_hits(marked, bench), "hits")
    clean = marked.where("size(candidates) = 0").select("key", "n_words", *none)
    dirty = _salted(marked.where("size(candidates) > 0").select("key", "n_words", "sha"), hits, "left")
    dirty = dirty.select("key", "n_words", *(F.coalesce(F.col(c), x).alias(c) for c, x in zip(("runs", "items"), none, strict=True)))
    return clean.union(dirty).withColumnRenamed("key", key)


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result columns of op2: counts, and the digest of the items."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that share no window with any item, with all their columns.

    Rows without candidates stay where they are; the few others are written with their candidates and told apart by a join.
    Texts are winnowed twice, once for these rows and once for the others, as writing all of them would cost more.
    """
    bench = Benchmark(items, item_key, item_text, span, k)
    marked = _marked(docs.select(F.struct("*").alias("key"), F.col(text).alias("text")), bench, k)
    some = scratch.materialize(marked.where("size(candidates) > 0"), "candidates")
    hits = scratch.materialize(_met(some, bench).select("sha").distinct(), "hits")
    kept = _salted(some.select("key", "sha"), hits, "left_anti").select("key")
    return marked.where("size(candidates) = 0").select("key").union(kept).select("key.*")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest_columns(decontaminate(docs, items))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT id, least(len(ws), 10) AS size, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT n, size, i, array_to_string(ws[i : i + size - 1], ' ') AS w
  FROM (SELECT n, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
met AS (SELECT n, size, i, id FROM places JOIN windows USING (size, w)),
hit AS (SELECT n, count(DISTINCT word) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT n, size, i FROM met)) GROUP BY n),
ids AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT n, id FROM met) GROUP BY n)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN ids USING (n)
"""


def brute_force(docs: list[tuple], items: list[tuple], span: int = 10) -> list[tuple]:
    """The same result by plain loops, for tests."""
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own = [(str(i), split(t)) for i, t in items]
    out = []
    for d, t in docs:
        ws, hit, ids = split(t), set(), set()
        for i, iw in own:
            m = min(span, len(iw))
            windows = {tuple(iw[j : j + m]) for j in range(len(iw) - m + 1)} if m else set()
            for j in range(len(ws) - m + 1) if m else ():
                if tuple(ws[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    ids.add(i)
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
