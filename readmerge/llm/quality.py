"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Features are counts and ratios of the whole text, computed by vectorised kernels.  Training takes at most
``max_labelled`` labelled rows (the least by hash of doc_id), bins each feature at quantiles, and boosts shallow trees
one feature at a time in turn, then small trees on pairs of features.  The sum of trees of a feature is a lookup table,
so scoring adds one table entry for each feature and pair.

Defined cases: null and empty texts score as texts without words; labels that are null, or whose document is missing,
are ignored; contradicting labels of a document count as 1 if at least half say so; with labels of one kind only, or
none, the score is the smoothed base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx

FEATURES = (
    "log_bytes", "log_words", "word_len", "word_len_dev", "upper", "digit", "space", "newline", "high_bytes", "exclaim", "symbol", "bar",
    "stop_punct", "bytes_per_line", "distinct_words", "repeat_next", "repeat_line", "one_char_words", "long_words", "capital_start", "mid_capitals", "markup", "at_url", "symbol_words",
)


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars.encode())] = True
    return m


_MASKS = {
    "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _mask("0123456789"), "space": _mask(" \t\r"), "newline": _mask("\n"), "exclaim": _mask("!?"),
    "symbol": _mask("#$%&*+=^~_\\"), "bar": _mask("|"), "stop_punct": _mask(".,;:"), "markup": _mask("<>{}[]"), "at_url": _mask("@/"),
}
_MASKS["high_bytes"] = np.arange(256) >= 128


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    n = len(off) - 1
    size = np.diff(off).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return c[edges[1:]] - c[edges[:-1]]

    def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        keys = np.sort((doc.astype(tx.U64) << tx.U64(44)) | (h >> tx.U64(20)))  # a slice has far fewer than 2**20 texts of two words
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return np.bincount((keys[first] >> tx.U64(44)).astype(np.int64), minlength=n).astype(float)

    out = {k: per_text(m[buf]) / np.maximum(size, 1) for k, m in _MASKS.items()}
    w = tx.words(buf, off, tx.NONSPACE)
    nw = np.diff(w.off).astype(float)
    some = np.maximum(nw, 1)
    lens = (w.end - w.start).astype(float)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(nw)
    out["word_len"] = sums(lens, w.off) / some
    out["word_len_dev"] = np.sqrt(np.maximum(sums(lens * lens, w.off) / some - out["word_len"] ** 2, 0))
    lines = per_text(buf == 10) + 1
    out["bytes_per_line"] = np.log1p(size / lines)
    doc = w.doc
    out["distinct_words"] = distinct(doc, w.hash) / some
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    out["repeat_next"] = sums(same, w.off) / some
    out["one_char_words"], out["long_words"] = sums(lens == 1, w.off) / some, sums(lens > 20, w.off) / some
    upper = _MASKS["upper"]
    head, last = (upper[buf[w.start]], buf[w.end - 1]) if len(doc) else (same, same)
    out["capital_start"] = sums(head, w.off) / some
    out["mid_capitals"] = np.maximum(out["upper"] * size - sums(head, w.off), 0) / np.maximum(size, 1)
    out["symbol_words"] = sums((_MASKS["symbol"] | _MASKS["exclaim"])[last] if len(doc) else same, w.off) / some
    nl = buf == 10
    filled = tx.words(buf, off, ~_MASKS["newline"])
    out["repeat_line"] = 1 - distinct(filled.doc, filled.hash) / np.maximum(np.diff(filled.off), 1) if nl.any() else np.zeros(n)
    out["repeat_line"] = np.where(np.diff(filled.off) > 0, out["repeat_line"], 0.0)
    return np.stack([out[k] for k in FEATURES], 1)


@dataclass
class Model:
    """Intercept, bin edges of each feature, and lookup tables of features and of pairs."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Steps of a shallow tree on one binned feature: best-gain splits of ranges of bins, up to ``leaves`` leaves."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], i, int(cut[k]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return step


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 8, rounds: int = 200, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, smooth: float = 5.0) -> Model:
    """Cyclic boosting of 3-leaf trees over the features in turn, then of pair tables over the most useful pairs."""
    if not len(y):
        return Model(0.0)
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    n, m = x.shape
    model.edges = [_quantile_edges(x[:, j], bins) for j in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(n, model.intercept)
    for _ in range(rounds):
        for j in range(m):
            q = 1 / (1 + np.exp(-z))
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], y - q, size), np.bincount(at[j], q * (1 - q), size), 3, smooth)
            model.tables[j] += step
            z += step[at[j]]
    model.pair_edges = [_quantile_edges(x[:, j], pair_bins) for j in range(m)]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    q = 1 / (1 + np.exp(-z))
    cells = {}
    for a in range(m):
        for b in range(a + 1, m):
            size = len(model.pair_edges[b]) + 1
            cell = small[a] * size + small[b]
            g, h = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
            cells[a, b] = (float((g * g / (h + smooth)).sum()), cell, size)
    for a, b in sorted(cells, key=lambda k: -cells[k][0])[:pairs]:
        model.pairs.append((a, b, np.zeros((len(model.pair_edges[a]) + 1, cells[a, b][2]))))
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            cell = cells[a, b][1]
            q = 1 / (1 + np.exp(-z))
            g, h = np.bincount(cell, y - q, table.size).reshape(table.shape), np.bincount(cell, q * (1 - q), table.size).reshape(table.shape)
            step = np.zeros(table.shape)
            rows = _tree(g.sum(1), h.sum(1), 2, smooth)  # a cut of the first feature, then one of the second in each half
            for part in np.unique(rows):
                half = rows == part
                step[half] = rate * _tree(g[half].sum(0), h[half].sum(0), 2, smooth)
            table += step
            z += step.ravel()[cell]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tx.buffer_of(batch.column("text"))
        for lo, hi in tx.slices(off):
            x = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            for lo, hi in tx.slices(off):
                s = model.value.score(features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), pa.array(s)], [*batch.schema.names[:-1], "score"])

    return run


def is_held_out(key: str = "doc_id"):
    """True for the fifth of the rows that no training sees."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000) -> Model:
    """Fit on at most ``max_labelled`` labelled documents outside the held-out fifth; of several documents with one id one counts, that with
    the least hash of its text."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~is_held_out(key))
    known = known.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = rows.groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # max_labelled rows at most
    got = rows.select("y", "text").mapInArrow(_feature_rows, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return fit(np.array([r[1] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[0] for r in got]))


def score_quality(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row, by one map."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_scores(bc), f"key {kind}, score double").withColumnRenamed("key", key)


def keep_quality(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows that score at least ``least``, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    src = src.select(*names, F.col(names[docs.columns.index(text)]).alias("text"))
    shape = ", ".join(f"c{i} {t.dataType.simpleString()}" for i, t in enumerate(docs.schema))
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_scores(bc), f"{shape}, score double").where(F.col("score") >= least).select(*names).toDF(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, train(docs, labels))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
