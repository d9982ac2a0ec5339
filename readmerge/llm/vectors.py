"""Near duplicates among vectors: Euclidean p-stable hashing in several tables, then exact cosines.

Normalised vectors with a cosine of at least c lie within sqrt(2 - 2c) of each other.  A table joins ``projections`` values
floor((a.x + b) / width), a of normal numbers, b uniform, to a bucket.  Two vectors at distance d share one value with probability
p(d) = 1 - 2 N(-width/d) - 2d / (sqrt(2 pi) width) (1 - exp(-width^2 / 2 d^2)), a bucket with p(d)^projections.  With the values
given, a pair at a cosine of exactly 0.98 is missed by all 28 tables once in 5,300 times, one at 0.99 once in 6 million; two
unrelated vectors share a bucket of one table once in 100,000 times (more ``projections`` and ``tables`` for more rows).

Equal vectors of a label are one entry, however many rows have them.  Entries of buckets that hold one vector only are dropped
before any vector moves.  A bucket is cut into blocks of about ``block`` vectors, and each pair of blocks is a group of its own,
so no task has more than two blocks at once, whatever a bucket holds.  A pair belongs to the first table that brings it
together; a group returns the number of links of each of its vectors and a star for each of its parts, never its pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, links with
nothing; vectors of different length never link; -0.0 counts as 0.0; rows with the same key are rows of their own, and a null
key counts as no id (a component without any id has none, its rows aren't kept); an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import scratch, text as tx
from .components import components

#: Vectors hashed at once.
CHUNK = 2048


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers, and not all zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _matrix(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs: places and vectors in double precision."""
    values = np.asarray(col.flatten(), np.float64)
    size = np.asarray(col.value_lengths(), np.int64)
    first = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, values[first[at][:, None] + np.arange(n)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares that overflow nor such that vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(tables: int, projections: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            label = batch.column("label_hash").to_numpy().view(tx.U64)
            out = np.zeros((len(label), tables), tx.U64)
            for at, x in _matrix(batch.column("x")):
                d = x.shape[1]
                if d not in planes:
                    g = np.random.default_rng([seed, d])
                    planes[d] = g.standard_normal((d, tables * projections)), g.uniform(0, width, tables * projections)
                a, b = planes[d]
                for i in range(0, len(at), CHUNK):
                    part = at[i : i + CHUNK]
                    cell = np.floor((unit(x[i : i + CHUNK]) @ a + b) / width).astype(np.int64).reshape(len(part), tables, projections)
                    h = tx.splitmix(label[part][:, None] ^ tx.splitmix(np.arange(tables) + (d << 20)))
                    for j in range(projections):
                        h = tx.splitmix(h ^ cell[:, :, j].view(tx.U64))
                    out[part] = h
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "keys"])

    return run


def parts(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member that each of n places reaches over the links p-q."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[p], least[q])
        np.minimum.at(least, p, low)
        np.minimum.at(least, q, low)
        least = least[least]
        if (least == before).all():
            return least


def _met(cosine: float):
    """Links inside groups (key, i, j), which come in order: block i of a bucket against block j, or against itself."""

    def group(t: pa.Table) -> pa.RecordBatch | None:
        x = np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(len(t), -1)
        u = unit(x)
        i, j, b = (t.column(c)[0].as_py() if c != "b" else t.column(c).to_numpy() for c in ("i", "j", "b"))
        if i == j:
            p, q = np.nonzero(np.triu(u @ u.T >= cosine - 1e-9, 1))
        else:
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
            p, q = np.nonzero(u[left] @ u[right].T >= cosine - 1e-9)
            p, q = left[p], right[q]
        keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(t), -1)[:, : t.column("pos")[0].as_py()]
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        own = (label[p] == label[q]) & ~(keys[p] == keys[q]).any(axis=1)  # not met in an earlier table
        p, q = p[own], q[own]
        exact = np.einsum("ij,ij->i", u[p], u[q]) >= cosine
        p, q = p[exact], q[exact]
        if not len(p):
            return None
        copies, links = t.column("copies").to_numpy(), np.zeros(len(t), np.int64)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        at, node = np.flatnonzero(links), t.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[parts(len(t), p, q)[at]])], ["node", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            edge = np.zeros(len(t), bool)
            for c in ("key", "i", "j"):
                v = t.column(c).to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(edge).tolist()]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if (got := group(t.slice(a, z - a))) is not None:
                    yield got
            rest = t.slice(cuts[-1])
        if rest is not None and len(rest) and (got := group(rest)) is not None:
            yield got

    return run


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, tables: int = 28, projections: int = 16, width: float = 2.0, block: int = 256, seed: int = 11) -> DataFrame:
    """key, n_links (rows linked directly), component_id (least key reachable by links) and kept (key = component_id) of every row."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    src = rows.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("x"))
    src = src.withColumn("x", F.transform("x", lambda c: c + F.lit(0.0).cast(kind)))
    digest = F.when(F.col("label").isNotNull() & usable(F.col("x")), F.unhex(F.sha2(F.concat_ws("|", F.col("label"), F.col("x").cast("array<string>")), 256)))
    src = src.withColumn("digest", digest)
    members = scratch.materialize(src.select("key", "digest"), "members")
    classes = src.where("digest is not null").groupBy("digest", "label", "x").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    classes = classes.select("digest", "label", "x", "least", "copies", F.xxhash64("label").alias("label_hash"))
    shape = StructType([*classes.schema.fields, StructField("keys", ArrayType(LongType()))])
    classes = classes.mapInArrow(_keys(tables, projections, width, seed), shape).drop("label_hash")
    classes = scratch.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    entries = classes.select("node", F.posexplode("keys").alias("pos", "key"))
    crowded = entries.groupBy("key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    placed = entries.join(crowded, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = placed.join(classes.select("node", "label", "x", "copies", "keys"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    full = full.select("*", other).select("key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "pos", "node", "label", "x", "copies", "keys")
    met = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_met(cosine), "node long, links long, peer long")
    met = scratch.materialize(met, "met")

    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "member")
    linked = roots.join(classes.select("node", "least"), F.col("member") == F.col("node")).select("member", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("id"))
    linked = scratch.materialize(linked.select("member", "root").join(ids, "root").join(links, F.col("member") == F.col("node")).select("member", "id", "links"), "linked")
    told = classes.select("digest", "node", "least", "copies").join(linked, F.col("node") == F.col("member"), "left")
    several = told.where("copies > 1 or links is not null").select(
        F.col("digest").alias("known"), F.when(F.col("links").isNotNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = F.col("n_links").isNull()
    found = members.join(several, F.col("digest") == F.col("known"), "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("key")).otherwise(F.col("component_id")).cast("long").alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.n AS a, b.n AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.n <> b.n WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT n AS a, n AS b FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN good ON n = b GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM good JOIN least ON least.a = n LEFT JOIN degree ON degree.a = n
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false)
"""


def brute_force(rows: list[tuple], cosine: float = 0.98) -> list[tuple]:
    """The rows of op11 for (vec_id, vector, label) by all cosines, for tests."""
    good, links = {}, {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good.setdefault((label, len(v)), []).append(i)
    least = {i: i for i in range(len(rows))}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for at in good.values():
        u = unit(np.array([rows[i][1] for i in at], np.float64))
        for p, q in zip(*np.nonzero(np.triu(u @ u.T >= cosine, 1)), strict=True):
            a, b = at[p], at[q]
            links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
            least[root(a)] = root(b)
    ids: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return [(k, links.get(i, 0), ids.get(root(i)), k is not None and ids.get(root(i)) == k) for i, (k, _, _) in enumerate(rows)]
