"""Sharding of documents into contiguous ranges of near-equal size: the minimax partition.

Groups (equal texts) are atomic and ordered by the SHA-256 of their text.  The smallest feasible capacity is found by
binary search, each candidate checked greedily against sums of digest ranges; ranges in which a cut falls are split
further with a Spark job, so the driver holds sums of a few thousand ranges, never the groups.  Documents then find
their shard by comparing their own digest with the cuts: no join, and a hot text moves nothing.

A group larger than an equal share of what is left gets a shard of its own (at most ``n_shards - 1`` of them), else it
would set the capacity of all others.

Defined cases: a null text counts as empty (size 1); with fewer groups than shards the last shards stay empty; an empty
table gives no rows; repeated rows get slots of their own; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .numbering import number_rows

DIGITS = 3  # hex digits by which a range is split: 4096 parts


class Ranges:
    """Sums of consecutive digest ranges, refined on demand.  ``fetch(prefixes)`` -> rows (prefix, mass, groups)."""

    def __init__(self, fetch):
        self.fetch = fetch
        self.set(sorted((r[0], int(r[1]), int(r[2])) for r in fetch([""])))

    def set(self, rows):
        self.rows = rows
        self.sum = np.concatenate([[0], np.cumsum([r[1] for r in rows], dtype=np.int64)]) if rows else np.zeros(1, np.int64)
        self.single = np.array([r[2] == 1 for r in rows], bool)

    def split(self, which: list[int]) -> None:
        names = [self.rows[i][0] for i in which]
        gone = set(which)
        self.set(sorted([r for i, r in enumerate(self.rows) if i not in gone] + [(r[0], int(r[1]), int(r[2])) for r in self.fetch(names)]))

    def greedy(self, capacity: int, n: int) -> list[int] | None | set[int]:
        """Places of the cuts; None if it takes more than n shards; or the ranges that must be split to tell."""
        start, cuts = 0, []
        for _ in range(n):
            i = int(np.searchsorted(self.sum, start + capacity, "right")) - 1
            if i >= len(self.rows):
                return cuts
            if not self.single[i]:
                return self.unsure(capacity, capacity, n)
            start = self.sum[i]
            cuts.append(i)
        return None

    def unsure(self, low: int, high: int, n: int) -> set[int]:
        """All ranges in which a cut may fall for some capacity from low to high."""
        a = b = 0
        out: set[int] = set()
        for _ in range(n):
            i = int(np.searchsorted(self.sum, a + low, "right")) - 1
            j = int(np.searchsorted(self.sum, b + high, "right")) - 1
            out |= {x for x in range(i, min(j + 1, len(self.rows))) if not self.single[x]}
            if i >= len(self.rows):
                break
            a, b = int(self.sum[i]), int(min(b + high, self.sum[-1]))
        return out


def minimax_cuts(ranges: Ranges, n: int, largest: int) -> tuple[int, list[str]]:
    """The smallest capacity for n shards and the digests' lower bounds where shards 1, 2, ... begin."""
    total = int(ranges.sum[-1])
    low = max(largest, -(-total // n))
    high = low + largest
    if len(wide := ranges.unsure(low, high, n)) <= 2048 and wide:
        ranges.split(sorted(wide))
    while low < high:
        mid = (low + high) // 2
        got = ranges.greedy(mid, n)
        if isinstance(got, set):
            ranges.split(sorted(got))
        elif got is None:
            low = mid + 1
        else:
            high = mid
    while isinstance(got := ranges.greedy(low, n), set):
        ranges.split(sorted(got))
    return low, [ranges.rows[i][0] for i in got]


def shard_by_bytes(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, digest, shard and slot (gapless in each shard) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.sha2(body, 256).alias("digest"))
    rows = scratch.materialize(rows, "shard-rows")
    groups = scratch.materialize(rows.groupBy("digest").agg(F.sum("size").alias("mass"), F.count("*").alias("n")), "shard-groups")

    total = groups.agg(F.sum("mass")).first()[0] or 0
    left, alone = n_shards, []
    for g in groups.orderBy(F.desc("mass"), "digest").limit(n_shards).collect():
        if left == 1 or g["mass"] * left < total or g["mass"] == total:
            largest = int(g["mass"])
            break
        alone.append(g["digest"])
        total, left = total - g["mass"], left - 1
    else:
        largest = 0
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups

    def fetch(prefixes: list[str]):
        out = []
        for size in {len(p) for p in prefixes}:
            own = [p for p in prefixes if len(p) == size]
            some = rest.where(F.substring("digest", 1, size).isin(own)) if size else rest
            out += some.groupBy(F.substring("digest", 1, size + DIGITS)).agg(F.sum("mass"), F.count("*")).collect()
        return out

    cuts = minimax_cuts(Ranges(fetch), left, largest)[1] if total else []
    shard = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i, d in enumerate(alone):
        shard = F.when(F.col("digest") == d, left + i).otherwise(shard)
    return number_rows(rows.withColumn("shard", shard.cast("int")), "shard", ["key", "digest"], "slot").withColumnRenamed("key", key)


def op1_shard(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute_capacity(masses: list[int], n: int) -> int:
    """The least capacity by exact dynamic search over ordered masses, for tests."""
    low, high = max(masses, default=0), sum(masses)
    sums = np.cumsum([0, *masses]).tolist()
    while low < high:
        mid, used, i = (low + high) // 2, 0, 0
        while i < len(masses) and used <= n:
            i, used = bisect_left(sums, sums[i] + mid + 1) - 1, used + 1
        low, high = (low, mid) if used <= n and i >= len(masses) else (mid + 1, high)
    return low
