"""Gapless numbers inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import scratch


def number_rows(rows: DataFrame, group: str, order: list[str], name: str, per_bucket: int = 500, most: int = 65_536) -> DataFrame:
    """Add ``name``: 0, 1, ... inside each ``group``.  The number of groups must be small (they are counted on the driver).

    A group is dealt over hash buckets of about ``per_bucket`` rows (more where all groups would have over ``most``
    buckets), buckets are counted, and rows are numbered inside their bucket after the counts of those before it.
    """
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    size = max(per_bucket, -(-total // most))
    rows = rows.join(F.broadcast(counts.select("_g", F.ceil(F.col("_n") / size).cast("long").alias("_b"))), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_b")))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(group, "_b").count().select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)))
    rows = rows.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))  # `most` rows and one for each group
    return rows.withColumn(name, (F.col("_first") + F.col("_within") - 1).cast("long")).drop("_b", "_c", "_g", "_first", "_within")


def in_order(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... inside each ``group`` in ascending ``order`` (nulls first); written once to the shared folder.

    Rows are range partitioned and sorted; the number that a row gets as it is written keeps its place for good, so only
    counts of (group, partition) are summed up afterwards.  Without ``order`` the numbers are gapless in any order.  Rows
    equal in all of ``order`` are spread by the place they are read from, and numbered in any order.
    """
    if group or order:
        keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
        rows = rows.withColumn("_spread", F.monotonically_increasing_id()).orderBy(*keys, "_spread").drop("_spread")
    rows = scratch.materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    starts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    found = rows.join(starts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return found.drop("_at", "_part", "_p", "_shift", *[f"_g_{c}" for c in group])
