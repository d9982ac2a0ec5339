"""Assembly of streams.  It has no state, so it runs in append mode without a watermark.

The modules ``after`` and ``before`` have one: where the marked pair came.  Pairs are dealt over ``SPREAD`` keys by their ordinals and the marked
pair is sent to all of them, so each key keeps one number and the stream isn't drawn into one task.  A batch is judged by the least
ordinal of the mark in it or in any batch before; for input in order this is what a table has.  Pairs of earlier batches that belong behind a mark
that comes late have been judged without it: ``after`` has rejected them, ``before`` has let them pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import filters
from ..operators.assemble import assemble
from ..operators.config import AssemblerConfig


def read_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Pairs from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Keys that pairs are dealt over for a module that looks at a mark.
SPREAD = 64


class _Mark(StatefulProcessor):
    """Adds ``_mark``, the least ordinal of the marked pair so far, to each row; rows that only carry the mark go."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.least = handle.getValueState("least", StructType([StructField("ordinal", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]  # the rows of one key in one batch
        marks = [int(p["ordinal"][p["is_mark"]].min()) for p in parts if p["is_mark"].any()]
        if self.least.exists():
            marks.append(self.least.get()[0])
        if marks:
            self.least.update((min(marks),))
        for p in parts:
            p = p[~p["is_copy"]]
            yield p[self.columns].assign(mark_at=pd.array([min(marks) if marks else None] * len(p), dtype="Int64"))

    def close(self) -> None:
        pass


def with_mark(pairs: DataFrame, header: str, spread: int = SPREAD) -> DataFrame:
    """Add ``_mark`` to a stream of pairs: the ordinal of the marked pair, null until it comes.  The state needs RocksDB, which is set if nothing is."""
    conf, name = pairs.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name, ""):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = F.pmod(F.xxhash64("ordinal"), F.lit(spread)).cast("int")
    marked = F.coalesce(filters.is_marker(header), F.lit(False))
    keys = F.when(marked, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(own))
    rows = pairs.select("*", marked.alias("is_mark"), own.alias("own_key"), F.explode(keys).alias("mark_key"))
    rows = rows.withColumn("is_copy", F.col("mark_key") != F.col("own_key")).drop("own_key")
    shape = StructType([*pairs.schema.fields, StructField("mark_at", LongType())])  # names that begin with "_" would be changed on the way
    return rows.groupBy("mark_key").transformWithStateInPandas(_Mark(pairs.columns), shape, "Append", "None").withColumnRenamed("mark_at", "_mark")


def assemble_stream(pairs: DataFrame, cfg: AssemblerConfig | None = None) -> DataFrame:
    """Merge a stream of pairs."""
    cfg = cfg or AssemblerConfig()
    modules, done = [], 0
    for m in cfg.modules:
        if m.marker is not None:
            mark = f"_mark_{done}"
            pairs, done = with_mark(pairs, m.marker).withColumnRenamed("_mark", mark), done + 1
            keep = F.coalesce(F.col("ordinal") >= F.col(mark), F.lit(False)) if m.name == "after" else F.coalesce(F.col("ordinal") < F.col(mark), F.lit(True))
            m = replace(m, apply=lambda df, keep=keep: (df, keep))
        modules.append(m)
    return assemble(pairs, replace(cfg, modules=tuple(modules)))


def pair_streams(forward: DataFrame, reverse: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Join streams of single reads (id, ts, ordinal, seq, qual) into pairs; the watermark bounds what waits."""
    f = forward.withWatermark("ts", delay).select(F.col("id"), F.col("ts"), "ordinal", F.col("seq").alias("f_seq"), F.col("qual").alias("f_qual"))
    r = reverse.withWatermark("ts", delay).select(F.col("id").alias("r_id"), F.col("ts").alias("r_ts"), F.col("seq").alias("r_seq"), F.col("qual").alias("r_qual"))
    near = F.expr(f"r_ts BETWEEN ts - INTERVAL {delay} AND ts + INTERVAL {delay}")
    return f.join(r, (F.col("id") == F.col("r_id")) & near).select("ordinal", "id", "f_seq", "f_qual", "r_seq", "r_qual")


def running_stats(result: DataFrame) -> DataFrame:
    """Counts by status, for complete or update mode."""
    return result.groupBy("status").agg(F.count("*").alias("n"))
