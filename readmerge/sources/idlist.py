"""Lists of read identifiers: one header a line, with or without ``@``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import seqid


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct identifiers (column ``id``); lines that are no header are left out."""
    line = F.regexp_replace(F.col("value"), "^@", "")
    return spark.read.text(path).select(seqid.parse(line, "optional")["id"].alias("id")).where("id is not null").distinct()
