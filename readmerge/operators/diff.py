"""Two configurations over the same pairs, compared row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .assemble import assemble_each
from .config import AssemblerConfig

KINDS = ("same", "gained", "lost", "length", "nt", "better", "worse", "both_fail")


def compare(control: DataFrame, experiment: DataFrame) -> DataFrame:
    """ordinal, kind, and differing bases, from two assembled tables.

    ``kind``: both_fail, gained or lost; of rows merged twice, length or nt (changed bases), else better or worse by
    quality, else same.
    """
    cols = ("status", "sequence", "quality")
    a = control.select("ordinal", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = experiment.select("ordinal", *[F.col(c).alias(f"b_{c}") for c in cols])
    kind, changed = _kind_and_changes()
    return a.join(b, "ordinal", "full_outer").select("ordinal", kind.alias("kind"), changed.alias("changed_bases"))


def _kind_and_changes() -> tuple[Column, Column]:
    in_a, in_b = F.coalesce(F.col("a_status") == "OK", F.lit(False)), F.coalesce(F.col("b_status") == "OK", F.lit(False))
    kind = (
        F.when(~in_a & ~in_b, "both_fail").when(~in_a, "gained").when(~in_b, "lost")
        .when(F.length("a_sequence") != F.length("b_sequence"), "length").when(F.col("a_sequence") != F.col("b_sequence"), "nt")
        .when(F.col("b_quality") > F.col("a_quality"), "better").when(F.col("b_quality") < F.col("a_quality"), "worse").otherwise("same")
    )
    pairs = F.arrays_zip(F.split("a_sequence", "").alias("x"), F.split("b_sequence", "").alias("y"))
    changed = F.when(kind == "nt", F.size(F.filter(pairs, lambda p: p["x"] != p["y"]))).cast("long")
    return kind, changed


def diff(pairs: DataFrame, control: AssemblerConfig, experiment: AssemblerConfig) -> DataFrame:
    """Compare two configurations over pairs: each pair is read once, assembled twice and compared where it is."""
    both = assemble_each(pairs, {"a": control, "b": experiment})
    kind, changed = _kind_and_changes()
    return both.select("ordinal", *[F.col(s)[c].alias(f"{s}_{c}") for s in "ab" for c in ("status", "sequence", "quality")]).select("ordinal", kind.alias("kind"), changed.alias("changed_bases"))


def diff_summary(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda *k: F.coalesce(F.sum(F.when(F.col("kind").isin(*k), 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("total"), n("better").alias("better"), n("worse").alias("worse"), n("length", "nt").alias("changed"), n("gained").alias("gained"), n("lost").alias("lost"), n("same", "both_fail").alias("equal"))
