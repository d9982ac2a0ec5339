"""Counters and histograms over assembled rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, functions as F

from ..functions.phred import index_of


def stat_counts(result: DataFrame) -> DataFrame:
    """code, value: READS, every reject, SLOW and OK.  All but READS and SLOW sum to READS."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    codes = {"READS": F.lit(True), "SLOW": F.coalesce("slow", F.lit(False))} | {s: F.col("status") == s for s in ("OK", "BADR", "NOFP", "NORP", "NOALGN", "LOWQ", "MODULE")}
    one = result.agg(*[F.coalesce(n(c), F.lit(0)).alias(k) for k, c in codes.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("value")) for k in codes])))


def reject_counts(result: DataFrame) -> DataFrame:
    """Rejects of each module, those that rejected anything."""
    return result.where("reject_module is not null").groupBy(F.col("reject_module").alias("module")).agg(F.count("*").alias("rejected"))


def _filled(counts: DataFrame, value: str, first: int) -> DataFrame:
    """A row for every value from ``first`` to the largest, 0 where nothing was counted."""
    one = counts.where(F.col(value).isNotNull()).agg(F.collect_list(F.struct(value, "n")).alias("all"))  # a row for each length; joined with itself, all would be assembled twice
    top = F.coalesce(F.array_max(F.transform("all", lambda x: x[value])), F.lit(first - 1))
    line = one.where(top >= first).select(F.map_from_entries("all").alias("all"), F.explode(F.sequence(F.lit(first), top)).alias(value))
    return line.select(value, F.coalesce(F.try_element_at("all", F.col(value)), F.lit(0)).cast("long").alias("n"))


def overlap_histogram(result: DataFrame) -> DataFrame:
    """Merged rows of each overlap, from 0 to the longest."""
    return _filled(result.where("status = 'OK'").groupBy("overlap").agg(F.count("*").alias("n")), "overlap", 0)


def examined_histogram(result: DataFrame) -> DataFrame:
    """Rows that reached the checks by overlaps examined, from 1 up."""
    reached = result.where("overlap is not null and status in ('OK', 'MODULE')")
    return _filled(reached.groupBy(F.col("overlaps_examined").alias("examined")).agg(F.count("*").alias("n")), "examined", 1)


def _line(counts: Counter, first: int) -> list[str]:
    known = {int(k): n for k, n in counts.items() if k is not None}
    return [str(known.get(i, 0)) for i in range(first, max(known, default=first) + 1)]


def log_lines(counts: dict[str, Counter], cfg) -> list[str]:
    """STAT lines of a written assembly (see sinks.write_assembly) in the order of the log.

    Counts of missing primers come only where a primer is set, those of modules only if any pair was rejected; EXAMINED only with the
    module overlap_stat.
    """
    status = counts["status"]
    out = [("READS", sum(status.values()))]
    out += [(k, status[k]) for k, primer in (("NOFP", cfg.forward_primer), ("NORP", cfg.reverse_primer)) if primer]
    out += [(k, status[k]) for k in ("NOALGN", "LOWQ", "BADR")] + [("SLOW", counts["slow"].get(True, 0))]
    out += [(m.name, counts["reject_module"][m.name]) for m in {m.name: m for m in cfg.modules}.values() if counts["reject_module"].get(m.name)]
    lines = [f"STAT\t{k}\t{n}" for k, n in [*out, ("OK", status["OK"])]]
    lines.append("STAT\tOVERLAPS\t" + " ".join(_line(counts["overlap"], 0)))
    if any(m.name == "overlap_stat" for m in cfg.modules):
        lines.append(" ".join(["STAT\tEXAMINED", *_line(counts["examined"], 1)]))
    return lines


def phred_offset_warning(pairs: DataFrame, offset: int = 33) -> DataFrame:
    """One row: the least quality character, and whether all of them suggest the other offset."""
    least = pairs.select(F.explode(F.array("f_qual", "r_qual")).alias("q")).where("length(q) > 0").select(F.array_min(F.transform(F.split("q", ""), lambda c: F.ascii(c))).alias("least"))
    return least.agg(F.min("least").alias("least")).select("least", (F.coalesce(F.col("least") >= 64, F.lit(False)) & F.lit(offset < 64)).alias("suspicious"))


def mean_quality(seqs: DataFrame, qual: str, offset: int = 33) -> DataFrame:
    """Add the mean score of a quality string."""
    scores = F.transform(F.split(qual, ""), lambda c: index_of(c, offset))
    return seqs.withColumn("mean_quality", F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.length(qual))
