"""FASTA and FASTQ output; Spark's commit protocol makes a write whole or absent."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import nt, seqid
from ..functions.phred import requantise_array
from .ordered import file_system, write_in_order


def fasta(result: DataFrame) -> DataFrame:
    """Merged rows as text: ``>id;probability`` and the sequence; empty sequences are left out."""
    return _merged(result).select(fasta_text().alias("value"))


def fasta_text() -> Column:
    return F.concat(_head(">"), F.lit("\n"), F.col("sequence"))


def quality_text(logp: Column | str) -> Column:
    """Log-probabilities of bases as characters (always from ``!`` up); null for null."""

    @F.arrow_udf("string")
    def quality(rows: pa.Array) -> pa.Array:
        """One look-up for the whole batch; its bytes are the strings already."""
        size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
        text = (requantise_array(np.asarray(rows.flatten(), np.float64)) + 33).astype(np.uint8)
        off = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        whole = pa.StringArray.from_buffers(len(size), off.buffers()[1], pa.py_buffer(text.tobytes()))
        return whole.take(pa.array(np.arange(len(size)), mask=rows.is_null().to_numpy(zero_copy_only=False))) if rows.null_count else whole

    return quality(logp)


def fastq_record() -> Column:
    return F.concat(_head("@"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), quality_text("logp"))


def fastq(result: DataFrame) -> DataFrame:
    """Merged rows with qualities (always from ``!`` up)."""
    return _merged(result).select(fastq_record().alias("value"))


def _merged(result: DataFrame) -> DataFrame:
    return result.where("status = 'OK' and sequence_length > 0")


def _head(mark: str) -> Column:
    return F.concat(F.lit(mark), seqid.to_string(F.col("id")), F.lit(";"), F.format_string("%.6f", F.exp("quality")))


def unaligned(result: DataFrame, with_quality: bool = False) -> DataFrame:
    """Pairs that did not align (assembled with ``keep_reads``): forward read, dash, reverse complement of the other."""
    return result.where("status = 'NOALGN'").select(unaligned_text(with_quality).alias("value"))


def unaligned_text(with_quality: bool) -> Column:
    seq = F.concat(F.col("f_seq"), F.lit("-"), nt.reverse_complement(F.col("r_seq")))
    name = seqid.to_string(F.col("id"))
    if with_quality:
        return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.col("f_qual"), F.lit("!"), F.reverse("r_qual"))
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def write_assembly(result: DataFrame, path: str, *, fastq: bool = False, unaligned: str | None = None, layout: str = "parts", compression: str = "none", in_order: bool = False) -> dict[str, Counter]:
    """Write an assembly in one pass, in order of the pairs, and return what came by the way: the counts of status, reject_module, slow, and of
    overlap and overlaps examined of merged rows.

    ``unaligned`` (fasta or fastq): the pairs that didn't align go to a second file; needs ``keep_reads``.
    """
    ok, reached = F.col("status") == "OK", F.col("overlap").isNotNull() & F.col("status").isin("OK", "MODULE")
    out = {"merged": F.when(ok & (F.col("sequence_length") > 0), fastq_record() if fastq else fasta_text())}
    if unaligned:
        out["unaligned"] = F.when(F.col("status") == "NOALGN", unaligned_text(unaligned == "fastq"))
    tally = {"status": F.col("status"), "reject_module": F.col("reject_module"), "slow": F.col("slow"), "overlap": F.when(ok, F.col("overlap")), "examined": F.when(reached, F.col("overlaps_examined"))}
    rows = result.select("ordinal", *[c.alias(k) for k, c in (out | tally).items()])
    return write_in_order(rows, path, layout=layout, compression=compression, in_order=in_order, tally=tuple(tally))


def write_text(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Write records; ``compression`` as Spark knows it (none, gzip, bzip2)."""
    rows.write.option("compression", compression).text(path)


def for_each_partition(rows: DataFrame, sink: Callable[[Iterator[Row]], None]) -> None:
    """Give the rows of each partition to a function of the caller, on the executors (run again if an executor is lost)."""
    rows.foreachPartition(sink)


def fastq_text(side: str, mate: int) -> Column:
    """A FASTQ record of a pair's read, without the last line end."""
    i = F.col("id")
    name = F.concat_ws(":", *[i[f].cast("string") for f in seqid.FIELDS[:-1]])
    return F.concat(F.lit("@"), name, F.lit(f" {mate}:N:0:"), F.coalesce(i["tag"], F.lit("")), F.lit("\n"), F.col(f"{side}_seq"), F.lit("\n+\n"), F.col(f"{side}_qual"))


def write_fastq_pairs(pairs: DataFrame, folder: str, *, layout: str = "parts", compression: str = "none", in_order: bool = False) -> tuple[list[str], list[str]]:
    """Write pairs as forward and reverse FASTQ files in order of their ordinals, both in one pass, and return their paths."""
    write_in_order(pairs.select("ordinal", fastq_text("f", 1).alias("f"), fastq_text("r", 2).alias("r")), folder, layout=layout, compression=compression, in_order=in_order)
    if layout == "single":
        return [f"{folder}/f"], [f"{folder}/r"]
    system, inner = file_system(folder)
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(f"{inner}/f")))
    return [f"{folder}/f/{n}" for n in names], [f"{folder}/r/{n}" for n in names]
