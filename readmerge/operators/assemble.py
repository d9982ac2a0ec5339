"""Assembling read pairs: one result row for each pair, with a status.

Pairs have columns ordinal, id, f_seq, f_qual, r_seq, r_qual (strings as sequenced; qualities as characters).  Reads may have
any lengths; a pair with a null or too short read, or with scores that are null or not as many as bases, gets status BADR.  Prechecks
are Columns in front of the kernel, so cheap rejects never reach Python; the kernel is one Arrow map without shuffle;
checks are Columns behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import nt
from . import clip, kernel
from .config import AssemblerConfig

STATUS = ("OK", "BADR", "NOFP", "NORP", "NOALGN", "LOWQ", "MODULE")
PAIR = ("ordinal", "id", "f_seq", "f_qual", "r_seq", "r_qual")
_RESULT = [
    ("status", pa.string()), ("sequence", pa.string()), ("logp", pa.list_(pa.float64())), ("quality", pa.float64()), ("sequence_length", pa.int32()),
    ("overlap", pa.int32()), ("overlap_score", pa.float64()), ("overlap_mismatches", pa.int32()), ("overlaps_examined", pa.int32()), ("degenerates", pa.int32()),
    ("forward_offset", pa.int32()), ("reverse_offset", pa.int32()), ("slow", pa.bool_()),
]
RESULT = tuple(k for k, _ in _RESULT)
RESULT_TYPE = "status string, sequence string, logp array<double>, quality double, sequence_length int, overlap int, overlap_score double, overlap_mismatches int, overlaps_examined int, degenerates int, forward_offset int, reverse_offset int, slow boolean"


def _reads(f_seq: pa.Array, f_qual: pa.Array, r_seq: pa.Array, r_qual: pa.Array) -> tuple[list, np.ndarray]:
    """Ranges of the four columns, and which rows have scores of their reads' lengths."""
    parts = [clip.ranges(c) for c in (f_seq, f_qual, r_seq, r_qual)]
    f, fq, r, rq = (p[2] for p in parts)
    return parts, (f >= 0) & (r >= 0) & (f == fq) & (r == rq)


def _matrices(parts: list, at: np.ndarray, phred: int) -> kernel.Reads:
    n, m = parts[0][2][at], parts[2][2][at]
    rows = [clip.padded(buf, start[at], size) for (buf, start, _), size in zip(parts, (n, n, m, m), strict=True)]
    return kernel.Reads(*clip.read_arrays(rows[0], rows[1], False, phred), *clip.read_arrays(rows[2], rows[3], True, phred), n, m)


def results(f_seq: pa.Array, f_qual: pa.Array, r_seq: pa.Array, r_qual: pa.Array, cfg: AssemblerConfig, use: np.ndarray | None = None, with_logp: bool = True) -> dict[str, pa.Array]:
    """Result columns of pairs (those not in ``use`` keep the status MODULE)."""
    parts, fine = _reads(f_seq, f_qual, r_seq, r_qual)
    n = len(fine)
    use = np.ones(n, bool) if use is None else use
    status = np.where(use, kernel.BADR, kernel.MODULE)
    numbers = {k: np.full(n, -1, np.int64) for k in ("overlap", "overlap_mismatches", "overlaps_examined", "degenerates", "forward_offset", "reverse_offset", "row")}
    score, quality, slow = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    bases, logps, sizes, made = [np.zeros(0, np.uint8)], [np.zeros(0)], [np.zeros(0, np.int64)], 0
    usable = np.flatnonzero(use & fine)
    longest = np.maximum(parts[0][2], parts[2][2])[usable]
    for part in clip.chunks(longest, kernel.CELLS):
        at = usable[part]
        got = kernel.assemble_reads(_matrices(parts, at, cfg.phred), cfg)
        status[at], slow[at] = got.status, got.slow
        for name, value in (("overlap", got.overlap), ("overlaps_examined", got.examined), ("forward_offset", got.f_off), ("reverse_offset", got.r_off)):
            numbers[name][at] = value
        score[at] = got.score
        if got.merged is not None:
            done, m = at[got.done], got.merged
            quality[done], numbers["overlap_mismatches"][done], numbers["degenerates"][done] = m.quality, m.mismatches, m.degenerates
            numbers["row"][done] = made + np.arange(len(done))
            made += len(done)
            bases.append(m.base)
            logps.append(m.logp)
            sizes.append(np.diff(m.off))
    flat, size = np.concatenate(bases), np.concatenate(sizes)
    merged_rows = numbers.pop("row")
    at = pa.array(merged_rows, mask=merged_rows < 0)
    off = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    text = pa.StringArray.from_buffers(len(size), off.buffers()[1], pa.py_buffer(nt.TO_ASCII[flat].tobytes()))
    whole = lambda v, k=pa.int32(): pa.array(v, mask=v < 0).cast(k)
    real = lambda v: pa.array(v, mask=merged_rows < 0)
    out = {k: whole(v) for k, v in numbers.items()}
    out |= {"status": pa.array(kernel.STATUS[status], pa.string()), "sequence": text.take(at), "quality": real(quality), "overlap_score": real(score), "slow": pa.array(slow, mask=numbers["overlaps_examined"] < 0)}
    out["sequence_length"] = pa.array(size, pa.int32()).take(at)
    out["logp"] = pa.ListArray.from_arrays(off, pa.array(np.concatenate(logps))).take(at) if with_logp else pa.nulls(n, pa.list_(pa.float64()))
    return out


def assemble_pair(f_seq: str, f_qual: str, r_seq: str, r_qual: str, cfg: AssemblerConfig | None = None) -> dict:
    """One pair, without Spark; keys whose value is unknown are left out."""
    out = results(*(pa.array([x], pa.string()) for x in (f_seq, f_qual, r_seq, r_qual)), cfg or AssemblerConfig())
    row = {k: v[0].as_py() for k, v in out.items()}
    return {k: np.array(v) if k == "logp" else v for k, v in row.items() if v is not None}


class _Batches:
    """The modules of some settings that see whole batches; ``_reject`` is the place of the module that rejects a pair (-1: a bad read, null: none)."""

    def __init__(self, cfg: AssemblerConfig):
        self.late, self.early = ([(i, m) for i, m in enumerate(cfg.modules) if m.batch and m.stage == stage] for stage in ("check", "precheck"))

    @staticmethod
    def _rejected(m, columns: dict[str, pa.Array], at: np.ndarray) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([columns[c].take(pa.array(at)) for c in m.columns], list(m.columns))
        keep = pa.array(m.batch(batch), pa.bool_())
        if len(keep) != len(at):
            raise ValueError(f"module {m.name} returned {len(keep)} values for {len(at)} rows")
        return at[~pc.fill_null(keep, False).to_numpy(zero_copy_only=False)]

    def before(self, columns: dict[str, pa.Array], reject: pa.Array) -> np.ndarray:
        """Places of rejecting modules, the first of all kinds; a large number for none."""
        none = np.iinfo(np.int32).max
        at = pc.fill_null(reject.cast(pa.int32()), none).to_numpy().copy()
        for i, m in self.early:
            open_rows = np.flatnonzero(at > i)
            if len(open_rows):
                at[self._rejected(m, columns, open_rows)] = i
        return at

    def behind(self, columns: dict[str, pa.Array]) -> pa.Array:
        """Places of the first rejecting modules of merged rows."""
        ok = pc.equal(columns["status"], "OK").to_numpy(zero_copy_only=False)
        at = np.full(len(ok), -1, np.int32)
        for i, m in self.late:
            open_rows = np.flatnonzero(ok & (at < 0))
            if len(open_rows):
                at[self._rejected(m, columns, open_rows)] = i
        return pa.array(at, mask=at < 0)


def _run(pair: dict[str, pa.Array], reject: pa.Array, cfg: AssemblerConfig, modules: _Batches, with_logp: bool) -> tuple[dict[str, pa.Array], pa.Array, pa.Array]:
    """Results of a batch, and which modules rejected before and behind the kernel."""
    at = modules.before(pair, reject)
    rejected = (at >= 0) & (at < np.iinfo(np.int32).max)  # short reads are told apart by the kernel again
    out = results(*(pair[c] for c in PAIR[2:]), cfg, ~rejected, with_logp)
    out = {k: out[k].cast(t) for k, t in _RESULT}
    return out, pa.array(at, mask=~rejected), modules.behind(pair | out)


def _kernel(cfg: AssemblerConfig, passed: list[str], with_logp: bool):
    bare, modules = replace(cfg, modules=()), _Batches(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, early, late = _run({c: b.column(c) for c in PAIR}, b.column("_reject"), bare, modules, with_logp)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), early, late, *out.values()], [*passed, "_reject", "_late", *out])

    return run


def _prechecks(df: DataFrame, cfg: AssemblerConfig) -> tuple[DataFrame, Column]:
    """The table, widened by modules, and the place of the Column module that keeps a pair from the kernel (-1: a bad read; else null)."""
    reject = F.when((F.length("f_seq") < 2) | (F.length("r_seq") < 2) | F.col("f_seq").isNull() | F.col("r_seq").isNull(), -1)
    for i, m in enumerate(cfg.modules):
        if m.stage == "precheck" and not m.batch:
            df, keep = m.on(df, cfg)
            reject = reject.when(~F.coalesce(keep, F.lit(False)), i)
    return df, reject


def _checks(out: DataFrame, cfg: AssemblerConfig) -> DataFrame:
    """Results with ``reject_module`` (from ``_reject``, ``_late`` and the Column modules behind the kernel)."""
    late: Column = F.when(F.lit(False), F.lit(""))
    for i, m in enumerate(cfg.modules):
        if m.stage == "precheck":
            late = late.when((F.col("status") == "MODULE") & (F.col("_reject") == i), m.name)
    for i, m in enumerate(cfg.modules):
        if m.stage == "check" and m.batch:
            late = late.when((F.col("status") == "OK") & (F.col("_late") == i), m.name)
        elif m.stage == "check":
            out, keep = m.on(out, cfg)
            late = late.when((F.col("status") == "OK") & ~F.coalesce(keep, F.lit(False)), m.name)
    out = out.withColumn("reject_module", late)
    return out.withColumn("status", F.when(F.col("reject_module").isNotNull(), "MODULE").otherwise(F.col("status"))).drop("_reject", "_late")


def assemble(pairs: DataFrame, cfg: AssemblerConfig | None = None, *, with_logp: bool = True, keep_reads: bool = False) -> DataFrame:
    """Merge all pairs.  Columns: ordinal, id (and the reads if asked), the result, and ``reject_module``.

    Without ``with_logp`` the log-probabilities of bases are left out; modules that read them need it.
    """
    cfg = cfg or AssemblerConfig()
    df, reject = _prechecks(pairs, cfg)
    passed = ["ordinal", "id", *(["f_seq", "f_qual", "r_seq", "r_qual"] if keep_reads else [])]
    df = df.withColumn("_reject", reject).select(*PAIR, "_reject")
    shape = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in passed)
    batches = replace(cfg, modules=tuple(m if m.batch else replace(m, apply=None) for m in cfg.modules))  # only what the map needs is sent
    return _checks(df.mapInArrow(_kernel(batches, passed, with_logp), f"{shape}, _reject int, _late int, {RESULT_TYPE}"), cfg)


def assemble_each(pairs: DataFrame, configs: dict[str, AssemblerConfig]) -> DataFrame:
    """Merge all pairs by several settings in one pass: ordinal, id and, for each name, a struct of the result.

    Log-probabilities are left out unless a module behind the kernel is used.
    """
    df, names = pairs, list(configs)
    for k, cfg in configs.items():
        df, reject = _prechecks(df, cfg)
        df = df.withColumn(f"_reject_{k}", reject)
    logp = any(m.stage == "check" for cfg in configs.values() for m in cfg.modules)
    bare = {k: replace(cfg, modules=()) for k, cfg in configs.items()}
    modules = {k: _Batches(replace(cfg, modules=tuple(m if m.batch else replace(m, apply=None) for m in cfg.modules))) for k, cfg in configs.items()}
    # reads go back only where a module behind the kernel could ask for them
    passed = PAIR if logp else PAIR[:2]
    rejects, lates = [f"_reject_{k}" for k in names], [f"_late_{k}" for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = {c: b.column(c) for c in PAIR}
            structs, early, late = [], [], []
            for k in names:
                out, one, two = _run(pair, b.column(f"_reject_{k}"), bare[k], modules[k], logp)
                structs.append(pa.StructArray.from_arrays(list(out.values()), list(out)))
                early.append(one)
                late.append(two)
            yield pa.RecordBatch.from_arrays([*(pair[c] for c in passed), *structs, *early, *late], [*passed, *names, *rejects, *lates])

    df = df.select(*PAIR, *rejects)
    inner = ", ".join(x.strip().replace(" ", ":", 1) for x in RESULT_TYPE.split(", "))
    shape = [f"{c} {df.schema[c].dataType.simpleString()}" for c in passed] + [f"`{k}` struct<{inner}>" for k in names] + [f"{c} int" for c in (*rejects, *lates)]
    df = df.mapInArrow(run, ", ".join(shape))
    plain = [c for c, _ in _RESULT]
    for k, cfg in configs.items():
        # modules see the columns of one result at a time
        others = [c for c in df.columns if c not in (k, f"_reject_{k}", f"_late_{k}")]
        own = [F.col(f"_reject_{k}").alias("_reject"), F.col(f"_late_{k}").alias("_late"), F.col(k)["status"].alias("status")]
        wide = _checks(df.select(*others, *own, *[F.col(k)[c].alias(c) for c in plain[1:]]), cfg)
        df = wide.select(*others, F.struct(*plain, "reject_module").alias(k))
    return df.select("ordinal", "id", *names)


def overlap_offsets(result: DataFrame) -> DataFrame:
    """Add where the overlap begins in the merged sequence, the forward read and the reverse read (from 0); needs ``keep_reads``.

    Clipped bases of the forward read don't count in the merged sequence's; null where nothing was merged.
    """
    forward, ov = F.length("f_seq"), F.col("overlap")
    merged_rows = F.col("sequence").isNotNull()
    where = {"overlap_offset": forward - F.col("forward_offset") - ov, "overlap_forward_offset": forward - ov, "overlap_reverse_offset": F.length("r_seq") - ov}
    return result.withColumns({k: F.when(merged_rows, c) for k, c in where.items()})


def merged(result: DataFrame) -> DataFrame:
    """The rows that passed."""
    return result.where("status = 'OK'")


def empty_pairs(spark: SparkSession) -> DataFrame:
    from ..functions.seqid import TYPE

    return spark.createDataFrame([], f"ordinal long, id {TYPE}, f_seq string, f_qual string, r_seq string, r_qual string")
