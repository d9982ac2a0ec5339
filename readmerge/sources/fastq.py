"""FASTQ files as a Python data source.

Files larger than ``split_bytes`` are read in ranges.  One job counts the records of each range of each file (where the first record
of a range begins is guessed from its lines, and counted again where the range before it ends elsewhere); sums of the counts
number the records, and a partition takes record n to m of all files of a pair, from the nearest noted positions on.  So mates
need no join, and no file is read from its start.  Files that can't be cut (gzip, or a server without ranges) make a pair one
partition.  Compression is told by the first bytes.  Files are opened with pyarrow's file systems if the path is a URI, over HTTP
if it is a URL (with retries that go on where a connection broke), else locally.

Modes: ``PREFIX`` stops a file pair at its first malformed record, as the reference does; ``DROPMALFORMED`` leaves
malformed records out, each with its mate, and goes on at the next record; ``FAILFAST`` raises.  A file that ends before its
mate is malformed (``EOF``) in all modes.  :func:`fastq_diagnostics` has a row for everything that was left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import logs, seqid
from .ranges import END, Source
from .records import Columns, Counted, count_range, scan

#: Ordinals of one file pair.
ORDINALS = 1 << 40
SPLIT_BYTES = 64 << 20
FIELDS = ["ordinal", "f_header", "r_header", "i_seq", "f_seq", "f_qual", "r_seq", "r_qual", "error"]
SCHEMA = "ordinal long, f_header string, r_header string, i_seq string, f_seq string, f_qual string, r_seq string, r_qual string, error string"


class Malformed(ValueError):
    """A record that is not FASTQ; the code is that of the log."""


def records(path: str) -> Iterator[tuple[str, str, str] | Malformed]:
    """(header, bases, qualities) of each record, or what is wrong with it; a line may end in CR LF or the file's end."""
    for c in scan(Source.of(path, split=False)):
        for h, s, q, wrong in zip(*(x.to_pylist() for x in (c.header, c.seq, c.qual, c.fault)), strict=True):
            yield Malformed(wrong) if wrong else (h, s, q)


# --- planning -------------------------------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Records ``first`` to ``first + count`` (-1: to the end) of a pair of files: for each file where to start and how many to pass over."""

    number: int
    first: int
    count: int
    files: list[tuple[dict, int, int]]


def _most(spark: SparkSession, sources: list[Source]) -> int:
    """How many tasks for ranges of files: so many that all cores are busy, or one for SPLIT_BYTES, whatever is more."""
    return max(16 * spark.sparkContext.defaultParallelism, sum(s.size or 0 for s in sources) // SPLIT_BYTES)


def _count_all(spark: SparkSession, tasks: list[tuple[Source, int, int, int | None]]) -> list[Counted]:
    """Counts of ranges (source, first byte, end, position of the first record or None).  A task gets its own ranges as rows, neighbours together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, *where = json.loads(task)
                found = json.dumps(asdict(count_range(Source(**source), *where)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([found])], ["i", "found"])

    rows = [(i, json.dumps([s.asdict(), a, b, at])) for i, (s, a, b, at) in enumerate(tasks)]
    slices = max(1, min(len(rows), _most(spark, list({s.path: s for s, *_ in tasks}.values()))))
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), "i long, task string")
    found = dealt.mapInArrow(run, "i long, found string").collect()  # a row for each range
    return [Counted(**json.loads(r["found"])) for r in sorted(found, key=lambda r: r["i"])]


def count_files(spark: SparkSession, sources: list[Source], split_bytes: int) -> list[list[Counted]]:
    """For each file its ranges in order, joined without a gap: each begins where the one before ends."""
    tasks = [(n, s, a, b) for n, s in enumerate(sources) for a, b in s.cuts(split_bytes)]
    found = _count_all(spark, [(s, a, b, None) for _, s, a, b in tasks])
    while True:
        again: dict[int, int] = {}
        expected = 0
        for i, ((n, s, _, b), c) in enumerate(zip(tasks, found, strict=True)):
            if i and tasks[i - 1][0] != n:
                expected = 0
            if expected >= s.position(b):
                if c.count:
                    again[i] = expected  # the record before reaches over this whole range
            elif c.first != expected:
                again[i] = expected
            expected = c.following if c.count or c.first is not None else expected
        if not again:
            break
        for i, c in zip(again, _count_all(spark, [(*tasks[i][1:], at) for i, at in again.items()]), strict=True):
            found[i] = c if c.count else Counted(None, c.following, 0, [])
    out: list[list[Counted]] = [[] for _ in sources]
    for (n, *_), c in zip(tasks, found, strict=True):
        out[n].append(c)
    return out


def plan(spark: SparkSession, pairs: list[list[str]], split_bytes: int = SPLIT_BYTES) -> list[Piece]:
    """Pieces of pairs of files (forward, reverse and perhaps index paths each)."""
    sources = [[Source.of(p) for p in pair] for pair in pairs]
    cut = [n for n, pair in enumerate(sources) if all(s.kind != "stream" for s in pair) and any(len(s.cuts(split_bytes)) > 1 for s in pair)]
    counted = iter(count_files(spark, [s for n in cut for s in sources[n]], split_bytes) if cut else [])
    pieces = []
    for n, pair in enumerate(sources):
        if n not in cut:
            pieces.append(Piece(n, 0, -1, [(Source.of(s.path, split=False).asdict() if s.kind == "bzip2" else s.asdict(), 0, 0) for s in pair]))
            continue
        ranges = [next(counted) for _ in pair]
        firsts = [np.cumsum([0, *[c.count for c in r]]) for r in ranges]
        marks = []  # for each file the numbers of records whose positions are known
        for r, first in zip(ranges, firsts, strict=True):
            known = {0: 0} | {int(f) + k: at for c, f in zip(r, first, strict=False) for k, at in ([(0, c.first), *c.marks] if c.count else [])}
            marks.append((np.array(sorted(known)), known))
        least = min(int(f[-1]) for f in firsts)
        lead = max(range(len(pair)), key=lambda k: len(ranges[k]))
        starts = sorted({0, *(int(x) for x in firsts[lead][:-1] if x < least)})
        for a, b in zip(starts, [*starts[1:], None], strict=True):
            files = []
            for s, (numbers, known) in zip(pair, marks, strict=True):
                near = int(numbers[np.searchsorted(numbers, a, "right") - 1])
                files.append((s.asdict(), known[near], a - near))
            pieces.append(Piece(n, a, -1 if b is None else b - a, files))
    return _together(pieces, _most(spark, [s for pair in sources for s in pair]))


def _together(pieces: list[Piece], most: int) -> list[Piece]:
    """At most about so many pieces: neighbours of a pair of files, whose records follow each other, are read as one."""
    step = -(-len(pieces) // most)
    out, joined = [], 0
    for p in pieces:
        last = out[-1] if out else None
        if last is not None and last.number == p.number and joined < step:
            out[-1] = Piece(last.number, last.first, -1 if p.count < 0 else p.first + p.count - last.first, last.files)
            joined += 1
        else:
            out.append(p)
            joined = 1
    return out


# --- reading --------------------------------------------------------------------------------------------------------


class _Side:
    """Records of one file of a pair, any number at a time."""

    def __init__(self, source: dict, at: int, skip: int):
        self.path = source["path"]
        self.more = scan(Source(**source), at, skip)
        self.rest: Columns | None = None

    def ahead(self) -> int:
        """How many records are at hand; 0 at the end."""
        while self.rest is None or not len(self.rest):
            self.rest = next(self.more, None)
            if self.rest is None:
                return 0
        return len(self.rest)

    def take(self, n: int) -> Columns:
        out, self.rest = self.rest.slice(0, n), self.rest.slice(n)
        return out


def _rows(parts: list[Columns], paths: list[str], first: int) -> pa.RecordBatch:
    """A row for each record of all files; where one is malformed the first such names the error."""
    error = pc.coalesce(*(pc.binary_join_element_wise(c.fault, pa.scalar(p), "\t") for c, p in zip(parts, paths, strict=True)))
    f, r = parts[:2]
    n = len(f)
    index = parts[2].seq if len(parts) > 2 else pa.nulls(n, pa.string())
    head, columns = f.header, [r.header, index, f.seq, f.qual, r.seq, r.qual]
    if error.null_count < n:
        head = pc.coalesce(*(c.header for c in parts))
        good = pa.array(np.arange(n), mask=error.is_valid().to_numpy(zero_copy_only=False))
        columns = [c.take(good) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), head, *columns, error], FIELDS)


def read_piece(piece: Piece, mode: str) -> Iterator[pa.RecordBatch]:
    """Rows of a piece, up to and with its first malformed record in mode PREFIX, or the end of a file in any mode."""
    sides = [_Side(*f) for f in piece.files]
    paths, at, left = [s.path for s in sides], piece.first, piece.count if piece.count >= 0 else END
    while left:
        have = [s.ahead() for s in sides]
        n = min(*have, left)
        if not n:
            if not any(have):
                return
            # a file has ended before its mate
            parts = [s.take(1) if h else Columns(*[pa.nulls(1, pa.string())] * 3, pa.array(["EOF"])) for s, h in zip(sides, have, strict=True)]
        else:
            parts = [s.take(n) for s in sides]
        rows = _rows(parts, paths, piece.number * ORDINALS + at)
        error = rows.column("error")
        if error.null_count < len(rows):
            bad = np.flatnonzero(error.is_valid().to_numpy(zero_copy_only=False))
            code, _, path = error[int(bad[0])].as_py().partition("\t")
            if mode == "FAILFAST":
                raise Malformed(f"{code}: record {at + int(bad[0]) + 1} of {path}")
            ends = bad if mode == "PREFIX" else [i for i in bad if error[int(i)].as_py().startswith("EOF\t")]
            if len(ends):
                yield rows.slice(0, int(ends[0]) + 1)
                return
        yield rows
        at, left = at + len(rows), left - len(rows)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mode, self.pieces = options.get("mode", "PREFIX").upper(), json.loads(options["plan"])

    def __getstate__(self) -> dict:
        """What tasks get: a task has its own piece, and not the plan of all."""
        return {"mode": self.mode, "pieces": []}

    def partitions(self):
        return [Piece(**p) for p in self.pieces]

    def read(self, piece: Piece):
        yield from read_piece(piece, self.mode)


class FastqPairSource(DataSource):
    """Format ``fastq_pair``: options plan (pieces as JSON, see :func:`plan`) and mode."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pair"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _paths(x) -> list[str]:
    return [p for p in (x.split(",") if isinstance(x, str) else x or []) if p]


def with_identity(df: DataFrame, tag: str) -> DataFrame:
    """Add the parsed headers (f, r), the ``error`` of mates that don't belong together, and ``good``."""
    # a generator, so that headers are parsed once: conditions on a projection would be moved below it, with the parser in each field
    df = df.select("*", F.inline(F.array(F.struct(seqid.parse(F.col("f_header"), tag).alias("f"), seqid.parse(F.col("r_header"), tag).alias("r")))))
    same = F.lit(True)
    for c in seqid.FIELDS:
        same = same & F.col("f.id")[c].eqNullSafe(F.col("r.id")[c])
    named = (F.col("f.mate") > 0) & (F.col("r.mate") > 0)
    mates = same & ((F.col("f.mate") != F.col("r.mate")) | F.col("f.format").isin("SRA", "EBI"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~named, "BADID\t").when(~mates, "NOTPAIRED\t")
    return df.withColumn("error", error).withColumn("good", F.col("error").isNull())


def paired(df: DataFrame, indexed: bool) -> DataFrame:
    """The pairs of good rows; an index read replaces the tag."""
    ident = F.col("f.id").withField("tag", F.substring("i_seq", 1, 49)) if indexed else F.col("f.id")
    return df.where("good and length(f_seq) > 0").select("ordinal", ident.alias("id"), "f_seq", "f_qual", "r_seq", "r_qual")


def _until_first_fault(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a file pair up to and with the first that is not good; a partition is one file pair in order."""
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        if good.all():
            yield batch
        else:
            yield batch.slice(0, int(good.argmin()) + 1)
            return


def _checked(spark: SparkSession, forward, reverse, index, tag: str, mode: str, split_bytes: int) -> tuple[DataFrame, bool]:
    """Raw rows with parsed headers (f, r), ``error`` and ``good``."""
    mode = mode.upper()
    if mode not in ("PREFIX", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode!r}")
    f, r, i = _paths(forward), _paths(reverse), _paths(index)
    if not f or len(f) != len(r) or (i and len(i) != len(f)):
        raise ValueError("give as many reverse (and index) files as forward files")
    spark.dataSource.register(FastqPairSource)
    pieces = plan(spark, [[a, b, *([i[n]] if i else [])] for n, (a, b) in enumerate(zip(f, r, strict=True))], split_bytes)
    df = spark.read.format("fastq_pair").option("mode", mode).option("plan", json.dumps([asdict(p) for p in pieces])).load()
    df = with_identity(df, "optional" if i else tag)
    if mode == "FAILFAST":
        df = df.where(F.when(F.col("good"), True).otherwise(F.raise_error(F.concat(F.col("error"), F.coalesce("f_header", F.lit("")))).cast("boolean")))
    elif mode == "PREFIX" and len(pieces) == len(f):
        df = df.mapInArrow(_until_first_fault, df.schema)
    elif mode == "PREFIX":  # the first fault may be in another piece: a row for each pair of files that has one
        number = F.floor(F.col("ordinal") / ORDINALS)
        stop = df.where(~F.col("good")).groupBy(number.alias("_pair")).agg(F.min("ordinal").alias("_stop"))
        df = df.join(F.broadcast(stop), number == F.col("_pair"), "left").where("_stop is null or ordinal <= _stop").drop("_pair", "_stop")
    return df, bool(i)


def read_fastq_pairs(spark: SparkSession, forward: str | list[str], reverse: str | list[str], index: str | list[str] | None = None, *, tag: str = "present", mode: str = "PREFIX", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pairs from FASTQ files.  Identifiers of mates must agree and their mate numbers differ (but for SRA and EBI).

    Pairs that do not agree end their file pair (``PREFIX``), are dropped, or raise.  Pairs with an empty forward read
    are skipped.  An index read replaces the tag, and makes it optional in headers.
    """
    return paired(*_checked(spark, forward, reverse, index, tag, mode, split_bytes))


def fastq_diagnostics(spark: SparkSession, forward: str | list[str], reverse: str | list[str], index: str | list[str] | None = None, *, tag: str = "present", mode: str = "PREFIX", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each record that ended a file pair or was left out: file_pair, record (from 0), code, line, header, path, hint."""
    df, _ = _checked(spark, forward, reverse, index, tag, mode, split_bytes)
    code = F.split("error", "\t")[0]
    path = F.split("error", "\t")[1]
    return df.where("not good").select(
        F.floor(F.col("ordinal") / ORDINALS).cast("int").alias("file_pair"), (F.col("ordinal") % ORDINALS).alias("record"), code.alias("code"),
        logs.line(code).alias("line"), F.col("f_header").alias("header"), F.when(path != "", path).alias("path"), logs.hint(code).alias("hint"),
    )
