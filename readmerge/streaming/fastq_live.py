"""A stream of pairs from FASTQ files that are still being written.

An offset names, for each pair of files, how many records were taken, and for each file a position where one of them begins and how many to pass
over from there, so a restart neither looks at what is done nor repeats or loses a record.  A record counts when its lines are
complete in all files of its pair; a file that doesn't exist yet has none.  Files must be plain and may only grow.

The driver looks through the bytes that were added since the last offset (whole chunks at once, nothing is kept of them); tasks read the records.
Modes are ``DROPMALFORMED`` and ``FAILFAST``; ``PREFIX`` would have to end a stream for good.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources.fastq import SCHEMA, Piece, paired, read_piece, with_identity
from ..sources.ranges import Source
from ..sources.records import Scanner

MARK_BYTES = 1 << 16
#: Records of a pair of files that one task reads.
TASK_RECORDS = 1 << 18


def whole_lines(chunks: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The chunks up to the last line end."""
    held: list[tuple[int, bytes]] = []
    for at, data in chunks:
        cut = data.rfind(b"\n") + 1
        if cut:
            yield from held
            yield at, data[:cut]
            held = [(at + cut, data[cut:])] if cut < len(data) else []
        else:
            held.append((at, data))


def complete(path: str, at: int, skip: int) -> tuple[int, list[tuple[int, int]]]:
    """How many complete records follow the first ``skip`` from a position on, and positions of some, by number."""
    try:
        source = Source.of(path)
    except FileNotFoundError:
        return 0, [(0, at)]
    if source.kind != "plain":
        raise ValueError(f"{path}: only plain files can be read while they are written")
    if source.size is not None and source.size < at:
        raise OSError(f"{path} was cut short")
    scanner = Scanner(whole_lines(source.chunks(at)), count_only=True, mark_bytes=MARK_BYTES)
    for _ in scanner:
        pass
    n = scanner.count - scanner.unfinished
    return max(0, n - skip), [(0, at), *((k, p) for k, p in scanner.marks if 0 < k <= n)]


class _Live(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pairs = json.loads(options["pairs"])
        self.mode = options.get("mode", "DROPMALFORMED").upper()
        self.now = self.initialOffset()

    def initialOffset(self) -> dict:
        return {str(n): {"records": 0, "files": [[0, 0] for _ in pair]} for n, pair in enumerate(self.pairs)}

    def latestOffset(self) -> dict:
        out = {}
        for n, pair in enumerate(self.pairs):
            state = self.now[str(n)]
            found = [complete(path, at, skip) for path, (at, skip) in zip(pair, state["files"], strict=True)]
            more = min(count for count, _ in found)
            files = []
            for (_, skip), (_, marks) in zip(state["files"], found, strict=True):
                k, at = max(m for m in marks if m[0] <= skip + more)
                files.append([at, skip + more - k])
            out[str(n)] = {"records": state["records"] + more, "files": files if more else state["files"]}
        self.now = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for n, pair in enumerate(self.pairs):
            a, b = start[str(n)], end[str(n)]
            first, left = a["records"], b["records"] - a["records"]
            for done in range(0, left, TASK_RECORDS):
                files = [({"path": p, "size": None, "kind": "plain", "tag": None}, at, skip + done) for p, (at, skip) in zip(pair, a["files"], strict=True)]
                pieces.append(Piece(n, first + done, min(TASK_RECORDS, left - done), files))
        self.now = max(self.now, end, key=lambda o: sum(x["records"] for x in o.values()))
        return pieces

    def read(self, piece: Piece):
        yield from read_piece(piece, self.mode)


class FastqLive(DataSource):
    """Format ``fastq_live``: options pairs (lists of paths as JSON) and mode."""

    @classmethod
    def name(cls) -> str:
        return "fastq_live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _Live(self.options)


def stream_fastq_pairs(spark: SparkSession, forward: list[str], reverse: list[str], index: list[str] | None = None, *, tag: str = "present", mode: str = "DROPMALFORMED") -> DataFrame:
    """A stream of the pairs of growing FASTQ files, as ``read_fastq_pairs`` has them."""
    if mode.upper() not in ("DROPMALFORMED", "FAILFAST"):
        raise ValueError("a stream has no first fault to end at; choose DROPMALFORMED or FAILFAST")
    pairs = [list(p) for p in zip(forward, reverse, *([index] if index else []), strict=True)]
    spark.dataSource.register(FastqLive)
    df = with_identity(spark.readStream.format("fastq_live").option("pairs", json.dumps(pairs)).option("mode", mode).load(), "optional" if index else tag)
    if mode.upper() == "FAILFAST":
        df = df.where(F.when(F.col("good"), True).otherwise(F.raise_error(F.concat(F.col("error"), F.coalesce("f_header", F.lit("")))).cast("boolean")))
    return paired(df, bool(index))
