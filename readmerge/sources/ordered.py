"""Text in order of ordinals as files, written by Spark's Python data source and put in place by its commit.

Each task writes its records, which must ascend, to files of its own in a hidden folder beside the target, and reports their first
and last ordinal, rows and bytes.  The commit puts the parts in order, refuses parts whose ordinals overlap, and renames; an abort deletes
the folder, so a failed write leaves nothing and a task that ran twice counts once.  Several text columns go to a file
each in one pass, so their records stay in step; a null is no record.

Rows can be tallied as they are written: tasks count the values of some columns and the commit adds up the counts of exactly those parts
that it keeps, so retries and lost executors count nothing twice (as ``DataFrame.observe`` can where a stage runs again).

Layouts: ``parts`` (a folder with ``part-00000`` ... for each column), ``single`` (one file for each column: tasks copy the parts to
their places, sums of the sizes before them, in one hidden file, which is renamed at last; it needs a folder that driver and executors mount,
and compressed parts are members that join to a whole file), ``stdout`` (parts printed in order by the driver) and
``null`` (rows are counted, nothing is written).
"""

from __future__ import annotations

import atexit
import bz2
import contextlib
import gzip
import json
import os
import sys
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COPY = 8 << 20
_OPEN = {"none": lambda raw: raw, "gzip": lambda raw: gzip.GzipFile(fileobj=raw, mode="wb", mtime=0), "bzip2": lambda raw: bz2.BZ2File(raw, "wb")}
END_OF_NAME = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: rows, first and last ordinal, and for each column the name and size of its part."""

    rows: int
    first: int
    last: int
    parts: dict[str, tuple[str, int]]
    tally: dict[str, Counter]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.tallied = [c for c in options.get("tally", "").split(",") if c]
        columns = [c for c in columns if c not in self.tallied]
        self.target, self.staging, self.layout = options["path"], options["staging"], options.get("layout", "parts")
        self.compression, self.columns = options.get("compression", "none"), columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.staging)
        rows, first, last, files, tally = 0, 0, -1, {}, {c: Counter() for c in self.tallied}
        with contextlib.ExitStack() as stack:
            for batch in iterator:
                at = batch.column("ordinal").to_numpy()
                if not len(at):
                    continue
                if self.layout != "null" and ((rows and at[0] < last) or (np.diff(at) < 0).any()):
                    raise ValueError("records of a task must be in order of their ordinals")
                first, last = int(at[0]) if not rows else first, int(at[-1])
                rows += len(at)
                for c, n in tally.items():
                    n.update({v["values"]: v["counts"] for v in batch.column(c).value_counts().to_pylist()})
                if self.layout == "null":
                    continue
                if not files:
                    system.create_dir(folder, recursive=True)
                    for c in self.columns:
                        name = f"{folder}/{c}-{uuid.uuid4().hex}"
                        raw = stack.enter_context(system.open_output_stream(name))
                        files[c] = name, raw, raw if self.compression == "none" else stack.enter_context(_OPEN[self.compression](raw))
                for c, (_, _, out) in files.items():
                    lines = pc.binary_join_element_wise(batch.column(c).cast(pa.string()).drop_null(), "", "\n")
                    if not len(lines):
                        continue
                    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
                    out.write(lines.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
        sizes = {c: (name.rpartition("/")[2], system.get_file_info(name).size) for c, (name, _, _) in files.items()}
        return Written(rows, first, last, sizes, tally)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.staging)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        for a, b in zip(done, done[1:], strict=False):
            if b.first <= a.last and self.layout != "null":
                self.abort(messages)
                raise ValueError(f"ordinals {a.first} to {a.last} and {b.first} to {b.last} of two tasks overlap")
        if self.tallied:
            total = {c: sum((m.tally[c] for m in done), Counter()) for c in self.tallied}
            with system.open_output_stream(f"{folder}.json") as f:  # beside the parts; read and deleted by the caller
                f.write(json.dumps({c: list(n.items()) for c, n in total.items()}).encode())
        if self.layout == "null":
            return
        system.create_dir(folder, recursive=True)
        kept = {name for m in done for name, _ in m.parts.values()}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in kept:  # of a task that was run again
                system.delete_file(info.path)
        ending = END_OF_NAME[self.compression]
        order: dict[str, list[tuple[str, int]]] = {c: [] for c in self.columns}
        for c in self.columns:
            system.create_dir(f"{folder}/{c}")
            for n, m in enumerate(done):
                name, size = m.parts[c]
                system.move(f"{folder}/{name}", f"{folder}/{c}/part-{n:05d}{ending}")
                order[c].append((f"part-{n:05d}{ending}", size))
        if self.layout == "parts":
            system.move(folder, file_system(self.target)[1])
        else:
            with system.open_output_stream(f"{folder}/order.json") as f:
                f.write(json.dumps(order).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)
        if system.get_file_info(f"{folder}.json").type != fs.FileType.NotFound:
            system.delete_file(f"{folder}.json")


class OrderedText(DataSource):
    """Format ``ordered_text``: rows (ordinal long, and strings), see :func:`write_in_order`."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, [f.name for f in schema.fields if f.name != "ordinal"])


def _join(spark: SparkSession, folder: str, parts: list[tuple[str, int]], target: str) -> None:
    """Copy parts to their places in one file, a task for about a GB."""
    ends = np.cumsum([n for _, n in parts], dtype=np.int64)
    tasks = [(f"{folder}/{name}", int(end) - n, n) for (name, n), end in zip(parts, ends, strict=True)]
    hidden = f"{folder}/whole"
    with open(hidden, "wb") as f:
        f.truncate(int(ends[-1]) if len(ends) else 0)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, at, n = tasks[i]
                with open(path, "rb") as a, open(hidden, "r+b") as b:
                    b.seek(at)
                    while data := a.read(COPY):
                        b.write(data)
                        n -= len(data)
                    b.flush()
                    os.fsync(b.fileno())
                if n:
                    raise OSError(f"{path} has another size than when it was written")
            yield batch.slice(0, 0)

    if tasks:
        spark.range(0, len(tasks), 1, min(len(tasks), max(1, int(ends[-1]) >> 30, spark.sparkContext.defaultParallelism))).mapInArrow(copy, "id long").count()
    os.replace(hidden, target)


def write_in_order(rows: DataFrame, path: str, *, layout: str = "parts", compression: str = "none", in_order: bool = False, tally: tuple[str, ...] = ()) -> dict[str, Counter]:
    """Write text columns of ``rows`` (ordinal long, and one string column or more) in order of their ordinals; a target that exists is an error.

    Columns named in ``tally`` are not written; how often each of their values came (few, by their nature) is returned.

    ``in_order``: partitions already ascend and don't overlap, as those of files and of maps over them, so nothing is shuffled; else
    rows are range partitioned and sorted.  ``single`` writes one column to ``path`` itself, several to ``path/<column>``.
    """
    if layout not in ("parts", "single", "stdout", "null") or compression not in _OPEN:
        raise ValueError(f"unknown layout {layout!r} or compression {compression!r}")
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != "ordinal" and c not in tally]
    system, target = file_system(path) if layout in ("parts", "single") else (fs.LocalFileSystem(), "")
    if target and system.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    if layout == "single" and not isinstance(system, fs.LocalFileSystem):
        raise ValueError("one file needs a folder that driver and executors mount; use layout='parts'")
    if layout in ("stdout", "null"):
        path = f"{shared_folder(spark)}/readmerge-{uuid.uuid4().hex}"
    spark.dataSource.register(OrderedText)
    if not in_order and layout != "null":  # what is only counted has no order, and ranges would be found by making all rows once more
        rows = rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    options = {"layout": layout, "staging": staging, "compression": compression, "tally": ",".join(tally)}
    rows.select("ordinal", *columns, *tally).write.format("ordered_text").options(**options).mode("append").save(path)
    system, folder = file_system(staging)
    counts: dict[str, Counter] = {}
    if tally:
        with system.open_input_stream(f"{folder}.json") as f:
            counts = {c: Counter(dict(map(tuple, n))) for c, n in json.loads(f.read()).items()}
        system.delete_file(f"{folder}.json")
    if layout in ("parts", "null"):
        return counts
    try:
        with system.open_input_stream(f"{folder}/order.json") as f:
            order = json.loads(f.read())
        for c in columns:
            if layout == "stdout":
                for name, _ in order[c]:
                    with system.open_input_stream(f"{folder}/{c}/{name}") as f:
                        while data := f.read(COPY):
                            sys.stdout.buffer.write(data) if hasattr(sys.stdout, "buffer") else sys.stdout.write(bytes(data).decode())
            else:
                os.makedirs(os.path.dirname(target) if len(columns) == 1 else target, exist_ok=True)
                _join(spark, f"{folder}/{c}", order[c], target if len(columns) == 1 else f"{target}/{c}")
    finally:
        system.delete_dir(folder)
    return counts


# --- folders of a session -------------------------------------------------------------------------------------------

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _made.append(tempfile.mkdtemp(prefix="readmerge-"))
    return f"file://{_made[-1]}"


def session_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, deleted when the driver's Python ends."""
    _made.append(f"{shared_folder(spark)}/readmerge-{uuid.uuid4().hex}")
    return _made[-1]


@atexit.register
def _cleanup() -> None:
    for path in _made:
        with contextlib.suppress(Exception):  # a folder that is gone, or a store that is closed: the others go all the same
            system, folder = file_system(path)
            system.delete_dir(folder)
