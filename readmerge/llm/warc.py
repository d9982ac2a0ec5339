"""Web archives with a two-level capture index.

Pages become WARC records, one gzip member each, gathered into archive segments of bounded size (a binary column in the
shared folder, so any Spark store can hold them; :func:`export` writes them out as plain ``.warc.gz`` files).  Of records
with equal payloads the one with the least key is the response and the others revisit it.

The index has a line for each capture under its reversed-host key.  Lines are range-partitioned and sorted, packed into
compressed blocks, and a sparse directory keeps the beginning of the first key of each block.  A look-up of many URLs
searches the directory for the blocks that may have a key, meets those blocks and searches each by bisection, and sends the
byte ranges found to the archives, which stay where they are: their table is bucketed by archive, so only ranges move.

Bounds: the directory has at most ``DIRECTORY`` blocks and one for each partition (blocks grow beyond that) of ``PREFIX``
characters each; payloads that more than 1 / ``HOT`` of all pages have are at most ``HOT`` and broadcast, so pages of a common
payload stay in place; no other payload has more rows than that in one task.  Archives are dealt over buckets by the bytes of
the pages, whatever the session's number of shuffle partitions.

Defined cases: a null page is an empty payload; a null URL has an empty index key; rows that share the least key of their
payload are all responses; payloads below ``least`` bytes are never deduplicated; equal rows each get a record; keys of any
type come back as text and can be cast to their own type.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import scratch

SEGMENT_BYTES, SEGMENT_RECORDS = 8 << 20, 10_000
BLOCK_LINES, DIRECTORY, PREFIX = 3000, 1 << 17, 64
HOT = 10_000
#: Archives and index lines are dealt over one task for so many bytes of pages, at most and (for parallel work on small tables) at least so many.
BUCKET_BYTES, BUCKETS, LEAST_BUCKETS = 32 << 20, 50_000, 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, then ``)`` and the rest."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].partition("#")[0]
    return (",".join(reversed(host.split("."))) + ")" + (tail or "/")) if host else ""


def _clean(x: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def write_record(key, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member; ``refers_to`` (the response's key) makes it a revisit, which leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    head += [f"X-Page-Key: {quote(str(key))}"] if key is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {quote(str(refers_to))}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (names in lower case), HTTP head, and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(names["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return names, http, payload


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, data, entries, size = TaskContext.get().partitionId(), 0, [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{made:05d}"]), pa.array([b"".join(data)], pa.binary()), pa.array([entries], pa.list_(pa.struct([("surt", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))],
                ["archive", "data", "entries"],
            )

        for batch in batches:
            for key, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "refers")), strict=True):
                member = write_record(key, url, (html or "").encode(), refers, date)
                data.append(member)
                entries.append({"surt": _clean(surt(url)), "offset": size, "length": len(member)})
                size += len(member)
                if size >= SEGMENT_BYTES or len(data) >= SEGMENT_RECORDS:
                    yield segment()
                    made, data, entries, size = made + 1, [], [], 0
        if data:
            yield segment()

    return run


def _blocks(most: int):
    """Index blocks of up to ``most`` lines from sorted lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, lines, first = TaskContext.get().partitionId(), 0, [], ""

        def block():
            packed = zlib.compress("\n".join(lines).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([first[:PREFIX]]), pa.array([packed], pa.binary())], ["block", "first", "data"])

        for batch in batches:
            for s, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("surt", "archive", "offset", "length")), strict=True):
                if not lines:
                    first = s
                lines.append(f"{s}\t{archive}\t{offset}\t{length}")
                if len(lines) >= most:
                    yield block()
                    made, lines = made + 1, []
        if lines:
            yield block()

    return run


def read_block(data: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_clean(surt(x)) for x in batch.column(0).to_pylist()], pa.string())], ["surt"])


def _route(firsts: list[str], blocks: list[int]):
    """Each key with the blocks that may have it: from the last that begins below it to the last that does not begin above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = [], []
            for k in batch.column("surt").to_pylist():
                head = k[:PREFIX]
                to = blocks[max(0, bisect.bisect_left(firsts, head) - 1) : bisect.bisect_right(firsts, head)]
                keys += [k] * len(to)
                own += to
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(keys, pa.string())], ["block", "surt"])

    return run


def _search(keys: pa.Table, block: pa.Table) -> pa.Table:
    """Byte ranges of the keys that a block has, by bisection."""
    hits = []
    lines = read_block(block.column("data")[0].as_py()) if keys.num_rows and block.num_rows else []
    for k in keys.column("surt").to_pylist():
        at = bisect.bisect_left(lines, k, key=lambda r: r[0])
        while at < len(lines) and lines[at][0] == k:
            hits.append((lines[at][1], int(lines[at][2]), int(lines[at][3])))
            at += 1
    cols = list(zip(*hits, strict=True)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "offset", "length"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers"]
    for batch in batches:
        for data, wanted in zip(batch.column("data"), batch.column("wanted").to_pylist(), strict=True):
            view, rows = memoryview(data.as_buffer()), []
            for w in wanted:
                head, http, payload = read_record(view[w["offset"] : w["offset"] + w["length"]])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response":
                    size = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"a payload differs from its digest: {head['warc-record-id']}")
                else:
                    size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                own, refers = (None if (x := head.get(k)) is None else unquote(x) for k in ("x-page-key", "x-refers-to-key"))
                rows.append((own, size, digest, head["warc-type"], refers))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


@dataclass
class Capture:
    """Archive segments (bucketed by archive), index blocks, and the directory (first keys and blocks, in order)."""

    archives: DataFrame
    blocks: DataFrame
    directory: tuple[list[str], list[int]]

    def ranges(self, urls: DataFrame) -> DataFrame:
        """archive, offset, length of every capture of the URLs (the first column), through directory and blocks."""
        keys = urls.mapInArrow(_keys, "surt string").distinct().mapInArrow(_route(*self.directory), "block long, surt string")
        return keys.groupBy("block").cogroup(self.blocks.select("block", "data").groupBy("block")).applyInArrow(_search, "archive string, offset long, length long")

    def read(self, urls: DataFrame) -> DataFrame:
        """Every record of the URLs: key, payload_bytes, payload_digest, record_type, refers."""
        wanted = self.ranges(urls).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("wanted"))
        joined = self.archives.select("archive", "data").join(wanted.hint("shuffle_hash"), "archive").select("data", "wanted")
        return joined.mapInArrow(_parse, "key string, payload_bytes long, payload_digest string, record_type string, refers string")

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Records of one URL with their payloads."""
        spark = self.blocks.sparkSession
        out = []
        for archive, offset, length in self.ranges(spark.createDataFrame([(url,)], "url string")).collect():
            part = self.archives.where(F.col("archive") == archive).select(F.substring("data", int(offset) + 1, int(length))).first()[0]
            head, _, payload = read_record(bytes(part))
            out.append((head, payload))
        return out


def _with_firsts(src: DataFrame, least: int, hot: int, total: int) -> DataFrame:
    """``src`` (key, url, html, sha, n) with ``refers``: the least key of an equal payload, null for that one itself."""
    firsts = src.where(F.col("n") >= least).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("many")).where("many > 1")
    firsts = scratch.materialize(firsts, "firsts")
    common = firsts.where(F.col("many") > F.lit(total // hot)).select("sha", "first")  # at most ``hot`` payloads
    rare = firsts.where(F.col("many") <= F.lit(total // hot)).select("sha", "first")
    there = src.join(F.broadcast(common), "sha")
    moved = src.join(F.broadcast(common), "sha", "left_anti").join(rare.hint("shuffle_hash"), "sha", "left")
    refers = F.when((F.col("n") >= least) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    return there.select("key", "url", "html", refers.alias("refers")).union(moved.select("key", "url", "html", refers.alias("refers")))


def write_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", block_lines: int = BLOCK_LINES, hot: int = HOT) -> Capture:
    """Write archive segments and their two-level index to the shared folder.

    ``block_lines``: lines of an index block, more only where the directory would pass its bound.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    src = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("n"))
    total, size = src.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    marked = _with_firsts(src, least, hot, total)
    parts = min(max(-(-size // BUCKET_BYTES), LEAST_BUCKETS), BUCKETS)
    segments = marked.mapInArrow(_write(date), "archive string, data binary, entries array<struct<surt:string,offset:long,length:long>>")
    archives = scratch.bucketed(segments, "archives", "archive", parts)
    entries = archives.select("archive", F.explode("entries").alias("e")).select("e.surt", "archive", "e.offset", "e.length")
    lines = max(block_lines, -(-(archives.agg(F.sum(F.size("entries"))).first()[0] or 0) // DIRECTORY))
    ordered = entries.repartitionByRange(parts, "surt", "archive", "offset").sortWithinPartitions("surt", "archive", "offset")
    blocks = scratch.materialize(ordered.mapInArrow(_blocks(lines), "block long, first string, data binary"), "index")
    rows = sorted((r["first"], r["block"]) for r in blocks.select("first", "block").collect())  # bounded: see DIRECTORY
    return Capture(archives, blocks, ([f for f, _ in rows], [b for _, b in rows]))


def export(capture: Capture, folder: str) -> None:
    """Write each segment as ``<archive>.warc.gz`` below a folder that pyarrow's file systems reach from the executors."""

    def put(rows):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            with system.open_output_stream(f"{base}/{r['archive']}.warc.gz", compression=None) as f:
                f.write(bytes(r["data"]))

    capture.archives.select("archive", "data").foreachPartition(put)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    got = write_archives(pages).read(pages.select("url"))
    return got.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
first AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
digests AS (
  SELECT body, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS digest
  FROM (SELECT body, sha1(body) AS x FROM first))
SELECT page_id, octet_length(body) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN first USING (body) JOIN digests USING (body)
"""


def brute_force(pages: list[tuple]) -> list[tuple]:
    """The rows of op10 by plain loops, for tests."""
    first = {}
    for k, h in pages:
        p = (h or "").encode()
        if k is not None:
            first[p] = min(first.get(p, k), k)
    out = []
    for k, h in pages:
        p = (h or "").encode()
        again = p in first and first[p] != k
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return out
