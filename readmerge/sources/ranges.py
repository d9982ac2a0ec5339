"""Bytes of files from any place on: local paths, URIs of pyarrow's file systems, URLs; plain, gzip or bzip2 by first bytes.

A :class:`Source` tells where its content can be cut, and yields it from a position on.  Positions are whole numbers that
grow with the content: the byte of a plain file; the byte behind decompression of a gzip file, which can't be cut; and for a
bzip2 file the bit where a block begins, times 2**26, plus the byte inside the block.

bzip2 blocks are decoded on their own.  A block begins with a mark of 48 bits at any bit; the bits up to the next mark, put
between a stream's head and tail, are a stream of one block, which the library checks by its CRC.  Marks that occur inside a
block by chance fail that check and are passed over.
"""

from __future__ import annotations

import bz2
import gzip
import http.client
import io
import time
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.error import HTTPError
from urllib.parse import urlparse
from urllib.request import Request, urlopen

import numpy as np

CHUNK = 1 << 20
#: Position behind everything.
END = 1 << 62
#: Bits of the place inside a bzip2 block (one block can grow to 47 MB by runs).
INSIDE = 26


class FileChanged(OSError):
    """A file isn't the one that was planned or begun."""


class HttpFile(io.RawIOBase):
    """A file behind a URL that survives lost connections.

    After an error, a time-out or an early end it asks for the rest by a range, on the condition that the entity tag (or the time of
    change) is the same; servers without ranges send the whole file again, and what is known already is passed over.
    """

    def __init__(self, url: str, offset: int = 0, tag: str | None = None, timeout: float = 30.0, retries: int = 5, wait: float = 0.25):
        self.url, self.at, self.tag, self.timeout, self.retries, self.wait = url, offset, tag, timeout, retries, wait
        self.size: int | None = None
        self.ranges = False
        self._answer = None
        self._try(self._open)

    def readable(self) -> bool:
        return True

    def _open(self) -> None:
        head = {"Range": f"bytes={self.at}-", "Accept-Encoding": "identity"}
        if self.tag and not self.tag.startswith("W/"):
            head["If-Range"] = self.tag
        try:
            answer = urlopen(Request(self.url, headers=head), timeout=self.timeout)  # noqa: S310
        except HTTPError as e:
            if e.code == 416 and self.size is None:  # the offset is the file's end, or the file is empty
                total = e.headers.get("Content-Range", "").rpartition("/")[2]
                if total.isdigit() and int(total) <= self.at:
                    self.size, self.ranges, self._answer = int(total), True, io.BytesIO()
                    return
            if e.code < 500 and e.code not in (408, 429):
                raise FileNotFoundError(f"{self.url}: {e}") from e
            raise
        found = answer.headers.get("ETag") or answer.headers.get("Last-Modified")
        self.ranges = answer.status == 206
        length = answer.headers.get("Content-Length")
        size = int(answer.headers["Content-Range"].rpartition("/")[2]) if self.ranges else int(length) if length else None
        if (self.tag and found != self.tag) or (self.size is not None and size != self.size):
            raise FileChanged(f"{self.url} has changed")
        self.tag, self.size, self._answer = found, size, answer
        left = 0 if self.ranges else self.at
        while left:
            got = len(answer.read(min(left, CHUNK)))
            if not got:
                raise ConnectionError(f"{self.url} ended early")
            left -= got

    def _try(self, step):
        for n in range(self.retries + 1):
            try:
                if self._answer is None and step != self._open:
                    self._open()
                return step()
            except (FileChanged, FileNotFoundError):
                raise
            except (OSError, http.client.HTTPException) as e:
                self._answer = None
                if n == self.retries:
                    raise ConnectionError(f"{self.url}: {e} (byte {self.at}, {n + 1} attempts)") from e
                time.sleep(self.wait * 2**n)

    def read(self, n: int = -1) -> bytes:
        if n < 0:
            return b"".join(iter(lambda: self.read(CHUNK), b""))

        def step() -> bytes:
            data = self._answer.read(n)
            if not data and n and self.size is not None and self.at < self.size:
                raise ConnectionError("ended early")
            self.at += len(data)
            return data

        return self._try(step)

    def close(self) -> None:
        if self._answer is not None:
            self._answer.close()
        super().close()

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def open_at(path: str, offset: int = 0, tag: str | None = None):
    """A stream of a file's own bytes from an offset on."""
    if is_url(path):
        return HttpFile(path, offset, tag)
    if path.startswith("file:/"):
        f = open(urlparse(path).path, "rb")
    elif "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        f = system.open_input_file(inner)
    else:
        f = open(path, "rb")
    f.seek(offset)
    return f


def open_bytes(path: str, tag: str | None = None) -> io.BufferedIOBase:
    """A stream of a plain, gzip or bzip2 file."""
    raw = open_at(path, 0, tag)
    raw = raw if hasattr(raw, "peek") else io.BufferedReader(raw)
    magic = raw.peek(3)[:3]
    if magic[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if magic == b"BZh" else raw


# --- bzip2 ----------------------------------------------------------------------------------------------------------

# The marks in front of a block and of a stream's tail.
BLOCK, TAIL = 0x314159265359, 0x177245385090
#: Bytes that a compressed block has at most (900,000 bytes that can't be compressed, with its tables).
LONGEST = 1_400_000
#: Bytes that are searched for marks at once.
STEP = 1 << 17


def _patterns() -> list[tuple[int, int, bytes, int, int, int, int]]:
    """For each mark and bit: the bytes that a mark fills wholly, and the masks and values of the bytes beside them."""
    out = []
    for mark in (BLOCK, TAIL):
        for shift in range(8):
            seven = (mark << (8 - shift)).to_bytes(7, "big")
            first, last = (0xFF >> shift) & 0xFF, (0xFF00 >> shift) & 0xFF
            out.append((mark, shift, seven[1:6], first, seven[0], last, seven[6]))
    return out


_PATTERNS = _patterns()


def find_marks(data: bytes) -> list[tuple[int, int]]:
    """(bit, mark) of every mark in some bytes, in order."""
    found = []
    for mark, shift, middle, first_mask, first, last_mask, last in _PATTERNS:
        i = data.find(middle, 1)
        while i >= 0:
            after = data[i + 5] if i + 5 < len(data) else None
            if data[i - 1] & first_mask == first and (last_mask == 0 or after is not None and after & last_mask == last):
                found.append(((i - 1) * 8 + shift, mark))
            i = data.find(middle, i + 1)
    return sorted(found)


def one_block(data: bytes, start: int, end: int) -> bytes:
    """The content of the block in bits start to end of some bytes; ValueError if that isn't a block."""
    a = np.frombuffer(data, np.uint8)[start >> 3 : (end >> 3) + 2].astype(np.uint16)
    shift, n = start & 7, end - start
    a = np.concatenate([a, np.zeros(1, np.uint16)])
    bits = (((a[:-1] << 8 | a[1:]) >> (8 - shift)) & 0xFF).astype(np.uint8).tobytes()
    whole, rest = n >> 3, n & 7
    crc = int.from_bytes(bits[6:10], "big")
    tail = (TAIL << 32 | crc) | ((bits[whole] >> (8 - rest)) << 80 if rest else 0)
    pad = -(rest + 80) % 8
    try:
        return bz2.decompress(b"BZh9" + bits[:whole] + (tail << pad).to_bytes((rest + 80 + pad) // 8, "big"))
    except (OSError, EOFError) as e:
        raise ValueError(str(e)) from e


class _Window:
    """Bytes of a file around a moving place."""

    def __init__(self, source: Source):
        self.source, self.base, self.data, self.file = source, 0, b"", None

    def get(self, first: int, end: int) -> bytes:
        """Bytes first to end (fewer at the file's end); they stay in the window from ``first`` on."""
        if self.file is None or not self.base <= first <= self.base + len(self.data):
            self.file, self.base, self.data = open_at(self.source.path, first, self.source.tag), first, b""
        self.data, self.base = self.data[first - self.base :], first
        parts, have = [self.data], len(self.data)
        while have < end - first and (more := self.file.read(max(CHUNK, end - first - have))):
            parts.append(more)
            have += len(more)
        self.data = b"".join(parts)
        return self.data[: end - first]


class _Blocks:
    """Blocks of a bzip2 file one after another from a bit on; bytes are searched for marks once, a little at a time."""

    def __init__(self, source: Source):
        self.source, self.window = source, _Window(source)
        self.low = self.high = 0  # bytes that were searched
        self.known: list[tuple[int, int]] = []
        self.over = False
        self.last: tuple[int, tuple[bytes, int] | None] = (-1, None)

    def _next(self, bit: int, limit: int, keep: int) -> tuple[int, int] | None:
        """The first mark at or behind a bit that begins before byte ``limit``; the window stays from ``keep`` on."""
        if not self.low <= bit >> 3 <= self.high:
            self.low = self.high = bit >> 3
            self.known, self.over = [], False
        while True:
            i = bisect_left(self.known, (bit, 0))
            if i < len(self.known):
                return self.known[i] if self.known[i][0] < limit * 8 else None
            if self.over or self.high >= limit:
                return None
            first = min(max(keep, self.high - LONGEST), self.high)
            data = self.window.get(first, self.high + STEP + 6)[self.high - first :]  # a mark can reach over 7 bytes
            self.over = len(data) < STEP + 6
            self.known += [(self.high * 8 + b, m) for b, m in find_marks(data) if self.over or b < STEP * 8]
            self.high += len(data) if self.over else STEP

    def block(self, bit: int) -> tuple[bytes, int] | None:
        """Content of the block at a bit and the bit of the next mark; None if there is no block."""
        if self.last[0] != bit:
            self.last = bit, self._block(bit)
        return self.last[1]

    def _block(self, bit: int) -> tuple[bytes, int] | None:
        base = bit >> 3
        limit = base + LONGEST
        if self._next(bit, limit, base) != (bit, BLOCK):
            return None
        end = bit
        while (mark := self._next(end + 1, limit, base)) is not None:
            end = mark[0]
            try:
                return one_block(self.window.get(base, (end >> 3) + 2), bit - base * 8, end - base * 8), end
            except ValueError:
                continue
        return None

    def after(self, bit: int) -> int | None:
        """The block at a mark's bit, or the first of the next stream if the mark is that of a tail; None at the end."""
        while True:
            base = bit >> 3
            mark = (int.from_bytes(self.window.get(base, base + 7).ljust(7, b"\0"), "big") >> (8 - (bit & 7))) & ((1 << 48) - 1)
            if mark == BLOCK:
                return bit
            at = -(-(bit + 80) // 8)
            if mark != TAIL or self.window.get(at, at + 3) != b"BZh":
                return None  # the end, or bytes behind the last stream, which don't count
            bit = (at + 4) * 8

    def first(self, byte: int, end: int) -> int | None:
        """The bit of the first block that begins in bytes ``byte`` to ``end``."""
        bit = byte * 8
        while (mark := self._next(bit, end, bit >> 3)) is not None:
            if mark[1] == BLOCK and self.block(mark[0]) is not None:
                return mark[0]
            bit = mark[0] + 1
        return None

    def chunks(self, at: int) -> Iterator[tuple[int, bytes]]:
        bit, inside = at >> INSIDE, at & ((1 << INSIDE) - 1)
        while bit is not None:
            found = self.block(bit)
            if found is None:
                raise OSError(f"{self.source.path}: no sound bzip2 block at bit {bit}")
            data, mark = found
            for i in range(inside, len(data), CHUNK):
                yield (bit << INSIDE) + i, data[i : i + CHUNK]
            bit, inside = self.after(mark), 0


# --- sources --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    """A file as it was found: path, own bytes, kind (plain, stream, bzip2) and the tag that tells whether it has changed."""

    path: str
    size: int | None
    kind: str
    tag: str | None = None

    @staticmethod
    def of(path: str, split: bool = True) -> Source:
        """Looks at a file; ``split`` False: it is read in one piece."""
        f = open_at(path)
        if is_url(path):
            size, tag, seek = f.size, f.tag, f.ranges and f.size is not None
        else:
            size, tag, seek = f.seek(0, 2), None, True
            f.seek(0)
        magic = f.read(3)
        f.close()
        kind = "bzip2" if magic == b"BZh" else "stream" if magic[:2] == b"\x1f\x8b" else "plain"
        return Source(path, size, kind if seek and (split or kind == "plain") else "stream", tag)

    def asdict(self) -> dict:
        return asdict(self)

    def cuts(self, size: int) -> list[tuple[int, int]]:
        """Ranges (first byte, end) of the file's own bytes, about ``size`` each; one if it can't be cut."""
        if self.kind == "stream" or not self.size:
            return [(0, END)]
        n = max(1, round(self.size / size))
        edges = [self.size * i // n for i in range(n + 1)]
        return list(zip(edges, edges[1:], strict=False))

    def position(self, byte: int) -> int:
        """The least position of content at or behind one of the file's own bytes."""
        return byte << (3 + INSIDE) if self.kind == "bzip2" and byte < END else byte

    def chunks(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(position, bytes) of the content from a position on."""
        if self.kind == "bzip2":
            blocks = _Blocks(self)
            if at == 0 and (at := blocks.after(32)) is not None:
                at <<= INSIDE
            if at is not None:
                yield from blocks.chunks(at)
            return
        if self.kind == "stream":
            f, skip, here = open_bytes(self.path, self.tag), at, 0
        else:
            f, skip, here = open_at(self.path, at, self.tag), 0, at
        with f:
            while data := f.read(CHUNK):
                if here + len(data) > skip:
                    cut = max(0, skip - here)
                    yield here + cut, data[cut:]
                here += len(data)

    def inner(self, first: int, end: int) -> Iterator[tuple[int, bytes]]:
        """As :meth:`chunks`, from somewhere in the first line that begins behind byte ``first`` on, or a little before."""
        if self.kind == "bzip2":
            blocks = _Blocks(self)
            bit = blocks.first(first, end)
            if bit is not None:
                yield from blocks.chunks(bit << INSIDE)
        else:
            yield from self.chunks(first - 1)
