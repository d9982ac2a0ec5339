"""FASTQ records of a stream of bytes, whole chunks at once, from any place of the file.

Lines are found and checked as arrays; only a record that isn't four plain lines is looked at by itself.  A malformed record
whose third line begins with ``+`` has four lines; any other ends before the next line that begins with ``@`` and is
followed by bases and a ``+`` line.  So one fault is one record, and mates stay in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..functions import nt
from .ranges import END, Source

#: Characters of bases; those beyond ASCII are written as the letter of their set.
_BASE = nt.FROM_ASCII != 0
_PLAIN = _BASE & (np.arange(256) < 128)
_LETTER = bytes(i if i < 128 else int(nt.TO_ASCII[nt.FROM_ASCII[i]]) for i in range(256))
_BASES = bytes(np.flatnonzero(_BASE).astype(np.uint8))


def fault(head: bytes, seq: bytes, plus: bytes, qual: bytes) -> str | None:
    """The log code of what is wrong with four lines."""
    if head[:1] != b"@":
        return "BADID"
    if seq.translate(None, _BASES):
        return "BADNT"
    if plus[:1] != b"+":
        return "READLEN" if plus[:1] and plus[0] in _BASES else "BADSEQ"
    return "NOQUAL" if len(seq) != len(qual) else None


@dataclass
class Columns:
    """Records: header, bases and qualities, or the code of a fault."""

    header: pa.Array
    seq: pa.Array
    qual: pa.Array
    fault: pa.Array

    def __len__(self) -> int:
        return len(self.header)

    def slice(self, at: int, n: int | None = None) -> Columns:
        return Columns(*(c.slice(at, n) for c in (self.header, self.seq, self.qual, self.fault)))


def _text(a: pa.Array) -> pa.Array:
    try:
        return a.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in a.to_pylist()], pa.string())


@dataclass
class Scanner:
    """Records whose first line begins before position ``end``; ``following`` is that of the first record behind them, ``count`` their number."""

    chunks: Iterator[tuple[int, bytes]]
    end: int = END
    #: Only count: lines are checked as far as they decide where records begin.
    count_only: bool = False
    #: Note the position of a record about every so many bytes.
    mark_bytes: int = 0
    count: int = 0
    following: int = END
    marks: list[tuple[int, int]] = field(default_factory=list)
    #: The last record had too few lines, or its end isn't known as nothing followed.
    unfinished: bool = False
    _mark: int = -1
    _window: int = 1 << 12
    _buf: bytes = b""
    _at: int = 0
    _index: list[int] = field(default_factory=list)
    _where: list[int] = field(default_factory=list)
    _over: bool = False
    _passed: int = 0

    def more(self) -> bool:
        """Append a chunk; what was passed is dropped."""
        got = next(self.chunks, None)
        if got is None:
            self._over = True
            return False
        keep = max(0, int(np.searchsorted(self._index, self._at, "right")) - 1)
        self._where = [w + max(0, self._at - i) if k == 0 else w for k, (i, w) in enumerate(zip(self._index[keep:], self._where[keep:], strict=True))]
        self._index = [max(0, i - self._at) for i in self._index[keep:]]
        self._buf = self._buf[self._at :]
        self._passed += self._at
        self._index.append(len(self._buf))
        self._where.append(got[0])
        self._buf += got[1]
        self._at = 0
        return True

    def where(self, i: int | np.ndarray):
        """Positions of places in the buffer."""
        k = np.maximum(np.searchsorted(self._index, i, "right") - 1, 0)
        return np.asarray(self._where, np.int64)[k] + (i - np.asarray(self._index, np.int64)[k])

    def peek(self, n: int) -> list[tuple[bytes, int]]:
        """Up to n lines from here on, without line ends, and the places behind them."""
        while True:
            out, i = [], self._at
            while len(out) < n and (j := self._buf.find(b"\n", i)) >= 0:
                out.append((self._buf[i:j].rstrip(b"\r"), j + 1))
                i = j + 1
            if len(out) == n:
                return out
            if self._over or not self.more():
                if i < len(self._buf):
                    out.append((self._buf[i:].rstrip(b"\r"), len(self._buf)))
                return out

    def find_first(self) -> bool:
        """Go to the first record behind the line that is being read; False if none begins before ``end``."""
        self.peek(1)
        first = True
        while True:
            lines = self.peek(3)
            if not lines or (not first and int(self.where(self._at)) >= self.end):
                return False
            if not first and lines[0][0][:1] == b"@" and len(lines) > 2 and lines[2][0][:1] == b"+":
                return True
            self._at, first = lines[0][1], False

    def _tally(self, places: np.ndarray | list[int]) -> None:
        if self.mark_bytes:
            for k in np.flatnonzero(np.diff((np.asarray(places) + self._passed) // self.mark_bytes, prepend=self._mark)):
                self.marks.append((self.count + int(k), int(self.where(int(places[k])))))
                self._mark = (int(places[k]) + self._passed) // self.mark_bytes
        self.count += len(places)

    def _stop(self) -> None:
        self.following = int(self.where(self._at))

    def __iter__(self) -> Iterator[Columns]:
        if not self._buf and not self.more():
            return
        while True:
            done = yield from self._whole()
            if done or (done := (yield from self._single())):
                return

    def _whole(self) -> Iterator[Columns]:
        """Records of four plain lines, as far as the buffer has them; True at the end of the range."""
        while True:
            buf, base = self._buf, self._at
            a = np.frombuffer(buf, np.uint8)[base : base + self._window]  # grows while all is well, so that faults cost little
            cut = base + len(a) < len(buf)
            stop = np.flatnonzero(a == 10)
            k = len(stop) // 4
            if k:
                behind = base + int(stop[4 * k - 1]) + 1
                start = np.concatenate([[0], stop[:-1] + 1])[: 4 * k].reshape(k, 4)
                stop = stop[: 4 * k].reshape(k, 4)
                cr = (a[stop - 1] == 13) & (stop > start)
                stop = stop - cr
                odd = ((a[stop - 1] == 13) & (stop > start)).any(axis=1) if cr.any() else np.zeros(k, bool)
                full = stop > start
                good = ~odd & full[:, 0] & full[:, 2] & (a[start[:, 2]] == 43)
                if not self.count_only:
                    wrong = np.concatenate([[0], np.cumsum(~_PLAIN[a])])
                    good &= (a[start[:, 0]] == 64) & (stop[:, 1] - start[:, 1] == stop[:, 3] - start[:, 3]) & (wrong[stop[:, 1]] == wrong[start[:, 1]])
                n = k if good.all() else int(good.argmin())
                if n:
                    over = 0
                    if self.end < END and int(self.where(base + int(start[n - 1, 0]))) >= self.end:
                        inside = np.asarray(self.where(base + start[:n, 0])) < self.end
                        over, n = 1, int(inside.argmin())
                    if n:
                        self._tally(base + start[:n, 0])
                        if not self.count_only:
                            yield self._columns(buf, base, start[:n], stop[:n])
                    self._at = base + int(start[n, 0]) if over or n < k else behind
                    if over:
                        self._stop()
                        return True
                if n < k:
                    self._window = 1 << 12
                    return False
            if cut:
                self._window *= 4
            elif self._over or not self.more():
                return False

    @staticmethod
    def _columns(buf: bytes, base: int, start: np.ndarray, stop: np.ndarray) -> Columns:
        n = len(start)
        edges = np.stack([start[:, 0] + 1, stop[:, 0], start[:, 1], stop[:, 1], start[:, 3], stop[:, 3]], 1).ravel() + base
        parts = pa.Array.from_buffers(pa.binary(), 6 * n - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(buf)])
        at = np.arange(n) * 6
        head, seq, qual = (parts.take(pa.array(at + j)) for j in (0, 2, 4))
        return Columns(_text(head), seq.cast(pa.string()), _text(qual), pa.nulls(n, pa.string()))

    def _single(self) -> Iterator[Columns]:
        """One record that needs a closer look; True at the end."""
        while True:
            lines = self.peek(4)
            if not lines:
                return True
            if lines[0][0]:
                break
            self._at = lines[0][1]
        if int(self.where(self._at)) >= self.end:
            self._stop()
            return True
        self._tally([self._at])
        if len(lines) < 4:
            self.unfinished = True
            yield self._one(None, "EOF")
            return True
        four = [x for x, _ in lines]
        wrong = fault(*four)
        if four[2][:1] == b"+":
            self._at = lines[3][1]
        else:
            self._at = lines[0][1]
            while (ahead := self.peek(3)) and not (ahead[0][0][:1] == b"@" and len(ahead) > 2 and ahead[2][0][:1] == b"+"):
                self._at = ahead[0][1]
            self.unfinished = not ahead
        yield self._one(None if wrong else four, wrong)
        return False

    @staticmethod
    def _one(four: list[bytes] | None, wrong: str | None) -> Columns:
        text = (four[0][1:].decode(errors="replace"), four[1].translate(_LETTER).decode(), four[3].decode(errors="replace")) if four else (None,) * 3
        return Columns(*(pa.array([x], pa.string()) for x in (*text, wrong)))


def scan(source: Source, at: int = 0, skip: int = 0, **more) -> Iterator[Columns]:
    """Records from a position on where one begins, without the first ``skip``."""
    for c in Scanner(source.chunks(at), **more):
        if skip >= len(c):
            skip -= len(c)
        else:
            yield c.slice(skip)
            skip = 0


@dataclass
class Counted:
    """What a range of a file holds: position of its first record (None: none begins), that of the first behind it, their number, marks."""

    first: int | None
    following: int
    count: int
    marks: list[tuple[int, int]]


def count_range(source: Source, first: int, end: int, at: int | None = None, marks: int = 16) -> Counted:
    """Count the records that begin in bytes first to end; the first is looked for unless ``at`` gives it."""
    size = (source.size or 0) if first == 0 and end >= END else end - first
    more = {"end": source.position(end) if end < (source.size or END) else END, "count_only": True, "mark_bytes": max(1 << 16, size // marks)}
    if at is None and first == 0:
        at = 0
    scanner = Scanner(source.chunks(at) if at is not None else source.inner(first, end), **more)
    if at is None:
        if not scanner.more() or not scanner.find_first():
            return Counted(None, END, 0, [])
        at = int(scanner.where(scanner._at))
    for _ in scanner:
        pass
    return Counted(at, scanner.following, scanner.count, scanner.marks)

