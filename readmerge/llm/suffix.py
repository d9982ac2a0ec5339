"""Exact removal of long repeats by a family of sparse suffix arrays with geometrically merged levels.

Every byte covered by a ``span``-byte string that also starts in a document with a smaller key is removed.

A string of ``span`` bytes is represented by the place of its least k-byte hash (k = 16), so consecutive strings share a
place and a document has about one place for 18 bytes.  A place carries the hash of its k bytes and of the whole
stretch of strings it stands for.  The suffixes at these places form the index; only equality matters, so suffixes are
ordered by their hashes instead of letter by letter.  Each hash bucket takes documents in batches of ascending key: a
batch is sorted, merge-scanned against the existing levels (which hold smaller keys only), then becomes a level, and
levels of equal size merge.

* A stretch found in a smaller document (equal 64-bit hashes of place and of stretch) is removed as a whole.
* A place whose k bytes other documents have too, but whose stretch is new, is looked at more closely.  A string that
  holds the place either holds (span - k) / 2 more bytes before it or as many behind it; hashes of these two longer pieces
  are compared over all documents, which clears nearly all places that agree by chance.
* Strings of the halves that are left are compared one by one in a last exchange.  The least document that has a string
  never has it in a stretch that was found, so it always takes part.
* Places whose k bytes stand in one document only need nothing.

Defined cases: null counts as empty; texts shorter than ``span`` lose nothing; equal texts of larger keys are removed
whole; rows of equal key do not remove from each other; a null key is larger than all others.  Keys are whole numbers; others
are refused.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from . import classes as cl, scratch, text as tx
from .decontaminate import found

SPAN, K = 50, 16
#: Stretches of one place that a group sends to a bucket; others of the group are decided string by string.
SENT = 8
BATCHES = 8
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Prefix:
    """Prefix sums of a slice's bytes; hashes of any spans of it."""

    def __init__(self, buf: np.ndarray):
        self.p, self.inv = tx.powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.c = np.zeros(len(buf) + 1, tx.U64)
            np.cumsum(tx.BYTE_VALUE[buf] * self.p[: len(buf)], out=self.c[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k bytes from each byte on."""
        with np.errstate(over="ignore"):
            return tx.mix((self.c[k:] - self.c[:-k]) * self.inv[: len(self.c) - k] + tx.U64(k))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tx.mix((self.c[end] - self.c[start]) * self.inv[start] + (end - start).astype(tx.U64))


@dataclass
class Stretches:
    """Stretches of a slice: hash of the place, hash of the stretch, first string, number of strings, the place, text."""

    h: np.ndarray
    seg: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    doc: np.ndarray


def stretches(buf: np.ndarray, off: np.ndarray, span: int = SPAN, k: int = K) -> Stretches:
    last = np.maximum(off[1:] - span + 1, off[:-1])  # where the strings of each text end
    if not (last > off[:-1]).any():
        z = np.zeros(0, np.int64)
        return Stretches(np.zeros(0, tx.U64), np.zeros(0, tx.U64), z, z, z, z)
    hashes = Prefix(buf)
    h = hashes.grams(k)
    mask = tx.U64(0xFFFFFFFF)
    least = tx.slide((h & ~mask) | np.arange(len(h), dtype=tx.U64), span - k + 1, np.minimum) & mask  # the leftmost of equals
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    some = last > off[:-1]
    new[off[:-1][some]] = True
    inside = np.zeros(len(least) + 1, np.int8)
    inside[off[:-1][some]] += 1
    inside[last[some]] -= 1
    first = np.flatnonzero(new & np.cumsum(inside, dtype=np.int8)[:-1].view(bool))
    doc = np.searchsorted(off, first, "right") - 1
    count = np.minimum(np.append(first[1:], len(least)), last[doc]) - first
    place = least[first].astype(np.int64)
    seg = hashes.spans(first, first + count - 1 + span)
    return Stretches(h[place], seg, first, count, place, doc)


def first_of(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


class Group:
    """A group's texts with their stretches, and what it sends to buckets."""

    def __init__(self, blocks: list[bytes], span: int):
        self.texts, self.span = cl.Texts(blocks), span
        t = self.texts
        self.slices = list(tx.slices(t.off))
        parts = []
        for lo, hi in self.slices:
            s = stretches(t.buf[t.off[lo] : t.off[hi]], t.off[lo : hi + 1] - t.off[lo], span)
            parts.append((s.h, s.seg, t.key[s.doc + lo], s.first + t.off[lo], s.count, s.place + t.off[lo]))
        self.h, self.seg, self.key, self.first, self.count, self.place = (np.concatenate(x) for x in zip(*parts, strict=True))
        # distinct stretches of the group, each with its least key
        order = tx.ordered(self.h, self.seg, self.key)
        new = first_of(self.h[order], self.seg[order])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        lead = order[new]
        self.gh, self.gseg, self.gkey = self.h[lead], self.seg[lead], self.key[lead]
        self.found_here = self.key > self.gkey[self.of]
        by_key = tx.ordered(self.gh, self.gkey, self.gseg)
        start = np.maximum.accumulate(np.where(first_of(self.gh[by_key]), np.arange(len(by_key)), 0))
        self.sent = np.zeros(len(by_key), bool)
        self.sent[by_key] = np.arange(len(by_key)) - start < SENT

    def places(self, buckets: int):
        """(bucket, distinct stretches) in the order in which they are sent."""
        some = np.flatnonzero(self.sent)
        some = some[np.argsort(self.gkey[some], kind="stable")]  # they are in order of hash already
        for b, part in cl.parts_of(*cl.by_bucket(self.gh[some], buckets)):
            yield b, some[part]

    def take(self, replies: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch: found in a smaller document; to be decided string by string."""
        hit, shared = np.zeros(len(self.gh), bool), ~self.sent
        for b, part in self.places(buckets):
            if b in replies:
                full, more = (np.unpackbits(x, count=len(part)).astype(bool) for x in cl.unpack(replies[b]))
                hit[part], shared[part] = full, more | full
        word = np.cumsum(first_of(self.gh)) - 1  # distinct stretches are in order of hash
        any_shared = np.zeros(word[-1] + 1 if len(word) else 0, bool)
        any_shared[word[shared]] = True
        full = self.found_here | hit[self.of]
        return full, any_shared[word][self.of] & ~full if len(word) else full

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of the group's bytes, each inside one text; ``start`` must be sorted."""
        t = self.texts
        out = []
        for lo, hi in self.slices:
            a, b = np.searchsorted(start, [t.off[lo], t.off[hi]])
            if b > a:
                out.append(Prefix(t.buf[t.off[lo] : t.off[hi]]).spans(start[a:b] - t.off[lo], end[a:b] - t.off[lo]))
        return np.concatenate(out) if out else np.zeros(0, tx.U64)


class Compared:
    """Hashes to be compared over all documents: the distinct ones of a group, each with its least key.

    ``more``: further bits of each hash; ``several``: the group has it under different keys.
    """

    def __init__(self, h: np.ndarray, more: np.ndarray, key: np.ndarray):
        order = tx.ordered(h, more, key)
        new = first_of(h[order], more[order])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        lead = order[new]
        self.h, self.more, self.key = h[lead], more[lead], key[lead]
        self.larger = key > self.key[self.of]
        self.several = np.zeros(len(lead), bool)
        self.several[self.of[self.larger]] = True

    def places(self, buckets: int):
        some = np.argsort(self.key, kind="stable")  # they are in order of hash already
        for b, part in cl.parts_of(*cl.by_bucket(self.h[some], buckets)):
            yield b, some[part]

    def send(self, me: int, buckets: int) -> pa.Table:
        return cl.block_table([(b, me, cl.pack(self.h[p], self.more[p], cl.deltas(self.key[p]), np.packbits(self.several[p]))) for b, p in self.places(buckets)])

    def take(self, replies: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct hash: a smaller key has it; any other key has it."""
        less, other = np.zeros(len(self.h), bool), self.several.copy()
        for b, part in self.places(buckets):
            if b in replies:
                x, y = (np.unpackbits(v, count=len(part)).astype(bool) for v in cl.unpack(replies[b]))
                less[part], other[part] = x, y | self.several[part]
        return less, other


class Halves(Compared):
    """The longer pieces before and behind the places of some stretches, and the strings that hold them."""

    def __init__(self, g: Group, which: np.ndarray):
        half = (g.span - K) // 2
        left = np.clip(g.place[which] - half - g.first[which] + 1, 0, g.count[which])
        right = g.count[which] - left
        a, b = which[left > 0], which[right > 0]
        self.group, self.stretch = g, np.concatenate([a, b])
        self.first = np.concatenate([g.first[a], (g.first[which] + left)[right > 0]])
        self.count = np.concatenate([left[left > 0], right[right > 0]])
        h = np.concatenate([g.hashes(g.place[a] - half, g.place[a] + K), ~g.hashes(g.place[b], g.place[b] + g.span - half + 1)])
        super().__init__(h, (g.h[self.stretch] & tx.U64(0xFFFFFFFF)).astype(np.uint32), g.key[self.stretch])

    def strings(self, replies: dict[int, bytes], buckets: int) -> Strings:
        some = np.flatnonzero(self.take(replies, buckets)[1][self.of])
        return Strings(self.group, self.stretch[some], self.first[some], self.count[some])


class Strings(Compared):
    """Strings that are decided one by one; ``at``: where each starts."""

    def __init__(self, g: Group, stretch: np.ndarray, first: np.ndarray, count: np.ndarray):
        order = np.argsort(first)
        stretch, first, count = stretch[order], first[order], count[order]
        self.at = tx.expand(first, count)
        owner = np.repeat(stretch, count)
        super().__init__(g.hashes(self.at, self.at + g.span), (g.h[owner] & tx.U64(0xFFFFFFFF)).astype(np.uint32), g.key[owner])

    def found(self, replies: dict[int, bytes], buckets: int) -> np.ndarray:
        """Starts of the strings that a smaller document has."""
        return self.at[self.larger | self.take(replies, buckets)[0][self.of]]


def _merged(a: np.ndarray, b: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Two sorted arrays merged into one, and columns of both in the same order; nothing is sorted anew."""
    at = np.searchsorted(a, b, "right") + np.arange(len(b))
    rest = np.ones(len(a) + len(b), bool)
    rest[at] = False
    out = []
    for x, y in ((a, b), *columns):
        z = np.empty(len(rest), x.dtype)
        z[at], z[rest] = y, x
        out.append(z)
    return out


@dataclass
class Level:
    """Distinct suffixes of earlier batches: places with their entries, in order, and stretches with their places, in order."""

    h: np.ndarray
    ids: np.ndarray
    pair: np.ndarray
    pair_h: np.ndarray

    @staticmethod
    def of(h: np.ndarray, pair: np.ndarray, ids: np.ndarray) -> Level:
        order, by_pair = np.argsort(h, kind="stable"), np.argsort(pair)
        return Level(h[order], ids[order].astype(np.int32), pair[by_pair], h[by_pair])

    def __len__(self) -> int:
        return len(self.h)

    def has(self, h: np.ndarray, pair: np.ndarray) -> np.ndarray:
        at = found(self.pair, pair)
        hit = at >= 0
        hit[hit] = self.pair_h[at[hit]] == h[hit]
        return hit

    def merge(self, other: Level) -> Level:
        return Level(*_merged(self.h, other.h, (self.ids, other.ids)), *_merged(self.pair, other.pair, (self.pair_h, other.pair_h)))


def scan_levels(h: np.ndarray, seg: np.ndarray, key: np.ndarray, batches: int = BATCHES) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: its stretch stands in a smaller document; another document has its k bytes."""
    n = len(h)
    full, shared = np.zeros(n, bool), np.zeros(n, bool)
    with np.errstate(over="ignore"):  # of one place, different stretches have different values
        pair = tx.mix(h * tx.U64(0x9E3779B97F4A7C15) + seg.astype(tx.U64) * tx.U64(0xD6E8FEB86659FD93))
    by_key = np.argsort(key, kind="stable")
    sorted_key = key[by_key]
    cuts = np.searchsorted(sorted_key, sorted_key[[n * i // batches for i in range(1, batches)]]) if n else []
    levels: list[Level] = []
    for ids in np.split(by_key, np.unique(cuts)):
        if not len(ids):
            continue
        b = ids[tx.ordered(h[ids], seg[ids], key[ids])]  # the batch's suffix array
        new_h, new = first_of(h[b]), first_of(h[b], seg[b])
        at = np.flatnonzero(new_h)
        low, high = np.minimum.reduceat(key[b], at), np.maximum.reduceat(key[b], at)
        owner = b[new]
        full[b] = key[b] > key[owner][np.cumsum(new) - 1]
        several = high > low
        fresh = np.ones(len(owner), bool)
        for level in levels:
            left, right = np.searchsorted(level.h, h[b[at]]), np.searchsorted(level.h, h[b[at]], "right")
            several |= right > left
            shared[level.ids[tx.expand(left, right - left)]] = True
            fresh &= ~level.has(h[owner], pair[owner])
        shared[b] = several[np.cumsum(new_h) - 1]
        full[b] |= ~fresh[np.cumsum(new) - 1]
        levels.append(Level.of(h[owner[fresh]], pair[owner[fresh]], owner[fresh]))
        while len(levels) > 1 and len(levels[-2]) <= len(levels[-1]) * 2:
            last = levels.pop()
            levels[-1] = levels[-1].merge(last)
    return full, shared


def _gather(table: pa.Table) -> tuple[list[list[np.ndarray]], list[int]]:
    order = np.argsort(table.column("source").to_numpy())
    data = cl.blocks_of(table)
    return [cl.unpack(data[i]) for i in order], table.column("source").to_numpy()[order].tolist()


#: Answers of the three exchanges are told apart by their source.
ROUND = 1 << 25


def _round(table: pa.Table, k: int) -> dict[int, bytes]:
    """Answers of one exchange by bucket."""
    source = table.column("source").to_numpy()
    return {s - k * ROUND: d for s, d in cl.answers(table.filter(pa.array(source // ROUND == k))).items()}


def _rows(parts: list[list[np.ndarray]], sources: list[int], bucket: int, *flags: np.ndarray) -> pa.Table:
    """Flags of entries back to the groups that sent them."""
    bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
    return cl.block_table([(s, bucket, cl.pack(*(np.packbits(f[a:b]) for f in flags))) for s, a, b in zip(sources, bounds[:-1], bounds[1:], strict=True)])


@dataclass
class Left:
    """A group's texts, and of each the removed bytes, the removed runs and where in ``kept`` the rest starts."""

    texts: cl.Texts
    removed: np.ndarray
    spans: np.ndarray
    kept: np.ndarray
    at: np.ndarray

    def body(self, i: int) -> bytes:
        return self.kept[self.at[i] : self.at[i + 1]].tobytes()


def _decided(src: DataFrame, n: int, span: int):
    """Blocks of the texts (columns key, text) in ``n`` groups, answers of the three exchanges by group, and the function
    that makes a :class:`Left` of both."""
    buckets = cl.bucket_count(n)
    texts = cl.deal(src, n)

    def send(table):
        g = Group(cl.blocks_of(table), span)
        me = table.column("group")[0].as_py()
        return cl.block_table([(b, me, cl.pack(g.gh[p], g.gseg[p], cl.deltas(g.gkey[p]))) for b, p in g.places(buckets)])

    def match(table):
        parts, sources = _gather(table)
        h, seg, k = (np.concatenate(x) for x in zip(*((p[0], p[1], cl.undelta(p[2])) for p in parts), strict=True))
        return _rows(parts, sources, table.column("group")[0].as_py(), *scan_levels(h, seg, k))

    def compare(k: int):
        def run(table):
            parts, sources = _gather(table)
            h, more, key = (np.concatenate(x) for x in zip(*((p[0], p[1], cl.undelta(p[2])) for p in parts), strict=True))
            several = np.concatenate([np.unpackbits(p[3], count=len(p[0])) for p in parts]).astype(bool)
            order = tx.ordered(h, more, key)
            new = first_of(h[order], more[order])
            same = np.cumsum(new) - 1
            less, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
            less[order] = key[order] > key[order[new]][same]
            other[order] = np.bincount(same, less[order] | several[order])[same] > 0
            return _rows(parts, sources, table.column("group")[0].as_py() + k * ROUND, less, other)

        return run

    def state(left, right) -> tuple[Group, np.ndarray, Halves]:
        g = Group(cl.blocks_of(left), span)
        full, check = g.take(_round(right, 0), buckets)
        return g, full, Halves(g, np.flatnonzero(check))

    def send_halves(left, right):
        if not left.num_rows:
            return cl.block_table([])
        return state(left, right)[2].send(left.column("group")[0].as_py(), buckets)

    def send_strings(left, right):
        if not left.num_rows:
            return cl.block_table([])
        return state(left, right)[2].strings(_round(right, 1), buckets).send(left.column("group")[0].as_py(), buckets)

    def rest(left, right) -> Left:
        g, full, halves = state(left, right)
        at = halves.strings(_round(right, 1), buckets).found(_round(right, 2), buckets)
        t = g.texts
        cover = np.zeros(len(t.buf) + 1, np.int32)
        np.add.at(cover, g.first[full], 1)
        np.add.at(cover, g.first[full] + g.count[full] - 1 + span, -1)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + span, -1)
        gone = np.cumsum(cover)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = t.off[:-1][t.off[:-1] < len(gone)]
        begins[inner] = gone[inner]
        removed = np.concatenate([[0], np.cumsum(gone)])[t.off]
        spans = np.concatenate([[0], np.cumsum(begins)])[t.off]
        return Left(t, np.diff(removed), np.diff(spans), t.buf[~gone], t.off - removed)

    def meet(f, told):
        return texts.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(f, cl.BLOCK).repartition(buckets, "group").groupBy("group")

    # answers are small; an exchange of their own lets later rounds read them again instead of making them anew
    told = texts.groupBy("group").applyInArrow(send, cl.BLOCK).repartition(buckets, "group").groupBy("group").applyInArrow(match, cl.BLOCK).repartition("group")
    told = told.union(meet(send_halves, told).applyInArrow(compare(1), cl.BLOCK).repartition("group"))
    told = told.union(meet(send_strings, told).applyInArrow(compare(2), cl.BLOCK).repartition("group"))
    return texts, told, rest


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = SPAN, group_bytes: int = cl.GROUP_BYTES, with_text: bool = True) -> DataFrame:
    """One row for each distinct text: digest, key (the least), n_removed, n_spans, kept_sha256 and kept_text.

    ``kept_text`` is what is left of the text (bytes of a character that a cut splits go too), null unless asked for.
    """
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts, told, rest = _decided(src, cl.group_count(src, group_bytes), span)

    def finish(left, right):
        if not left.num_rows:
            return _result([])
        x, rows = rest(left, right), []
        for i in range(len(x.texts)):
            lost = int(x.removed[i])
            body = x.body(i) if lost or with_text else b""
            digest = x.texts.digest[i].tobytes().hex()
            rows.append((digest, int(x.texts.key[i]), lost, int(x.spans[i]), hashlib.sha256(body).hexdigest() if lost else digest, body.decode(errors="ignore") if with_text else None))
        return _result(rows)

    shape = "digest string, key long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return texts.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(finish, shape)


def _result(rows: list[tuple]) -> pa.Table:
    kinds = [("digest", pa.string()), ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table([pa.array(list(c), k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])


def repeats_by_row(docs: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = cl.members(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    found = remove_repeats(docs, key=key, text=text, span=span, with_text=False).select("digest", F.col("key").alias("least"), "n_removed", "n_spans", "kept_sha256")
    j = rows.join(found, "digest", "left")
    again = (F.coalesce(F.col("key").cast("long"), F.lit(cl.NO_KEY)) > F.col("least")) & (F.col("n_bytes") >= span)  # an equal text of a smaller key
    return j.select(
        F.col("key").alias(key), "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(again, EMPTY_SHA).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


#: Source of the rows that meet the answers of their group.
OWNER = -1


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str | None = None, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` with repeats taken out of ``text`` (and ``n_chars`` counted anew).

    Where a cut splits a character, its remaining bytes go too.  Texts that lose nothing stay as they are.

    Texts don't move again once they are cut: the other columns of the row with the least key come to the group of its text.
    Short texts stay where they are, copies with a larger key become empty without a text; only several rows of one text and
    its least key get the text by a join.
    """
    size = F.octet_length(text)
    short, long = docs.where(F.coalesce(size < span, F.lit(True))), docs.where(size >= span)
    spare = "_" * (1 + max(map(len, docs.columns)))  # there may be no other column
    others = F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(1).alias(spare))
    rows = long.select(others.alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(cl.NO_KEY)).alias("k"), F.unhex(cl.digest_of(F.col(text))).alias("d"))
    each = rows.groupBy("d", "k").agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    owners = scratch.materialize(each.groupBy("d").agg(F.min("k").alias("least"), F.count("*").alias("keys"), F.min_by(F.struct("row", "copies"), "k").alias("o")).select("d", "least", "keys", "o.*"), "owners")
    src = long.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = cl.group_count(src, cl.GROUP_BYTES)
    texts, told, rest = _decided(src, n, span)
    row_type = owners.schema["row"].dataType
    shape = StructType([StructField("d", BinaryType()), StructField("row", row_type), StructField("new", StringType())])

    def finish(left, right):
        own = right.filter(pc.equal(right.column("source"), OWNER)).select(["d", "row"])
        new = []
        if own.num_rows:
            x = rest(left, right.select(["group", "source", "data"]))
            place = {d.tobytes(): i for i, d in enumerate(x.texts.digest)}
            new = [x.body(place[d]).decode(errors="ignore") for d in own.column("d").to_pylist()]
        return own.append_column("new", pa.array(new, pa.string()))

    def cut(asked: DataFrame, row) -> DataFrame:
        """d, row, new of some texts."""
        group = F.pmod(F.conv(F.substring(F.hex("d"), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")  # as texts are dealt
        asked = asked.select(group.alias("group"), F.lit(OWNER).alias("source"), F.lit(None).cast("binary").alias("data"), "d", row.alias("row")).repartition("group")
        both = told.select("group", "source", "data", F.lit(None).cast("binary").alias("d"), F.lit(None).cast(row_type).alias("row")).union(asked)
        return texts.groupBy("group").cogroup(both.groupBy("group")).applyInArrow(finish, shape)

    def placed(found: DataFrame) -> DataFrame:
        new = F.col("new")
        return found.select([new.alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col("row")[c].alias(c) for c in docs.columns])

    out = placed(cut(owners.where("copies = 1"), F.col("row"))).union(placed(short.select(others.alias("row"), F.col(text).alias("new"))))
    several, same = owners.where("keys > 1").select("d", "least"), owners.where("copies > 1").select("d", "least")
    if not several.isEmpty():  # equal texts of larger keys
        out = out.union(placed(rows.join(several, "d").where("k > least").select("row", F.lit("").alias("new"))))
    if not same.isEmpty():  # equal texts of the least key
        again = cut(same, F.lit(None).cast(row_type)).select("d", "new")
        out = out.union(placed(rows.join(same, "d").where("k = least").join(again, "d").select("row", "new")))
    return out


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    return repeats_by_row(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
pieces AS (SELECT n, doc_id, p, substr(x, 2 * p + 1, 498) AS x FROM (SELECT n, doc_id, x, unnest(range(0, len(x) // 2 - 49, 200)) AS p FROM d)),
strings AS (SELECT n, doc_id, p + i AS i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT n, doc_id, p, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM pieces)),
least AS (SELECT s, min(doc_id) AS first, count(*) AS many FROM strings GROUP BY s HAVING many > 1),
gone AS (SELECT n, i FROM strings JOIN least USING (s) WHERE first < coalesce(doc_id::HUGEINT, 9223372036854775808)),
steps AS (SELECT n, i, lag(i) OVER (PARTITION BY n ORDER BY i) AS before FROM gone),
runs AS (
  SELECT n, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT n, i, sum(CASE WHEN before + 50 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY i) AS run FROM steps) GROUP BY n, run),
cut AS (SELECT n, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM runs GROUP BY n)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1),
    lambda j: substr(x, 2 * coalesce(tos[j], 0) + 1, 2 * (coalesce(froms[j + 1], len(x) // 2) - coalesce(tos[j], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (n)
"""


def brute_force(docs: list[tuple], span: int = SPAN) -> list[tuple]:
    """The rows of op4 by plain loops, for tests."""
    least: dict[bytes, int] = {}
    big = cl.NO_KEY
    raw = [(k, big if k is None else k, (t or "").encode()) for k, t in docs]
    for _, k, b in raw:
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            least[s] = min(least.get(s, big), k)
    out = []
    for name, k, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if least[b[i : i + span]] < k:
                gone[i : i + span] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((name, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
