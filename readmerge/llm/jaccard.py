"""N-gram Jaccard join with a vertically partitioned count of overlaps.

A document's set is its distinct 5-word shingles.  Two documents link when 100 * |A & B| >= 75 * |A | B|.

1. Distinct texts are dealt to groups; every group sends its distinct shingles to hash buckets, which answer how many
   documents have each (as a power of two).  The global order is: shingles of one document, then rarer before more common,
   then by hash.
2. Linked sets share a shingle among the first n - ceil(0.75 n) + 1 of each in that order.  Shingles of one document
   cannot be the shared one and are not sent; a document whose first shingles are all its own takes no further part.
3. In each bucket, documents with a shingle in common are paired with one leader per size range: a star, not all pairs.
4. A pair is decided by its overlap.  The global order is cut into ``FRAGMENTS`` at pivots, between which equally many
   shingles lie; each fragment counts the overlaps of the parts of sets that lie in it, apart from the others, and the counts
   are summed for each pair.  Shingles of one document are in no overlap and take no part.
5. Links give components.  Where a bucket still holds documents of different components, a second round compares the
   bitmaps of the sets (parities of hashes, about a bit a shingle), blocks of members with blocks of members in jobs
   that are spread over tasks.  Bitmaps bound the overlap from above, so pairs that they rule out cannot link; only the
   others are listed and decided as before.  No link between different texts is lost.

Defined cases: with fewer words than a shingle the whole sequence is one shingle; texts without words (or null) have an
empty set and stand alone; equal texts are one class and share its component; rows of equal key share nothing but
their key; a null key is larger than all others and comes back as null.  Keys are whole numbers; others are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import classes as cl, scratch, text as tx
from .components import components
from .suffix import _gather, first_of

SHINGLE = 5
FRAGMENTS = 4
#: Members of one star that are decided by one task.
STAR_PART = 2048
#: Members of a block of a job of the second round.
JOB_PART = 512
#: Parts into which the rows of one component are spread.
SALTS = 16
#: Bits of a class id that number the texts of a group.
LOCAL = 32


class Sets:
    """Shingle sets of a group's texts: hashes sorted within each text, and the range of each text."""

    def __init__(self, blocks: list[bytes], size: int = SHINGLE):
        self.texts = t = cl.Texts(blocks)
        parts, counts = [], []
        for lo, hi in tx.slices(t.off):
            w = tx.words(t.buf[t.off[lo] : t.off[hi]], t.off[lo : hi + 1] - t.off[lo], tx.NONSPACE)
            n = np.diff(w.off)
            g = tx.grams(w.hash, size)
            long = np.flatnonzero(n >= size)
            short = np.flatnonzero((n > 0) & (n < size))
            h = [g[tx.expand(w.off[long], n[long] - size + 1)]]
            doc = [np.repeat(long, n[long] - size + 1)]
            if len(short):
                h.append(tx.span_hash(w.hash, w.off[short], w.off[short] + n[short]))
                doc.append(short)
            h, doc = np.concatenate(h), np.concatenate(doc)
            order = tx.ordered((doc.astype(tx.U64) << tx.U64(40)) | (h >> tx.U64(24)), h)  # a slice has fewer than 2**24 texts
            h, doc = h[order], doc[order]
            new = first_of(doc, h)
            parts.append(h[new])
            counts.append(np.bincount(doc[new], minlength=hi - lo))
        self.h = np.concatenate(parts)
        self.n = np.concatenate(counts)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(t)), self.n)

    def distinct(self, buckets: int):
        """(bucket, hashes, documents that have each) in the order in which they are sent."""
        h, many = np.unique(self.h, return_counts=True)
        for b, part in cl.parts_of(*cl.by_bucket(h, buckets)):
            yield b, h[part], many[part]

    def levels(self, table: pa.Table, buckets: int) -> np.ndarray:
        """The level of each shingle of each text, from the buckets' answers."""
        replies, all_h, level = cl.answers(table), [np.zeros(0, tx.U64)], [np.zeros(0, np.uint8)]
        for b, h, _ in self.distinct(buckets):
            own = np.empty(len(h), np.uint8)
            own[_short_order(h)[1]] = cl.unpack(replies[b])[0]
            all_h.append(h)
            level.append(own)
        all_h, level = np.concatenate(all_h), np.concatenate(level)
        order = np.argsort(all_h)
        return level[order][np.searchsorted(all_h[order], self.h)] if len(self.h) else level

    def bitmaps(self) -> list[bytes]:
        """For each text the parity of its shingles at each place of :func:`bitmap_bits` places."""
        bits = bitmap_bits(self.n)
        start = np.cumsum(bits) - bits
        at = start[self.doc] + (self.h & (bits[self.doc] - 1).astype(tx.U64)).astype(np.int64)
        raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [raw[s : s + m] for s, m in zip((start // 8).tolist(), (bits // 8).tolist(), strict=True)]

    def prefixes(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the shared shingles among the first of each text in the global order."""
        place = (self.doc.astype(tx.U64) << tx.U64(40)) | (level.astype(tx.U64) << tx.U64(32)) | (self.h >> tx.U64(32))
        order = tx.ordered(place, self.h)  # by text, commonness, hash
        rank = np.arange(len(order)) - self.off[self.doc[order]]
        first = order[rank < (self.n - -(-3 * self.n // 4) + 1)[self.doc[order]]]
        first = first[level[first] > 0]
        return self.h[first], self.doc[first]


def _short_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half of each hash (with the bucket, enough to tell shingles apart) in order, and that order."""
    short = (h & tx.U64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(short, kind="stable")
    return short[order], order


def _ids(group: int, local: np.ndarray) -> np.ndarray:
    return (group << LOCAL) | local.astype(np.int64)


def _frequencies(table: pa.Table) -> pa.Table:
    """How many documents have each shingle of a bucket: 0 for one, else the power of two, to each group."""
    parts, sources = _gather(table)
    bucket = table.column("group")[0].as_py()
    h = np.concatenate([cl.undelta(p[0]) for p in parts])
    many = np.concatenate([p[1] for p in parts]).astype(np.int64)
    _, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, many)[back]
    level = np.where(total < 2, 0, np.floor(np.log2(np.maximum(total, 1)))).astype(np.uint8)
    bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
    return cl.block_table([(s, bucket, cl.pack(level[a:b])) for s, a, b in zip(sources, bounds[:-1], bounds[1:], strict=True)])


def _level_counts(batches):
    """(level, shingles) of each batch of answers."""
    total = np.zeros(64, np.int64)
    for batch in batches:
        for data in batch.column("data").to_pylist():
            total += np.bincount(cl.unpack(data)[0], minlength=64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(total)], ["level", "n"])


def pivots(counts: np.ndarray, parts: int) -> np.ndarray:
    """Places of the global order that cut the shared shingles into equal parts; hashes of a level are spread evenly."""
    counts = counts.copy()
    counts[0] = 0
    end = np.cumsum(counts)
    out = []
    for i in range(1, parts):
        want = int(end[-1]) * i // parts
        level = int(np.searchsorted(end, want, "right"))
        inside = (want - int(end[level] - counts[level])) / max(1, int(counts[level])) if level < len(counts) else 0.0
        out.append((min(level, 63) << 58) + min(int(inside * (1 << 58)), (1 << 58) - 1))
    return np.array(out, tx.U64)


def stars(h: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The leader's place for each entry of entries sorted by (h, n, ids): the first entry of its size range.

    A range ends where a size is over 4/3 of its leader's.
    """
    lead = np.zeros(len(h), np.int64)
    starts = np.flatnonzero(first_of(h))
    ends = np.append(starts[1:], len(h))
    todo, at, end = np.ones(len(starts), bool), starts.copy(), ends
    while todo.any():  # one step for each range of a shingle: few, as sizes grow by a third
        live = np.flatnonzero(todo)
        reach = np.empty(len(live), np.int64)
        for j, k in enumerate(live):
            reach[j] = at[k] + np.searchsorted(n[at[k] : end[k]], n[at[k]] * 4 // 3, "right")
        count = reach - at[live]
        lead[tx.expand(at[live], count)] = np.repeat(at[live], count)
        at[live] = reach
        todo[live] = reach < end[live]
    return lead


def _sorted_entries(table: pa.Table):
    parts, sources = _gather(table)
    cols = [(p[0], p[1].astype(np.int64), _ids(s, p[2])) for p, s in zip(parts, sources, strict=True)]
    h, n, ids = (np.concatenate(x) for x in zip(*cols, strict=True))
    label = np.concatenate([p[3] for p in parts]) if len(parts[0]) > 3 else ids
    order = tx.ordered(h, n, ids)
    return h[order], n[order], ids[order], label[order]


def _requests(a: np.ndarray, b: np.ndarray, task: np.ndarray) -> pa.Table:
    """Pairs to the tasks that decide them (source -1), and each member to its group: which tasks need its set."""
    rows = []
    pair = np.unique(np.stack([task, a, b], 1), axis=0)
    for k, part in cl.parts_of(pair[:, 0], np.arange(len(pair))):
        rows.append((k, -1, cl.pack(pair[part, 1], pair[part, 2])))
    need = np.unique(np.concatenate([pair[:, [1, 0]], pair[:, [2, 0]]]), axis=0)
    for g, part in cl.parts_of(need[:, 0] >> LOCAL, np.arange(len(need))):
        rows.append((g, 0, cl.pack(need[part, 0] & ((1 << LOCAL) - 1), need[part, 1])))
    return cl.block_table(rows)


def _task_of(leader: np.ndarray, member: np.ndarray, crowd: np.ndarray, tasks: int) -> np.ndarray:
    """The deciding task of a pair: by its leader, and for crowded leaders also by its member."""
    with np.errstate(over="ignore"):
        salt = tx.splitmix(member.astype(tx.U64)) % (crowd // STAR_PART + 1).astype(tx.U64)
        return (tx.splitmix(leader.astype(tx.U64) + salt * tx.U64(0x9E3779B97F4A7C15)) % tx.U64(tasks)).astype(np.int64)


def _first_pairs(tasks: int):
    def run(table: pa.Table) -> pa.Table:
        h, n, ids, _ = _sorted_entries(table)
        lead = stars(h, n, ids)
        member = np.flatnonzero(lead != np.arange(len(h)))
        crowd = np.bincount(lead, minlength=len(h))[lead[member]]
        a, b = ids[lead[member]], ids[member]
        return _requests(a, b, _task_of(a, b, crowd, tasks))

    return run


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n shingles: the next power of two, 64 at least."""
    return np.left_shift(np.int64(1), np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64))


def undecided(h: np.ndarray, n: np.ndarray, ids: np.ndarray, label: np.ndarray, lead: np.ndarray, tasks: int):
    """The members between which pairs are left, as jobs (task, ranges of entries, members of the first range or 0).

    A shingle is left out where its members, but for the leader of its only star, are of one component.  Else its
    members are one job, and those of a crowded shingle are cut into blocks: a job is a block, or two blocks (of at most
    64 blocks) of which each pair has one member in each.
    """
    starts = np.flatnonzero(first_of(h))
    size = np.diff(np.append(starts, len(h)))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    single = np.maximum.reduceat(lead, starts) == starts
    seen = label.copy()
    seen[starts[single & (size > 1)]] = label[starts[single & (size > 1)] + 1]
    left = (size > 2) & (np.minimum.reduceat(seen, starts) != np.maximum.reduceat(seen, starts))
    whole = left & (size <= JOB_PART)
    jobs = [np.stack([starts[whole], size[whole], size[whole] * 0, size[whole] * 0], 1)]
    for s, m in zip(starts[left & ~whole].tolist(), size[left & ~whole].tolist(), strict=True):
        step = max(JOB_PART, -(-m // 64))
        at = np.arange(s, s + m, step)
        count = np.minimum(step, s + m - at)
        i, j = np.triu_indices(len(at))
        near = n[at[j]] <= n[at[i] + count[i] - 1] * 4 // 3
        i, j = i[near], j[near]
        jobs.append(np.stack([at[i], count[i], at[j] * (j > i), count[j] * (j > i)], 1))
    job = np.concatenate(jobs)
    with np.errstate(over="ignore"):  # shingles that the same members share go to one task
        mark = tx.splitmix(ids[job[:, 0]]) + tx.U64(3) * tx.splitmix(ids[job[:, 2]]) * (job[:, 3] > 0).astype(tx.U64)
    return (tx.splitmix(mark) % tx.U64(tasks)).astype(np.int64), job, job[:, 1] * (job[:, 3] > 0)


#: Rows of the second round: jobs (no id) and the members whose bitmaps their task needs (no data).
JOBS = "task int, id long, data binary"


def _jobs(tasks: int):
    """Jobs of a bucket's shingles whose members are of different components."""

    def run(table: pa.Table) -> pa.Table:
        h, n, ids, label = _sorted_entries(table)
        lead = stars(h, n, ids)
        task, job, cut = undecided(h, n, ids, label, lead, tasks)
        rows: list[tuple] = []
        for k, part in cl.parts_of(task, np.argsort(task, kind="stable")):
            at = tx.expand(job[part][:, [0, 2]].ravel(), job[part][:, [1, 3]].ravel())
            rows.append((k, None, cl.pack(job[part, 1] + job[part, 3], cut[part], ids[at], n[at], label[at], ids[lead[at]])))
            rows += [(k, i, None) for i in np.unique(ids[at]).tolist()]
        t, i, d = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(t, pa.int32()), pa.array(i, pa.int64()), pa.array(d, pa.binary())], names=["task", "id", "data"])

    return run


def may_link(n: np.ndarray, words: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs (n[i] <= n[j] <= 4/3 n[i]) whose bitmaps allow a link.

    A shingle of one set alone flips one bit, so bitmaps differ in at most as many bits as there are such shingles.
    A bitmap twice as long becomes one of half the bits by exclusive or of its halves.
    """
    width, good = bitmap_bits(n) // 64, np.zeros(len(i), bool)
    for w in np.unique(width[i]).tolist():
        some = np.flatnonzero(width[i] == w)
        place, longer = np.arange(w), width[j[some]] > w
        other = words[start[j[some]][:, None] + place]
        other[longer] ^= words[start[j[some][longer]][:, None] + w + place]
        apart = np.bitwise_count(words[start[i[some]][:, None] + place] ^ other).sum(1, dtype=np.int64)
        both = n[i[some]] + n[j[some]]
        common = (both - apart) // 2
        good[some] = 100 * common >= 75 * (both - common)
    return good


#: Words of bitmaps that are compared at once.
AT_ONCE = 1 << 20


def _survivors(tasks: int):
    """Pairs of a task's jobs that their bitmaps do not rule out, as requests."""

    def run(table: pa.Table) -> pa.Table:
        is_map = pc.is_valid(table.column("id"))
        asked, maps = table.filter(pc.invert(is_map)), table.filter(is_map)
        known = maps.column("id").to_numpy()
        order = np.argsort(known)
        known, maps = known[order], maps.column("data").take(pa.array(order)).to_pylist()
        words = np.frombuffer(b"".join(maps), "<u8").astype(tx.U64)
        length = np.array([len(x) // 8 for x in maps], np.int64)
        size, cut, *members = (np.concatenate(x) for x in zip(*map(cl.unpack, asked.column("data").to_pylist()), strict=True))
        # the same members share many shingles: one job
        ends, seen = np.cumsum(size), {}
        for k, (e, m) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
            seen.setdefault((m, int(cut[k]), members[0][e - m : e].tobytes()), k)
        kept = np.array(list(seen.values()), np.int64)
        at = tx.expand((ends - size)[kept], size[kept])
        size, cut = size[kept], cut[kept]
        ids, n, label, lead = (x[at] for x in members)
        start = (np.cumsum(length) - length)[np.searchsorted(known, ids)]
        end = np.cumsum(size)
        number, place = np.repeat(np.arange(len(size)), size), np.arange(len(ids))
        first = np.where(cut[number] > 0, (end - size + cut)[number], place + 1)
        order = number << 40 | n  # members of a job are in order of size
        top = np.searchsorted(order, number << 40 | n * 4 // 3, "right")
        count = np.where((cut[number] > 0) & (place >= first), 0, np.maximum(top - first, 0))
        cost = np.cumsum(count * (bitmap_bits(n) // 64))
        edges = np.unique(np.append(np.searchsorted(cost, np.arange(0, cost[-1], AT_ONCE)), len(ids)))
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            i, j = np.repeat(place[lo:hi], count[lo:hi]), tx.expand(first[lo:hi], count[lo:hi])
            some = (label[i] != label[j]) & (lead[j] != ids[i])
            i, j = i[some], j[some]
            some = may_link(n, words, start, i, j)
            out.append(np.stack([ids[i[some]], ids[j[some]]]))
        a, b = np.concatenate(out, 1)
        _, back, many = np.unique(a, return_inverse=True, return_counts=True)
        return _requests(a, b, _task_of(a, b, many[back], tasks))

    return run


def _fragments(cuts: np.ndarray, buckets: int):
    """A group's sets, cut at the pivots, to the tasks that need them: task * FRAGMENTS + fragment."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        source = right.column("source").to_numpy()
        asked = right.filter(pa.array(source == ASKED))
        if not left.num_rows or not asked.num_rows:
            return cl.block_table([])
        sets, me = Sets(cl.blocks_of(left)), left.column("group")[0].as_py()
        level = sets.levels(right.filter(pa.array(source >= 0)), buckets)
        local, task = (np.concatenate(x) for x in zip(*(cl.unpack(b) for b in cl.blocks_of(asked)), strict=True))
        pair = np.unique(np.stack([task, local], 1), axis=0)
        where = np.searchsorted(cuts, (level.astype(tx.U64) << tx.U64(58)) | (sets.h >> tx.U64(6)), "right")
        rows = []
        for k, part in cl.parts_of(pair[:, 0], np.arange(len(pair))):
            own = pair[part, 1]
            at = tx.expand(sets.off[own], sets.n[own])
            doc = np.repeat(np.arange(len(own)), sets.n[own])
            for f in range(FRAGMENTS):
                some = (where[at] == f) & (level[at] > 0)
                rows.append((k * FRAGMENTS + f, me, cl.pack(own.astype(np.uint32), sets.n[own].astype(np.uint32), np.bincount(doc[some], minlength=len(own)).astype(np.uint32), sets.h[at[some]])))
        return cl.block_table(rows)

    return run


def _overlaps(table: pa.Table) -> pa.Table:
    """Overlaps of a task's pairs in one fragment: (a, b, sizes, common shingles)."""
    key = table.column("group")[0].as_py()
    source, data = table.column("source").to_pylist(), cl.blocks_of(table)
    pairs = [cl.unpack(d) for s, d in zip(source, data, strict=True) if s < 0]
    if not pairs:
        return cl.block_table([])
    ids, size, count, h = [], [], [], []
    for s, d in zip(source, data, strict=True):
        if s >= 0:
            local, n, c, x = cl.unpack(d)
            ids.append(_ids(s, local))
            size.append(n)
            count.append(c)
            h.append(x)
    ids, size, count, h = (np.concatenate(x) for x in (ids, size, count, h))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    pair = np.unique(np.stack([a, b], 1), axis=0)
    order = np.argsort(ids)
    off = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
    i, j = (order[np.searchsorted(ids[order], pair[:, c])] for c in (0, 1))
    _, number = np.unique(h, return_inverse=True)
    member = np.sort(np.repeat(np.arange(len(ids)), count) << 32 | number)  # (set, shingle) of this fragment
    common = np.zeros(len(pair), np.int64)
    step = 1 + (1_000_000 // max(1, int(count.max(initial=1))))
    for lo in range(0, len(pair), step):  # pairs in parts, so that the looked-up shingles stay few
        p, q = i[lo : lo + step], j[lo : lo + step]
        c = count[q].astype(np.int64)
        want = np.repeat(p, c) << 32 | number[tx.expand(off[q], c)]
        at = np.minimum(np.searchsorted(member, want), max(len(member) - 1, 0))
        hit = member[at] == want if len(member) else np.zeros(len(want), bool)
        common[lo : lo + step] = np.bincount(np.repeat(np.arange(len(p)), c)[hit], minlength=len(p))
    return cl.block_table([(key // FRAGMENTS, key % FRAGMENTS, cl.pack(pair[:, 0], pair[:, 1], size[i], size[j], common.astype(np.uint32)))])


def _sum(table: pa.Table) -> pa.Table:
    """Links of a task: overlaps of its fragments summed and compared with the threshold."""
    a = b = na = nb = None
    total = 0
    for d in cl.blocks_of(table):  # every fragment has the task's pairs in the same order
        a, b, na, nb, common = cl.unpack(d)
        total = total + common.astype(np.int64)
    union = na.astype(np.int64) + nb - total
    good = 100 * total >= 75 * union
    return pa.table([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])


#: Source of the rows that ask a group for sets.
ASKED = -3


def _links(texts: DataFrame, asked: DataFrame, levels: DataFrame, cuts: np.ndarray, buckets: int) -> DataFrame:
    """Decide requested pairs: sets in fragments, partial overlaps, sums.  One row for each link."""
    asked = scratch.materialize(asked, "requests")
    needs = asked.where("source = 0").select("group", F.lit(ASKED).alias("source"), "data")
    some = levels.join(needs.select("group").distinct(), "group", "left_semi")  # answers to groups that nothing is asked of stay
    cut = texts.groupBy("group").cogroup(some.union(needs).groupBy("group")).applyInArrow(_fragments(cuts, buckets), cl.BLOCK)
    pairs = asked.where("source = -1").select("group", "source", "data", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("part"))
    pairs = pairs.select((F.col("group") * FRAGMENTS + F.col("part")).cast("int").alias("group"), "source", "data")
    partial = cut.union(pairs).groupBy("group").applyInArrow(_overlaps, cl.BLOCK)
    links = scratch.materialize(partial.groupBy("group").applyInArrow(_sum, "a long, b long").distinct(), "links")
    scratch.drop(asked)
    return links


def _rooted(links: DataFrame, name: str) -> DataFrame:
    """Components of the links, written; nothing else of them stays."""
    found = components(links)
    roots = scratch.materialize(found, name)
    scratch.drop(found)
    return roots


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", group_bytes: int = cl.GROUP_BYTES) -> DataFrame:
    """One row for each distinct text: digest, key (the least), n_shingles, component_id, links (its decided links), root.

    ``root`` names the component even where all its keys are null.
    """
    return _near_duplicates(docs, key, text, group_bytes)[0]


def _near_duplicates(docs: DataFrame, key: str, text: str, group_bytes: int = cl.GROUP_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_duplicates``, and the tables in the shared folder that they are read from (a few numbers a text)."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = cl.group_count(docs, group_bytes)
    buckets = cl.bucket_count(n)
    texts = scratch.materialize(cl.deal(src, n), "texts")

    def send(table):
        """A group's shingles to the buckets, and its texts with sizes and bitmaps."""
        sets, me = Sets(cl.blocks_of(table)), table.column("group")[0].as_py()
        rows = []
        for b, h, many in sets.distinct(buckets):
            short, order = _short_order(h)
            rows.append((b, me, cl.pack(cl.deltas(short), np.minimum(many[order], 0xFFFF).astype(np.uint16))))
        t = sets.texts
        names = [x.tobytes().hex() for x in t.digest]
        cols = [pa.array(names, pa.string()), pa.array(t.key), pa.array(sets.n, pa.int64()), pa.array(_ids(me, np.arange(len(t)))), pa.array(sets.bitmaps(), pa.binary())]
        both = pa.concat_tables([cl.block_table(rows), pa.table(cols, names=["digest", "key", "n_shingles", "id", "bitmap"])], promote_options="default")
        return both.select(["group", "source", "data", "digest", "key", "n_shingles", "id", "bitmap"])

    def entries(left, right):
        if not left.num_rows:
            return cl.block_table([])
        sets, me = Sets(cl.blocks_of(left)), left.column("group")[0].as_py()
        h, doc = sets.prefixes(sets.levels(right, buckets))
        rows = []
        for b, p in cl.parts_of(*cl.by_bucket(h, buckets)):
            rows.append((b, me, cl.pack(h[p], sets.n[doc[p]].astype(np.uint32), doc[p].astype(np.uint32))))
        return cl.block_table(rows)

    def labelled(left, right):
        """The entries of a group with the components of its texts (a text that no link names is its own)."""
        rows, told = [], [(np.zeros(0, np.int64),) * 2, *map(cl.unpack, cl.blocks_of(right))]
        local, root = (np.concatenate(x) for x in zip(*told, strict=True))
        order = np.argsort(local)
        local, root = local[order], root[order]
        for b, me, data in zip(left.column("group").to_pylist(), left.column("source").to_pylist(), cl.blocks_of(left), strict=True):
            h, n, doc = cl.unpack(data)
            label, at = _ids(me, doc), np.searchsorted(local, doc.astype(np.int64))
            known = np.flatnonzero(np.append(local, -1)[at] == doc)
            label[known] = root[at[known]]
            rows.append((b, me, cl.pack(h, n, doc, label)))
        return cl.block_table(rows)

    def label_blocks(table):
        g = table.column("group")[0].as_py()
        return cl.block_table([(g, -1, cl.pack(table.column("local").to_numpy(), table.column("root").to_numpy()))])

    def met(blocks: DataFrame):
        """Blocks by bucket, in as many tasks as there are buckets: few bytes are much work there."""
        return blocks.repartition(buckets, "group").groupBy("group")

    grouped = texts.groupBy("group")
    sent = scratch.materialize(grouped.applyInArrow(send, f"{cl.BLOCK}, digest string, key long, n_shingles long, id long, bitmap binary"), "sent")
    every = scratch.materialize(sent.where("digest is not null").select("digest", "key", "n_shingles", "id", "bitmap"), "every")
    levels = scratch.materialize(met(sent.where("digest is null").select("group", "source", "data")).applyInArrow(_frequencies, cl.BLOCK), "levels")
    scratch.drop(sent)  # the shingles of all texts: the largest table here
    counts = {r[0]: r[1] for r in levels.select("data").mapInArrow(_level_counts, "level long, n long").groupBy("level").agg(F.sum("n")).collect()}  # 64 rows
    cuts = pivots(np.array([counts.get(i, 0) for i in range(64)]), FRAGMENTS)
    first = scratch.materialize(grouped.cogroup(levels.groupBy("group")).applyInArrow(entries, cl.BLOCK), "entries")
    links = _links(texts, met(first).applyInArrow(_first_pairs(n), cl.BLOCK), levels, cuts, buckets)
    roots = _rooted(links, "roots")
    labels = roots.select(F.shiftright("node", LOCAL).cast("int").alias("group"), F.col("node").bitwiseAND((1 << LOCAL) - 1).alias("local"), "root")
    told = labels.groupBy("group").applyInArrow(label_blocks, cl.BLOCK)
    second = first.groupBy("source").cogroup(told.groupBy("group")).applyInArrow(labelled, cl.BLOCK)
    jobs = scratch.materialize(met(second).applyInArrow(_jobs(n), JOBS), "jobs")
    maps = jobs.where("id is not null").select("task", "id").distinct().join(every.select("id", F.col("bitmap").alias("data")), "id").select("task", "id", "data")
    rest = jobs.where("id is null").union(maps).repartition(buckets, "task").groupBy("task").applyInArrow(_survivors(n), cl.BLOCK)
    more = _links(texts, rest, levels, cuts, buckets)
    first_links, links = links, scratch.materialize(links.union(more).distinct(), "all-links")
    first_roots, roots = roots, _rooted(links, "all-roots")
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    scratch.drop(texts, levels, first, jobs, first_links, more, first_roots)
    placed = every.join(roots, every["id"] == roots["node"], "left").join(degree, F.col("id") == F.col("a"), "left")
    placed = placed.select("digest", "key", "n_shingles", "id", "root", F.coalesce("links", F.lit(0)).alias("links"))
    alone = placed.where("root is null").select("digest", "key", "n_shingles", F.col("key").alias("component_id"), "links", F.col("id").alias("root"))
    # a component may hold a third of all texts: its rows are spread, its least key is sent to each part
    several = placed.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    least = several.groupBy("root").agg(F.min("key").alias("component_id")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return alone.union(several.join(least, ["root", "salt"]).select("digest", "key", "n_shingles", "component_id", "links", "root")), [every, links, roots]


def near_duplicates_by_row(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and digest of every row."""
    rows = cl.members(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    found = near_duplicates(docs, key=key, text=text).select("digest", "n_shingles", "component_id")
    j = rows.join(found, "digest", "left")
    known = F.when(F.col("component_id") < cl.NO_KEY, F.col("component_id"))
    return j.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, known).otherwise(F.col("key").cast("long")).alias("component_id"), "digest")


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the text of the least (key, digest), in one row
    (of several rows with that key and text the one with the least hash of all its columns).

    Texts without words are in no component and stay, each row of them.
    """
    found, made = _near_duplicates(docs, key, text)
    chosen = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("key", "digest")).alias("c")).select("c.key", "c.digest")
    chosen = scratch.materialize(chosen, "chosen")
    scratch.drop(*made)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(cl.NO_KEY)).alias("k"), cl.digest_of(F.col(text)).alias("d"), F.col(text).alias("t"))
    same = (F.col("k") == F.col("key")) & (F.col("d") == F.col("digest"))
    words = F.coalesce(F.col("t"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(words).join(chosen, same, "left_semi")
    again = rows.select("k", "d").join(chosen, same, "left_semi").groupBy("k", "d").count().where("count > 1")
    if not again.isEmpty():  # the same row several times
        kept = kept.groupBy("k", "d").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row").union(rows.where(~words).select("row")).select("row.*")


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates_by_row(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT n, doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM d),
classes AS (SELECT row_number() OVER () AS c, s, len(s) AS size FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
grams AS (SELECT c, size, unnest(s) AS g FROM classes),
ranked AS (SELECT c, size, g, row_number() OVER (PARTITION BY c ORDER BY many, g) AS place FROM (SELECT c, size, g, count(*) OVER (PARTITION BY g) AS many FROM grams)),
heads AS (SELECT c, size, g FROM ranked WHERE place <= size - (75 * size + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM heads a JOIN heads b ON a.g = b.g AND a.c < b.c AND 100 * least(a.size, b.size) >= 75 * greatest(a.size, b.size)),
links AS (
  SELECT a, b FROM (SELECT a, b, count(*) AS same FROM pairs JOIN grams x ON x.c = a JOIN grams y ON y.c = b AND y.g = x.g GROUP BY a, b)
  JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE 100 * same >= 75 * (x.size + y.size - same)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN two_way l ON r.b = l.a),
least_of AS (SELECT s, min(doc_id) AS own FROM sets WHERE len(s) > 0 GROUP BY s),
named AS (SELECT a, min(own) AS component_id FROM reach JOIN classes ON c = b JOIN least_of USING (s) GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN named ON a = c
"""


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The rows of op6 by plain loops, for tests."""
    import re

    big, sets, parent = cl.NO_KEY, [], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where: dict[tuple, list[int]] = {}
    for i, (_, t) in enumerate(docs):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
        sets.append(s)
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for at in where.values():
        for x in range(len(at)):
            for y in range(x + 1, len(at)):
                if (at[x], at[y]) not in seen:
                    seen.add((at[x], at[y]))
                    a, b = sets[at[x]], sets[at[y]]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[root(at[x])] = root(at[y])
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), big), big if k is None else k)
    return [(k, len(sets[i]), None if least[root(i)] == big else least[root(i)]) for i, (k, _) in enumerate(docs)]
