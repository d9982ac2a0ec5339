"""The alignment kernel: pairs of any lengths in padded matrices, one candidate overlap at a time for all of them.

Forward reads are padded on the left and reverse reads, turned round, on the right.  Then the bases that an overlap pairs are
the last columns of one matrix and the first of the other, whatever the lengths of a row.  Merged rows are flat arrays with
offsets, as Arrow has them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..functions import nt
from ..functions.kmers import kmer_codes
from ..functions.phred import PHRED_MAX, QUAL_NN, QUAL_SCORE, QUAL_SCORE_ERR
from .algorithms import Overlap
from .clip import primer_offsets
from .config import AssemblerConfig, nucleotides

#: Cells of a padded matrix that are worked on at once.
CELLS = 2_000_000
STATUS = np.array(["OK", "BADR", "NOFP", "NORP", "NOALGN", "LOWQ", "MODULE"], object)
_ONE = np.isin(np.arange(256), (1, 2, 4, 8))
OK, BADR, NOFP, NORP, NOALGN, LOWQ, MODULE = range(7)
_clamped = lambda q: QUAL_SCORE[np.clip(q, 0, PHRED_MAX)]


def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of left-aligned values turned round, left-aligned again."""
    if (length == x.shape[1]).all():
        return x[:, ::-1]
    at = length[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), 0)


class Reads:
    """Forward reads and complemented reverse reads in the order read, left-aligned, with their lengths (by default: all full)."""

    def __init__(self, f: np.ndarray, fq: np.ndarray, r: np.ndarray, rq: np.ndarray, f_len: np.ndarray | None = None, r_len: np.ndarray | None = None):
        self.f, self.fq, self.r, self.rq = f, fq, r, rq
        self.f_len = np.full(len(f), f.shape[1]) if f_len is None else f_len
        self.r_len = np.full(len(r), r.shape[1]) if r_len is None else r_len

    def __len__(self) -> int:
        return len(self.f)

    def take(self, at: np.ndarray) -> Reads:
        """Some rows, without the columns that none of them needs."""
        n, m = int(self.f_len[at].max(initial=0)), int(self.r_len[at].max(initial=0))
        return Reads(self.f[at, :n], self.fq[at, :n], self.r[at, :m], self.rq[at, :m], self.f_len[at], self.r_len[at])

    @cached_property
    def right(self) -> tuple[np.ndarray, np.ndarray]:
        """Forward bases and scores aligned on the right."""
        return tuple(_turned(x, self.f_len)[:, ::-1] for x in (self.f, self.fq))

    @cached_property
    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """Reverse bases and scores turned round."""
        return tuple(_turned(x, self.r_len) for x in (self.r, self.rq))

    @cached_property
    def alias(self) -> np.ndarray:
        """Forward scores at the places of the reverse read (those beyond its end: the last one), turned round as it is."""
        at = np.clip(np.minimum(self.r_len[:, None] - 1 - np.arange(self.r.shape[1]), self.f_len[:, None] - 1), 0, max(self.f.shape[1] - 1, 0))
        return np.take_along_axis(self.fq, at, 1)


def candidates(reads: Reads, low: int, high: np.ndarray, num_kmers: int) -> np.ndarray:
    """Which overlaps from low on (columns), up to ``high`` of each pair, share a k-mer; all of them where none does."""
    width = max(int(high.max(initial=low)) - low + 1, 1)
    top = np.maximum(high, low)
    out = np.zeros((len(reads), width), bool)
    (fc, fok), (rc, rok) = kmer_codes(reads.f), kmer_codes(reads.turned[0])
    fok &= np.arange(reads.f.shape[1]) < reads.f_len[:, None]
    rok &= np.arange(reads.r.shape[1]) < reads.r_len[:, None]
    # positions of each code in a pair's forward read, the first num_kmers of them
    pair, posn = np.nonzero(fok)
    key = (pair.astype(np.int64) << 16) | fc[pair, posn]
    order = np.argsort(key, kind="stable")
    posn, key = posn[order], key[order]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    posn, key = posn[rank < num_kmers], key[rank < num_kmers]
    rpair, rposn = np.nonzero(rok)
    want = (rpair.astype(np.int64) << 16) | rc[rpair, rposn]
    left = np.searchsorted(key, want)
    for j in range(num_kmers):
        at = left + j
        hit = (at < len(key)) & (key[np.minimum(at, max(len(key) - 1, 0))] == want) if len(key) else np.zeros(len(want), bool)
        row = rpair[hit]
        overlap = reads.f_len[row] + rposn[hit] - posn[at[hit]]
        inside = (overlap >= low) & (overlap <= top[row])
        out[row[inside], overlap[inside] - low] = True
    none = ~out.any(1)
    out[none] = np.arange(width) + low <= top[none, None]
    return out


def paired(reads: Reads, overlap: int) -> Overlap:
    """The bases that an overlap pairs; places before a forward or behind a reverse read are marked as not there."""
    n, m = reads.f.shape[1], reads.r.shape[1]
    i = np.arange(max(0, overlap - n), min(overlap, m))
    own = slice(n - overlap + i[0], n - overlap + i[0] + len(i)) if len(i) else slice(0, 0)
    other = slice(i[0], i[0] + len(i)) if len(i) else slice(0, 0)
    short, least = int(reads.f_len.min(initial=n)), int(reads.r_len.min(initial=m))
    there = None if overlap <= min(short, least) or short == n and least == m else (i >= overlap - reads.f_len[:, None]) & (i < reads.r_len[:, None])
    (f, fq), (r, rq) = reads.right, reads.turned
    return Overlap(f[:, own], r[:, other], fq[:, own], rq[:, other], lambda: reads.alias[:, other], reads.f_len, reads.r_len, overlap, there)


def best_overlap(reads: Reads, cfg: AssemblerConfig, f_off: np.ndarray, r_off: np.ndarray) -> dict[str, np.ndarray]:
    """The best overlap of each pair (-1: none), its score, candidates examined, and whether all were."""
    n, low = len(reads), cfg.min_overlap
    blocked = (low + f_off >= reads.f_len) | (low + r_off >= reads.r_len)
    high = np.minimum(reads.f_len, reads.r_len) if cfg.max_overlap == 0 else np.minimum(reads.f_len + reads.r_len - low - f_off - r_off - 1, cfg.max_overlap)
    out = {"overlap": np.full(n, -1), "score": QUAL_NN * (reads.f_len + reads.r_len), "examined": np.zeros(n, np.int64), "slow": np.zeros(n, bool)}
    at = np.flatnonzero(~blocked)
    if not len(at):
        return out
    some, high = reads.take(at), high[at]
    top = np.maximum(high, low)
    asked = np.arange(low, int(top.max()) + 1) <= top[:, None] if cfg.exhaustive else candidates(some, low, high, cfg.num_kmers)
    best, where = out["score"][at], np.full(len(at), -1)
    for k in np.flatnonzero(asked.any(0)).tolist():
        use = np.flatnonzero(asked[:, k])
        s = cfg.algorithm.score(paired(some, low + k).rows(None if len(use) == len(at) else use))
        win = s > best[use]  # the first of equals stays; NaN never wins
        best[use[win]], where[use[win]] = s[win], low + k
    examined = asked.sum(1)
    out["overlap"][at], out["score"][at], out["examined"][at], out["slow"][at] = where, best, examined, examined == high - low + 1
    return out


def _index(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of rows of some lengths, and the row and the place of each value."""
    off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    return off, row, np.arange(off[-1]) - off[row]


def _clear(from_end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths without the trailing run of score 2, from scores in order from the end."""
    out = length.copy()
    dark = np.flatnonzero(from_end[:, 0] == 2) if from_end.shape[1] else np.zeros(0, np.int64)
    out[dark] -= np.cumprod(from_end[dark] == 2, 1).sum(1)
    return out


@dataclass
class Merged:
    """Merged rows: flat sets and log-probabilities with offsets, and a value of each kind for a row."""

    base: np.ndarray
    logp: np.ndarray
    off: np.ndarray
    quality: np.ndarray
    mismatches: np.ndarray
    degenerates: np.ndarray


def merge(reads: Reads, cfg: AssemblerConfig, overlap: np.ndarray, f_off: np.ndarray, r_off: np.ndarray) -> Merged:
    """Fuse pairs: the forward read alone, the overlap, the reverse read alone."""
    n = len(reads)
    df, dr = reads.f_len - f_off - overlap, reads.r_len - r_off - overlap
    head, middle, tail = np.maximum(df, 0), np.maximum(overlap + np.minimum(df, 0) + np.minimum(dr, 0), 0), np.maximum(dr, 0)
    off, row, t = _index(head + middle + tail)
    i = t - head[row]
    behind = i - middle[row]
    f_start, r_start = row * reads.f.shape[1], row * reads.r.shape[1]
    base, logp = np.empty(len(row), np.uint8), np.empty(len(row))
    own = np.flatnonzero(i < 0)
    at = f_start[own] + f_off[row[own]] + t[own]
    base[own], logp[own] = reads.f.ravel()[at], _clamped(reads.fq.ravel()[at])
    own = np.flatnonzero(behind >= 0)
    at = r_start[own] + (reads.r_len - overlap - 1)[row[own]] - behind[own]
    base[own], logp[own] = reads.r.ravel()[at], _clamped(reads.rq.ravel()[at])
    # places that both reads have
    own = np.flatnonzero((i >= 0) & (behind < 0))
    pair = row[own]
    fi, ri = f_off[pair] + t[own], (reads.r_len - 1 + np.minimum(df, 0))[pair] - i[own]
    at, to = f_start[own] + fi, r_start[own] + ri
    a, aq, b, bq = reads.f.ravel()[at], reads.fq.ravel()[at], reads.r.ravel()[to], reads.rq.ravel()[to]
    f_dark, r_dark = fi >= _clear(reads.right[1][:, ::-1], reads.f_len)[pair], ri >= _clear(reads.turned[1], reads.r_len)[pair]
    same = (a & b) != 0
    logp[own] = np.where(f_dark & r_dark, QUAL_NN, np.where(f_dark, _clamped(bq), np.where(r_dark, _clamped(aq), cfg.algorithm.match(same, aq, bq))))
    base[own] = np.where(same, a & b, np.where(aq < bq, b, a))
    quality = np.bincount(row, logp, n) / (df + overlap + dr + 1)
    return Merged(base, logp, off, quality, np.bincount(pair[~same], minlength=n).astype(np.int64), np.bincount(row[~_ONE[base]], minlength=n).astype(np.int64))


@dataclass
class Result:
    """Results of pairs: a status and numbers for each; numbers of rows without any are -1, merged rows are in ``done``."""

    status: np.ndarray
    examined: np.ndarray
    slow: np.ndarray
    overlap: np.ndarray
    score: np.ndarray
    f_off: np.ndarray
    r_off: np.ndarray
    done: np.ndarray  # rows that are merged, in order
    merged: Merged | None


def assemble_reads(reads: Reads, cfg: AssemblerConfig) -> Result:
    """Results of pairs of any lengths."""
    n = len(reads)
    log_t = float(np.log(cfg.threshold))
    status, minus = np.full(n, BADR), lambda: np.full(n, -1, np.int64)
    out = Result(status, minus(), np.zeros(n, bool), minus(), np.full(n, np.nan), minus(), minus(), np.zeros(0, np.int64), None)
    alive = (reads.f_len >= 2) & (reads.r_len >= 2)
    f_off, r_off = np.full(n, cfg.forward_trim), np.full(n, cfg.reverse_trim)
    if cfg.primers_after:
        f_off[:] = r_off[:] = 0
    else:
        for primer, mask, q, length, own, code, comp in ((cfg.forward_primer, reads.f, reads.fq, reads.f_len, f_off, NOFP, False), (cfg.reverse_primer, reads.r, reads.rq, reads.r_len, r_off, NORP, True)):
            if primer:
                c = np.clip(q, 0, PHRED_MAX)
                got = primer_offsets(mask, QUAL_SCORE[c], QUAL_SCORE_ERR[c], nucleotides(primer, comp), log_t, cfg.primer_penalty, cfg.algorithm.semantics, length)
                status[alive & (got == 0)] = code
                alive &= got > 0
                own[:] = np.maximum(got - 1, 0)
    at = np.flatnonzero(alive & (np.minimum(reads.f_len, reads.r_len) >= cfg.min_overlap))
    if not len(at):
        return out
    best = best_overlap(reads.take(at), cfg, f_off[at], r_off[at])
    status[at] = NOALGN
    out.examined[at], out.slow[at] = best["examined"], best["slow"]
    size = reads.f_len[at] - f_off[at] - best["overlap"] + reads.r_len[at] - r_off[at]
    won = (best["overlap"] >= 0) & (size + 1 > 0)
    if cfg.max_len:
        won &= size + 1 <= 2 * cfg.max_len
    done = out.done = at[won]
    if not len(done):
        return out
    status[done] = OK
    out.overlap[done], out.score[done], out.f_off[done], out.r_off[done] = best["overlap"][won], best["score"][won], f_off[done], r_off[done]
    out.merged = m = merge(reads.take(done), cfg, out.overlap[done], f_off[done], r_off[done])
    if cfg.primers_after:
        _clip_after(out, cfg, log_t)
    status[done[(status[done] == OK) & (m.quality < log_t)]] = LOWQ
    return out


def _clip_after(out: Result, cfg: AssemblerConfig, log_t: float) -> None:
    """Primers or trims on merged rows; a base that does not match rules a place out.  Rows without the primer stay whole."""
    m, done = out.merged, out.done
    length = np.diff(m.off)
    base, logp = np.zeros((len(done), int(length.max())), np.uint8), np.zeros((len(done), int(length.max())))
    _, row, t = _index(length)
    base[row, t], logp[row, t] = m.base, m.logp
    wrong, cut, good = np.full(logp.shape, np.nan), [], np.ones(len(done), bool)
    for primer, trim, code, comp in ((cfg.forward_primer, cfg.forward_trim, NOFP, False), (cfg.reverse_primer, cfg.reverse_trim, NORP, True)):
        if not primer:
            cut.append(np.full(len(done), trim))
            continue
        side = (_turned(base, length), _turned(logp, length)) if comp else (base, logp)
        got = primer_offsets(*side, wrong, nucleotides(primer, comp), log_t, cfg.primer_penalty, cfg.algorithm.semantics, length)
        out.status[done[good & (got == 0)]] = code
        good &= got > 0
        cut.append(np.maximum(got - 1, 0))
    short = good & (length <= cut[0] + cut[1])
    out.status[done[short]] = NOFP
    good &= ~short
    first, last = np.where(good, cut[0], 0), np.where(good, length - cut[1], length)
    keep = (t >= first[row]) & (t < last[row])
    m.base, m.logp, m.off = m.base[keep], m.logp[keep], np.concatenate([[0], np.cumsum(last - first)])
    out.f_off[done[good]], out.r_off[done[good]] = cut[0][good], cut[1][good]


def letters(base: np.ndarray) -> str:
    return nt.TO_ASCII[base].tobytes().decode()
