"""Overlap scoring models: a registry of frozen parameter sets.

Every model has ``score`` (the value maximised over overlaps, from counts or paired qualities) and ``match`` (the
log-probability of a base that both reads give).  ``semantics="reference"`` keeps known quirks of the reference;
``"paper"`` uses the published formula where they differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from ..functions import tables as tb
from ..functions.phred import PHRED_MAX, QUAL_NN, QUAL_SCORE


def _clamped(q: np.ndarray) -> np.ndarray:
    return np.clip(q, 0, PHRED_MAX)


@dataclass(frozen=True)
class Overlap:
    """Paired bases of one candidate overlap for many pairs: sets and scores (rows: pairs), and the read lengths of each.

    ``alias`` gives forward scores at the reverse read's places; ``there`` tells which places lie in both reads (None: all).
    """

    f: np.ndarray
    r: np.ndarray
    fq: np.ndarray
    rq: np.ndarray
    alias: Callable[[], np.ndarray]
    forward: np.ndarray
    reverse: np.ndarray
    overlap: int
    there: np.ndarray | None = None

    def rows(self, use: np.ndarray | None) -> Overlap:
        """Some of the pairs (None: all)."""
        if use is None:
            return self
        there = None if self.there is None else self.there[use]
        return Overlap(self.f[use], self.r[use], self.fq[use], self.rq[use], lambda: self.alias()[use], self.forward[use], self.reverse[use], self.overlap, there)

    @property
    def size(self) -> np.ndarray:
        """Places of each pair."""
        return np.full(len(self.f), self.f.shape[1]) if self.there is None else self.there.sum(1)

    def total(self, each: np.ndarray) -> np.ndarray:
        """Sums of a value of each place, from the first on."""
        if self.there is not None:
            each = np.where(self.there, each, 0)
        return each.cumsum(1)[:, -1] if each.shape[1] else np.zeros(len(each))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches, mismatches, and positions where either base is N."""
        unknown = (self.f == 15) | (self.r == 15)
        match = ((self.f & self.r) != 0) & ~unknown
        if self.there is not None:
            unknown, match = unknown & self.there, match & self.there
        u, m = unknown.sum(1), match.sum(1)
        return m, self.size - u - m, u


@dataclass(frozen=True)
class Algorithm:
    name: str = ""
    semantics: str = "reference"

    def score(self, o: Overlap) -> np.ndarray:
        raise NotImplementedError

    def match(self, same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(same, tb.MATCH_BAYES[_clamped(a), _clamped(b)], tb.MISMATCH_BAYES[_clamped(a), _clamped(b)])


@dataclass(frozen=True)
class _ByCounts(Algorithm):
    error: float = 0.36

    def rates(self) -> tuple[float, float]:
        raise NotImplementedError

    def score(self, o: Overlap) -> np.ndarray:
        m, x, u = o.counts()
        match, mismatch = self.rates()
        whole = (o.overlap >= o.forward) & (o.overlap >= o.reverse)
        alone = np.where(whole, u, o.forward + o.reverse - 2 * o.overlap + u)
        out = QUAL_NN * alone + m * match + x * mismatch
        # an unsigned count of unpaired bases: below zero it is huge, so the candidate never wins
        return np.where(alone < 0, -np.inf, out) if self.semantics == "reference" else out


@dataclass(frozen=True)
class SimpleBayesian(_ByCounts):
    name: str = "simple_bayesian"

    def rates(self) -> tuple[float, float]:
        e = self.error
        return float(np.log(0.25 * (1 - 2 * e + e * e))), float(np.log((3 * e - 2 * e * e) / 18))


@dataclass(frozen=True)
class Uparse(_ByCounts):
    name: str = "uparse"

    def rates(self) -> tuple[float, float]:
        e = self.error
        return float(np.log(1 - e * e * (1 - 2 * e + 4 * e * e / 3))), float(np.log(1 - 4 * e / 3 / (2 * e - 4 * e * e / 3)))

    def match(self, same, a, b):
        return np.where(same, tb.MATCH_UPARSE[_clamped(a), _clamped(b)], tb.MISMATCH_UPARSE[_clamped(a), _clamped(b)])


@dataclass(frozen=True)
class EaUtil(Algorithm):
    name: str = "ea_util"

    def score(self, o: Overlap) -> np.ndarray:
        m, _, _ = o.counts()
        n = o.size
        x = (n - m).astype(float)
        with np.errstate(divide="ignore"):
            cost = np.log((x * x + 1) / n)
        return cost if self.semantics == "reference" else -cost

    def match(self, same, a, b):
        return QUAL_SCORE[_clamped(np.maximum(a, b))]


@dataclass(frozen=True)
class Flash(Algorithm):
    name: str = "flash"

    def score(self, o: Overlap) -> np.ndarray:
        m, _, _ = o.counts()
        n = o.size
        # a whole-number quotient: only an overlap of nothing but mismatches counts
        score = np.where(m == 0, 0.0, -np.inf) if self.semantics == "reference" else -(n - m) / np.maximum(n, 1)
        return np.where(n == 0, -2.0, score)

    def match(self, same, a, b):
        return np.where(same, QUAL_SCORE[_clamped(np.maximum(a, b))], QUAL_SCORE[np.maximum(2, np.abs(_clamped(a) - _clamped(b)))])


@dataclass(frozen=True)
class Pear(Algorithm):
    name: str = "pear"
    random_base: float = 0.25

    def score(self, o: Overlap) -> np.ndarray:
        unknown = (o.f == 15) | (o.r == 15)
        match = (o.f & o.r) != 0
        a = _clamped(o.fq)
        b = _clamped(o.alias() if self.semantics == "reference" else o.rq)
        with np.errstate(divide="ignore"):
            each = np.where(unknown, -np.log(self.random_base), np.where(match, tb.MATCH_PEAR[a, b], tb.MISMATCH_PEAR[a, b]))
        return o.total(each)

    def match(self, same, a, b):
        return np.where(same, tb.MATCH_PEAR[_clamped(a), _clamped(b)], tb.MISMATCH_PEAR[_clamped(a), _clamped(b)])


@dataclass(frozen=True)
class RdpMle(Algorithm):
    name: str = "rdp_mle"

    def score(self, o: Overlap) -> np.ndarray:
        a, b = _clamped(o.fq), _clamped(o.rq)
        each = np.where((o.f & o.r) != 0, tb.MATCH_BAYES[a, b], tb.MISMATCH_RDP[a, b]) - QUAL_NN
        return o.total(each)

    def match(self, same, a, b):
        return np.where(same, QUAL_SCORE[_clamped(np.maximum(a, b))], tb.MISMATCH_RDP_ASSEMBLED[_clamped(a), _clamped(b)])


@dataclass(frozen=True)
class Stitch(Algorithm):
    name: str = "stitch"

    def score(self, o: Overlap) -> np.ndarray:
        m, x, _ = o.counts()
        s = (m - x).astype(float)
        if self.semantics == "reference":  # an unsigned sum: below zero it is close to 2**64
            s = np.where(s < 0, 2.0**64 + s, s)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(s > 0, np.log(np.maximum(s, 1e-300) / (o.forward + o.reverse)), -np.inf)


REGISTRY: dict[str, Algorithm] = {}


def register(a: Algorithm) -> None:
    """Make a model known by its name."""
    REGISTRY[a.name] = a


for _a in (SimpleBayesian(), EaUtil(), Flash(), Pear(), RdpMle(), Stitch(), Uparse()):
    register(_a)


def algorithm(spec: str, semantics: str = "reference") -> Algorithm:
    """A model from ``name`` or ``name:argument``; an unknown name or a refused argument is an error."""
    name, colon, arg = spec.partition(":")
    if name not in REGISTRY:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(sorted(REGISTRY))}")
    found = replace(REGISTRY[name], semantics=semantics)
    if not colon:
        return found
    field = "error" if isinstance(found, _ByCounts) else "random_base" if isinstance(found, Pear) else None
    if field is None:
        raise ValueError(f"{name} takes no argument")
    value = float(arg)
    if not 0 <= value <= 1:
        raise ValueError(f"{value} is not a probability")
    return replace(found, **{field: value}) if 0 < value < 1 else found
