"""Quality scores and log-probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

PHRED_MAX = 46


def six_digits(x: float) -> float:
    """The value after printing with six significant digits, as all tables are kept."""
    return float(f"{x:g}")


def _error(q: np.ndarray | float):
    return 10.0 ** (-np.asarray(q, float) / 10)


_q = np.arange(PHRED_MAX + 1)
#: ln(1 - p) of each score (-2 for score 0), ln(p), and the log-probability of a random base.
QUAL_SCORE = np.array([-2.0] + [six_digits(np.log(1 - _error(q))) for q in _q[1:]])
QUAL_SCORE_ERR = np.array([six_digits(np.log(_error(q))) if q else 0.0 for q in _q])
QUAL_NN = six_digits(np.log(0.25))


def clamp(q: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(PHRED_MAX), q))


def probability_of_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def _lookup(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def log_probability(q: Column) -> Column:
    """ln of the probability that a base of this score is right."""
    return _lookup(QUAL_SCORE, clamp(q))


def probability(q: Column) -> Column:
    return F.exp(log_probability(q))


def index_of(char: Column, offset: int = 33) -> Column:
    """The score of a quality character; characters above the cap give ``46 - offset``."""
    v = F.ascii(char) - offset
    return F.when(v > PHRED_MAX, PHRED_MAX - offset).when(v < 0, 0).otherwise(v)


def index_table(offset: int) -> np.ndarray:
    """Scores of all 256 characters, as :func:`index_of`."""
    v = np.arange(256) - offset
    return np.where(v > PHRED_MAX, PHRED_MAX - offset, np.maximum(v, 0)).astype(np.int16)


#: Results of the re-quantiser inside each interval between two table scores.
_INSIDE = np.array([i if i % 3 == 0 else i + 1 for i in range(PHRED_MAX)])


def requantise_array(p: np.ndarray) -> np.ndarray:
    """The output score of log-probabilities (numpy twin of :func:`requantise`)."""
    at = np.searchsorted(QUAL_SCORE, p, "right") - 1
    safe = np.clip(at, 0, PHRED_MAX - 1)
    exact = QUAL_SCORE[np.clip(at, 0, PHRED_MAX)] == p
    out = np.where(exact, np.minimum(at, PHRED_MAX - 1), _INSIDE[safe])
    out = np.where(p > QUAL_SCORE[PHRED_MAX - 1], PHRED_MAX - 1, out)
    return np.where(p <= QUAL_SCORE[0], 1, out).astype(np.int16)


def requantise(p: Column) -> Column:
    """The output score of a log-probability: a search that is not rounding."""
    out = F.when(p <= float(QUAL_SCORE[0]), 1)
    for i in range(1, PHRED_MAX):
        out = out.when(p < float(QUAL_SCORE[i]), int(_INSIDE[i - 1])).when(p == float(QUAL_SCORE[i]), i)
    return out.otherwise(PHRED_MAX - 1)


def log1mexp(p: Column) -> Column:
    """ln(1 - exp(-p)) as the reference computes it: a log-probability as argument gives NaN."""
    small = F.when(-F.expm1(-p) > 0, F.log(-F.expm1(-p))).when(p == 0, float("-inf")).otherwise(float("nan"))
    return F.when(p > float(np.log(2)), F.log1p(-F.exp(-p))).otherwise(small)
