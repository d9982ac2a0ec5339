"""Probability matrices of two quality scores, kept to six significant digits."""

from __future__ import annotations

import sys

import numpy as np

from .phred import PHRED_MAX, six_digits

_TINY = sys.float_info.min


def matrix(f) -> np.ndarray:
    """ln f(p, q) for all pairs of scores, with p and q the error probabilities."""
    out = np.empty((PHRED_MAX + 1, PHRED_MAX + 1))
    for a in range(PHRED_MAX + 1):
        for b in range(PHRED_MAX + 1):
            p, q = 10.0 ** (-a / 10), 10.0 ** (-b / 10)
            out[a, b] = six_digits(np.log(f(p, q)))
    return out


def _positive(x: float) -> float:
    return x if x > 0 else _TINY


def _ratio(a: float, b: float) -> float:
    return a / b if b else float("inf") if a else float("nan")


def _rdp(p: float, q: float) -> float:
    x = 1 - _ratio(min(p, q) - p * q / 3, p + q - 4 / 3 * p * q)
    return x if x != 0 else _TINY


def _both(p: float, q: float) -> float:
    return (1 - p) * q / 3 + (1 - q) * p / 3


MATCH_BAYES = matrix(lambda p, q: (1 - p) * (1 - q) + p * q / 3)
MISMATCH_BAYES = matrix(lambda p, q: _both(p, q) + 2 * p * q / 9)
MISMATCH_RDP = MISMATCH_BAYES
MATCH_PEAR = matrix(lambda p, q: 1 - _both(p, q) - 2 * (1 - p) * (1 - q) / 9)
MISMATCH_PEAR = matrix(lambda p, q: _both(p, q) + p * q / 2)
MISMATCH_RDP_ASSEMBLED = matrix(_rdp)
MATCH_UPARSE = matrix(lambda p, q: _positive(1 - _ratio(p * q, 1 - p - q + 4 * p * q / 3)))
MISMATCH_UPARSE = matrix(lambda p, q: _positive(1 - _ratio(p + q / 3, p + q - 4 * p * q / 3)))
