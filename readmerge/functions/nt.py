"""Nucleotides as 4-bit sets: A=1, C=2, G=4, T=8; N is all four."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

#: Letter of each set, by its value; 0 has no letter of its own and prints as N.
LETTERS = "NACMGRSVTWYHKDBN"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUMRWSYKVHDBNX", "TGCAAKYWSRMBDHVNN"

_value = {c: i for i, c in enumerate(LETTERS) if i} | {"U": 8, "X": 15}


def _swap(v: int) -> int:
    """The complement of a set: A and T, C and G change places."""
    return (v & 1) << 3 | (v & 8) >> 3 | (v & 2) << 1 | (v & 4) >> 1


#: By the low five bits of the character, so case does not matter; ``.`` reads as N, ``-`` as M, ``4`` as T.
_low = {ord(c) & 0x1F: v for c, v in _value.items()}
FROM_ASCII = np.array([_low.get(i & 0x1F, 0) for i in range(256)], np.uint8)
FROM_ASCII_COMPLEMENT = np.array([_swap(int(v)) for v in FROM_ASCII], np.uint8)
TO_ASCII = np.array([ord(LETTERS[i]) if i < 16 else ord("N") for i in range(256)], np.uint8)


def from_ascii(c: Column, complement: bool = False) -> Column:
    """The set of the first character of a string (0: no nucleotide)."""
    table = FROM_ASCII_COMPLEMENT if complement else FROM_ASCII
    values = F.array(*[F.lit(int(table[i])) for i in range(32)])
    return F.element_at(values, (F.ascii(c).bitwiseAND(0x1F) + 1).cast("int"))


def to_ascii(mask: Column) -> Column:
    """The letter of a set; values outside 0 to 15 give N."""
    return F.when(mask.between(0, 15), F.substr(F.lit(LETTERS), mask + 1, F.lit(1))).otherwise("N")


def complement(mask: Column, semantics: str = "reference") -> Column:
    """The complement of a set; the reference's table gives V for both V and H."""
    fixed = [_swap(i) for i in range(16)]
    if semantics == "reference":
        fixed[_value["V"]] = fixed[_value["H"]] = _value["V"]
    return F.element_at(F.array(*[F.lit(x) for x in fixed]), (mask + 1).cast("int"))


def is_n(mask: Column) -> Column:
    return mask == 15


def is_degenerate(mask: Column) -> Column:
    """Not exactly one base (the empty set counts)."""
    return F.bit_count(mask) != 1


def matches(a: Column, b: Column) -> Column:
    """Two sets share a base; N matches everything."""
    return a.bitwiseAND(b) != 0


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def count_degenerate(seq: Column) -> Column:
    """Letters other than A, C, G, T and U in a sequence."""
    return (F.length(seq) - F.length(F.regexp_replace(F.upper(seq), "[^ACGTU]", ""))).cast("long")
