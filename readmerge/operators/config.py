"""Settings of an assembly, immutable; ``dataclasses.replace`` makes variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions import nt
from .algorithms import Algorithm, SimpleBayesian


@dataclass(frozen=True)
class Module:
    """A filter.  ``apply(df)`` returns the (possibly widened) table and the condition under which a row stays.

    ``stage``: ``precheck`` sees the pair before alignment, ``check`` the merged row.  With ``reads_settings``, ``apply`` gets
    the assembly's settings as its second argument.
    """

    name: str
    stage: str
    apply: Callable[..., tuple[DataFrame, Column]]
    description: str = ""
    usage: str = ""
    version: str = "1.0"
    reads_settings: bool = False
    #: Instead of ``apply``: a function of a record batch with ``columns`` that returns which rows stay; it runs inside the kernel's map.
    batch: Callable | None = None
    columns: tuple[str, ...] = ()
    #: The header of the pair where ``after`` begins and ``before`` ends.
    marker: str | None = None

    def on(self, df: DataFrame, cfg: AssemblerConfig) -> tuple[DataFrame, Column]:
        return self.apply(df, cfg) if self.reads_settings else self.apply(df)


def nucleotides(primer: str, complement: bool = False) -> tuple[int, ...]:
    """The sets of a primer's letters; any other letter is an error."""
    table = nt.FROM_ASCII_COMPLEMENT if complement else nt.FROM_ASCII
    out = tuple(int(table[ord(c)]) for c in primer)
    if 0 in out:
        raise ValueError(f"not a nucleotide in primer {primer!r}")
    return out


@dataclass(frozen=True)
class AssemblerConfig:
    algorithm: Algorithm = SimpleBayesian()
    forward_primer: str | None = None
    reverse_primer: str | None = None
    forward_trim: int = 0
    reverse_trim: int = 0
    min_overlap: int = 2
    max_overlap: int = 0
    threshold: float = 0.6
    primer_penalty: float = 0.0
    primers_after: bool = False
    num_kmers: int = 2
    exhaustive: bool = False  # score every overlap instead of those that share a k-mer
    modules: tuple[Module, ...] = ()
    phred: int = 33
    max_len: int | None = None
    name: str = ""

    def __post_init__(self) -> None:
        if not 0 < self.threshold < 1:
            raise ValueError("the threshold must lie between 0 and 1")
        if not 0 <= self.primer_penalty < 1:
            raise ValueError("the primer penalty must be at least 0 and below 1")
        if self.min_overlap < 2 or self.max_overlap < 0 or self.num_kmers < 1:
            raise ValueError("overlaps are at least 2, limits and k-mers not negative")
        if self.forward_primer and self.forward_trim or self.reverse_primer and self.reverse_trim:
            raise ValueError("give a primer or a trim for each read, not both")
        for p in (self.forward_primer, self.reverse_primer):
            if p:
                nucleotides(p)

    @staticmethod
    def primer_or_trim(text: str, max_len: int = 450) -> tuple[str | None, int]:
        """An option that is a number of bases or a primer."""
        if text.isdigit():
            if not 1 <= int(text) <= max_len:
                raise ValueError(f"a trim must lie between 1 and {max_len}")
            return None, int(text)
        nucleotides(text)
        return text, 0
