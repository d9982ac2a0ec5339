"""Filter modules and their registry.  ``load("name:args")`` makes one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seqid
from ..functions.phred import PHRED_MAX, QUAL_SCORE
from .clip import with_primer_offset
from .config import AssemblerConfig, Module

API_VERSION = 3
REGISTRY: dict[str, Callable[[str], Module]] = {}


def filter_module(name: str, usage: str = ""):
    """Register a maker of modules under a name; it gets the text behind ``name:``."""

    def put(make: Callable[[str], Module]) -> Callable[[str], Module]:
        make.usage, make.description = usage, (make.__doc__ or "").strip()
        REGISTRY[name] = make
        return make

    return put


def load(spec: str) -> Module:
    """A module from ``name`` or ``name:args``."""
    name, _, args = spec.partition(":")
    if name not in REGISTRY:
        raise ValueError(f"unknown module {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](args)


def key_values(args: str) -> dict[str, str]:
    """Values by key of ``k=v,k=v``; a part without ``=`` and a key that comes twice are errors."""
    out: dict[str, str] = {}
    for part in filter(None, args.split(",")):
        k, sign, v = part.partition("=")
        if not sign or not k or k in out:
            raise ValueError(f"expected k=v,k=v, not {args!r}")
        out[k] = v
    return out


def check(name: str, condition: Column, **more) -> Module:
    """A module on merged rows from a plain condition."""
    return Module(name, "check", lambda df: (df, condition), **more)


def precheck(name: str, condition: Column, **more) -> Module:
    """A module on pairs from a plain condition."""
    return Module(name, "precheck", lambda df: (df, condition), **more)


def batch_module(name: str, stage: str, columns: tuple[str, ...], function: Callable, **more) -> Module:
    """A module from a function of Arrow record batches, fused into the kernel's map: no Column, no further pass over the rows.

    The function gets ``columns`` of the rows that no earlier module has rejected (a ``precheck``: of pairs; a ``check``: also of the results of
    merged rows), as often as Spark makes batches and again after a lost executor, and returns a boolean for each row; null is no.
    """
    from .assemble import PAIR, RESULT

    known = PAIR if stage == "precheck" else (*PAIR, *RESULT)
    if stage not in ("precheck", "check") or not columns or not set(columns) <= set(known):
        raise ValueError(f"a {stage} module can read {', '.join(known)}")
    return Module(name, stage, None, batch=function, columns=tuple(columns), **more)


def _int(args: str, low: int, high: float = math.inf) -> int:
    n = int(args)
    if not low <= n <= high:
        raise ValueError(f"{n} is out of range")
    return n


@filter_module("short", "n")
def short(args: str) -> Module:
    """At least n bases."""
    return check("SHORT", F.col("sequence_length") >= _int(args, 0))


@filter_module("long", "n")
def long(args: str) -> Module:
    """At most n bases."""
    return check("LONG", F.col("sequence_length") <= _int(args, 0))


@filter_module("degenerate")
def degenerate(args: str = "") -> Module:
    """No degenerate bases."""
    return check("DEGENERATE", F.col("degenerates") == 0)


@filter_module("empty")
def empty(args: str = "") -> Module:
    """Any bases at all."""
    return check("empty", F.col("sequence_length") > 0)


@filter_module("completely_miss_the_point", "n")
def completely_miss_the_point(args: str) -> Module:
    """At most n mismatches in the overlap."""
    return check("completely_miss_the_point", F.col("overlap_mismatches") <= _int(args, 0))


def reaches(p: Column, v: int) -> Column:
    """Whether the output score of a log-probability is at least v; output scores rise with p from score 1 on."""
    if v <= 0:
        return F.lit(True)
    if v >= PHRED_MAX:
        return F.lit(False)
    # the interval below score v has output v as well, unless it begins at a multiple of 3
    enough = p >= float(QUAL_SCORE[v]) if (v - 1) % 3 == 0 else p > float(QUAL_SCORE[v - 1])
    return enough | (p <= float(QUAL_SCORE[0])) if v == 1 else enough


@filter_module("min_phred", "v")
def min_phred(args: str) -> Module:
    """Every output score at least v."""
    v = _int(args, 0, 127)
    return check("min_phred", F.forall("logp", lambda p: reaches(p, v)))


@filter_module("min_overlapbits", "b")
def min_overlapbits(args: str = "") -> Module:
    """Overlap score of at least b bits (15 by default)."""
    return check("min_overlapbits", F.col("overlap_score") >= (float(args) if args else 15.0) * math.log(2))


@filter_module("overlap_stat")
def overlap_stat(args: str = "") -> Module:
    """Always passes; see stats.examined_histogram."""
    return check("overlap_stat", F.lit(True))


def is_marker(header: str) -> Column:
    """Whether a pair has the identifier of a header."""
    return F.struct(*[F.col("id")[f] for f in seqid.FIELDS]) == F.struct(*[seqid.parse(F.lit(header.removeprefix("@")), "optional")["id"][f] for f in seqid.FIELDS])


def _first_seen(df: DataFrame, header: str) -> DataFrame:
    """Add the least ordinal of the marker (null if it never comes)."""
    mark = df.where(is_marker(header))
    return df.crossJoin(F.broadcast(mark.agg(F.min("ordinal").alias("_mark"))))  # one row


@filter_module("after", "id")
def after(args: str) -> Module:
    """From the marked pair on."""
    return Module("after", "precheck", lambda df: (_first_seen(df, args), F.coalesce(F.col("ordinal") >= F.col("_mark"), F.lit(False))), marker=args)


@filter_module("before", "id")
def before(args: str) -> Module:
    """Before the marked pair; all pairs where it never comes."""
    return Module("before", "precheck", lambda df: (_first_seen(df, args), F.coalesce(F.col("ordinal") < F.col("_mark"), F.lit(True))), marker=args)


#: Bits of a block of a Bloom filter, and how many of them an identifier sets.
BLOCK_BITS, BITS_EACH = 1 << 15, 7


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits in there."""
    inside = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, BITS_EACH + 1)]
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)), inside


def bloom_filter(keys: DataFrame, most_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """A Bloom filter of distinct keys (column ``key``) as a table (block, words: 512 longs), and the number of blocks.

    Keys may come more than once.  Places of bits move to their blocks, and a task sets all bits of its blocks.  About 12 bits a key, but not over
    ``most_bits`` (32 MB), so it can be broadcast whatever the number of keys; beyond some 20 million of them it lets more through.
    """
    blocks = min(max(1, -(-12 * keys.count() // BLOCK_BITS)), max(1, most_bits // BLOCK_BITS))
    block, inside = _places(F.col("key"), blocks)
    names = [f"b{i}" for i in range(len(inside))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.zeros((blocks, BLOCK_BITS // 8), np.uint8), np.zeros(blocks, bool)
        for b in batches:
            own = b.column("block").to_numpy()
            seen[own] = True
            for c in names:
                at = b.column(c).to_numpy()
                np.bitwise_or.at(bits, (own, at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([bits[i].tobytes() for i in own], pa.binary())], ["block", "bits"])

    placed = keys.select(block.alias("block"), *[c.cast("int").alias(n) for c, n in zip(inside, names, strict=True)])
    rows = placed.repartition("block").mapInArrow(run, "block long, bits binary").collect()  # at most most_bits in all
    words = [(r["block"], np.frombuffer(bytes(r["bits"]), "<i8").tolist()) for r in rows]
    return keys.sparkSession.createDataFrame(words, "block long, words array<long>"), blocks


def maybe_members(df: DataFrame, key: Column, keys: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """Add ``_maybe``: False only where a key is certainly not among ``keys``; no row moves."""
    table, blocks = bloom_filter(keys, most_bits)
    block, inside = _places(key, blocks)
    all_set = F.lit(True)
    for bit in inside:
        word = F.element_at("_words", (F.shiftright(bit, 6) + 1).cast("int"))
        all_set = all_set & (F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    table = table.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    joined = df.join(F.broadcast(table), block == F.col("_block"), "left")  # most_bits at most
    return joined.withColumn("_maybe", F.coalesce(key.isNotNull() & all_set, F.lit(False))).drop("_block", "_words")


def id_set(ids: DataFrame, name: str = "filter", *, thin: bool = False) -> Module:
    """Only pairs whose identifier is in a set (column ``id``).  Spark decides from its size how to join.

    ``thin``: for sets too large to broadcast.  A Bloom filter tells the pairs that can't be members, which stay where they are; only the others
    are shuffled to the exact join.  The pairs are read twice for it.
    """

    def apply(df: DataFrame) -> tuple[DataFrame, Column]:
        given = ids.select(seqid.to_string(F.col("id")).alias("_known")).where("_known is not null")
        known, key = given.distinct(), seqid.to_string(F.col("id"))
        if not thin:
            return df.join(known, key == F.col("_known"), "left"), F.col("_known").isNotNull()
        told = maybe_members(df, key, given.select(F.col("_known").alias("key")))
        out = told.where(~F.col("_maybe")).withColumn("_known", F.lit(None).cast("string"))
        found = told.where("_maybe").join(known, key == F.col("_known"), "left").select(out.columns)
        return out.union(found).drop("_maybe"), F.col("_known").isNotNull()

    return Module(name, "precheck", apply)


@filter_module("filter", "path")
def filter_file(args: str) -> Module:
    """Only pairs whose header is a line of a file."""

    def apply(df: DataFrame) -> tuple[DataFrame, Column]:
        from ..sources.idlist import read_id_list

        return id_set(read_id_list(df.sparkSession, args)).apply(df)

    return Module("filter", "precheck", apply)


@filter_module("validtag", "tag:tag:...")
def validtag(args: str) -> Module:
    """Tags that begin with one of some tags of equal length."""
    tags = args.split(":")
    if len({len(t) for t in tags}) != 1 or not tags[0]:
        raise ValueError("valid tags must have one length")
    return precheck("validtag", F.substring(F.col("id")["tag"], 1, len(tags[0])).isin(tags))


@filter_module("other_primer", "f|r:PRIMER")
def other_primer(args: str) -> Module:
    """Pairs in which another primer is not found."""
    side, _, primer = args.partition(":")
    if side not in ("f", "p", "r", "q") or not primer:
        raise ValueError("expected f:PRIMER or r:PRIMER")
    forward = side in ("f", "p")
    read = "f" if forward else "r"

    def apply(df: DataFrame, cfg: AssemblerConfig) -> tuple[DataFrame, Column]:
        name = f"_other_{read}"
        return with_primer_offset(df, name, f"{read}_seq", f"{read}_qual", primer, reverse_read=not forward, backwards=not forward, threshold=0.9, penalty=0.01, phred=cfg.phred), F.col(name) == 0

    return Module("other_primer", "precheck", apply, reads_settings=True)


def pear_p_value(overlap: np.ndarray, mismatches: np.ndarray, shortest: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """1 - P**2 of the overlap statistic of each row; equal rows are computed once."""
    rows, back = np.unique(np.stack([overlap, mismatches, shortest], 1), axis=0, return_inverse=True)
    return _pear_p_values(*rows.T, alpha, beta)[np.ravel(back)]


def _pear_p_values(overlap: np.ndarray, mismatches: np.ndarray, shortest: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    score = alpha * (overlap - mismatches) + beta * mismatches
    out = np.empty(len(score))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    for n, (s, o, top) in enumerate(zip(score, overlap, shortest, strict=True)):
        p = 1.0
        for i in range(int(o), int(top)):
            last = math.ceil((s - beta * i) / (alpha - beta)) - 1
            k = np.arange(0, min(last, i + 1))  # the last one isn't counted
            p *= float(np.exp(lgamma(i + 1) - lgamma(k + 1) - lgamma(i - k + 1) + k * math.log(0.25) + (i - k) * math.log(0.75)).sum()) if len(k) else 0.0
        out[n] = 1 - p * p
    return out


@filter_module("pear_test", "alpha=1,beta=-1,cutoff=0.01")
def pear_test(args: str = "") -> Module:
    """A significant overlap.  Needs the read lengths: assemble with ``keep_reads``."""
    given = {"alpha": 1.0, "beta": -1.0, "cutoff": 0.01} | {k: float(v) for k, v in key_values(args).items()}
    if set(given) != {"alpha", "beta", "cutoff"} or not 0 <= given["cutoff"] <= 1:
        raise ValueError("expected alpha, beta, and a cutoff from 0 to 1")

    @F.pandas_udf("double")
    def p_value(o: pd.Series, x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(pear_p_value(o.fillna(0).to_numpy(), x.fillna(0).to_numpy(), s.fillna(0).to_numpy(), given["alpha"], given["beta"]))

    shortest = F.least(F.length("f_seq"), F.length("r_seq"))
    return Module("pear_test", "check", lambda df: (df, p_value("overlap", "overlap_mismatches", shortest) < given["cutoff"]))


def describe() -> list[dict]:
    """Name, usage and description of every module."""
    return [{"name": k, "usage": m.usage, "description": m.description, "api": API_VERSION} for k, m in sorted(REGISTRY.items())]
