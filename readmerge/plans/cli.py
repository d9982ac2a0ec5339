"""Command lines: ``assemble``, ``diff``, ``hang`` and ``checkid``.

``assemble`` and ``hang`` run one job that writes merged reads (and pairs that didn't align) in order of the input and counts what the log
tells; a second one over the same files runs only for ``-d F``, which lists the records that were left out.
"""

from __future__ import annotations

import argparse
import bz2
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession, functions as F

from .. import __version__
from ..functions import seqid
from ..operators import diff as df
from ..operators import filters, stats
from ..operators.algorithms import REGISTRY, algorithm
from ..operators.assemble import assemble
from ..operators.clip import trim_overhangs
from ..operators.config import AssemblerConfig
from ..sources import sinks
from ..sources.fastq import fastq_diagnostics, read_fastq_pairs


def _input_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-f", required=True, help="forward FASTQ files, comma-separated")
    p.add_argument("-r", required=True, help="reverse FASTQ files")
    p.add_argument("-i", help="index FASTQ files")
    p.add_argument("-6", dest="six", action="store_true", help="qualities from 64 up")
    p.add_argument("-B", dest="no_tag", action="store_true", help="headers may lack a tag")


def _assembly_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-A", default="simple_bayesian", help="algorithm[:argument]")
    p.add_argument("-C", action="append", default=[], help="module[:arguments]; may be repeated")
    p.add_argument("-D", type=float, default=0.0, help="primer penalty")
    p.add_argument("-L", type=int, help="longest sequence")
    p.add_argument("-N", action="store_true", help="no degenerate bases")
    p.add_argument("-O", type=int, default=0, help="longest overlap")
    p.add_argument("-a", action="store_true", help="primers after assembly")
    p.add_argument("-k", type=int, default=2, help="places kept for each k-mer")
    p.add_argument("-l", type=int, help="shortest sequence")
    p.add_argument("-o", type=int, default=2, help="shortest overlap")
    p.add_argument("-p", help="forward primer or bases to trim")
    p.add_argument("-q", help="reverse primer or bases to trim")
    p.add_argument("-t", type=float, default=0.6, help="quality threshold")


def config_of(a: argparse.Namespace) -> AssemblerConfig:
    modules = [filters.load(x) for x in a.C]
    modules += [filters.degenerate()] if a.N else []
    modules += [filters.short(str(a.l))] if a.l is not None else []
    modules += [filters.long(str(a.L))] if a.L is not None else []
    cfg = AssemblerConfig(algorithm=algorithm(a.A), min_overlap=max(a.o, 2), max_overlap=a.O, threshold=a.t, primer_penalty=a.D, primers_after=a.a, num_kmers=a.k, modules=tuple(modules), phred=64 if getattr(a, "six", False) else 33)
    for side, text in (("forward", a.p), ("reverse", a.q)):
        if text:
            primer, trim = AssemblerConfig.primer_or_trim(text)
            cfg = replace(cfg, **{f"{side}_primer": primer, f"{side}_trim": trim})
    return cfg


def listing() -> str:
    """Algorithms and modules, as the help shows them."""
    lines = [f"algorithms: {', '.join(sorted(REGISTRY))}", "modules:"]
    return "\n".join(lines + [f"  {m['name']}{':' + m['usage'] if m['usage'] else ''}: {m['description'].splitlines()[0] if m['description'] else ''}" for m in filters.describe()])


def _session(tasks: int | None) -> SparkSession:
    if tasks and SparkSession.getActiveSession() is None:
        return SparkSession.builder.master(f"local[{tasks}]").getOrCreate()
    return SparkSession.builder.getOrCreate()


def _pairs(spark: SparkSession, a: argparse.Namespace):
    return read_fastq_pairs(spark, a.f, a.r, a.i, tag="optional" if a.no_tag else "present")


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    command, rest = (argv[0], argv[1:]) if argv else ("", [])
    p = argparse.ArgumentParser(prog=f"readmerge {command}".strip(), epilog=listing() if command in ("assemble", "hang", "diff") else None, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-v", action="version", version=f"readmerge {__version__}", help="version")
    if command in ("assemble", "hang"):
        _input_options(p)
        _assembly_options(p)
        p.add_argument("-F", action="store_true", help="FASTQ output")
        out = p.add_mutually_exclusive_group()
        out.add_argument("-w", help="output file (standard output if none is given)")
        out.add_argument("-W", help="output file, bzip2")
        lost = p.add_mutually_exclusive_group()
        lost.add_argument("-u", action="store_true", help="pairs that don't align to a second file: -w and -W name a folder with the files merged and unaligned")
        lost.add_argument("-U", action="store_true", help="as -u, with qualities")
        log = p.add_mutually_exclusive_group()
        log.add_argument("-g", help="log file (standard error if none is given)")
        log.add_argument("-G", help="log file, bzip2")
        p.add_argument("-d", default="", help="log: F lists records that were left out, s leaves statistics out")
        p.add_argument("-T", type=int, help="tasks at once, where no session runs yet")
        if command == "hang":
            p.add_argument("-P", help="forward overhang primer")
            p.add_argument("-Q", help="reverse overhang primer")
            p.add_argument("-s", action="store_true", help="keep pairs without the primer")
            p.add_argument("--hang-threshold", type=float, default=0.6, help="least probability of an overhang primer")
        a = p.parse_args(rest)
        if (a.u or a.U) and not (a.w or a.W):
            p.error("-u and -U need -w or -W")
        began = time.time()
        spark = _session(a.T)
        pairs = _pairs(spark, a)
        if command == "hang":
            pairs = trim_overhangs(pairs, forward=a.P, reverse=a.Q, threshold=a.hang_threshold, skip=a.s, phred=64 if a.six else 33)
        cfg = config_of(a)
        result = assemble(pairs, cfg, with_logp=a.F or any(m.stage == "check" for m in cfg.modules), keep_reads=bool(a.u or a.U))
        in_order = all(m.name != "filter" for m in cfg.modules)  # the join with an id list may shuffle
        counts = sinks.write_assembly(result, a.w or a.W or "", fastq=a.F, unaligned="fastq" if a.U else "fasta" if a.u else None, layout="single" if a.w or a.W else "stdout", compression="bzip2" if a.W else "none", in_order=in_order)
        lines = []
        if "F" in a.d:
            lost = fastq_diagnostics(spark, a.f, a.r, a.i, tag="optional" if a.no_tag else "present").orderBy("file_pair", "record")
            for r in lost.toLocalIterator():
                lines += ["\t".join(x for x in (r["line"], r["header"], r["path"]) if x), *([f"* * * * * {r['hint']}"] if r["hint"] else [])]
        if "s" not in a.d:
            lines += [f"STAT\tTIME\t{time.ctime()}", f"STAT\tELAPSED\t{int(time.time() - began)}", *stats.log_lines(counts, cfg)]
        text = "".join(x + "\n" for x in lines)
        if a.g or a.G:
            with open(a.g, "w") if a.g else bz2.open(a.G, "wt") as f:
                f.write(text)
        else:
            sys.stderr.write(text)
        return 0
    if command == "diff":
        common, control, experiment = _split(rest)
        _input_options(p)
        _assembly_options(p)
        spark = SparkSession.builder.getOrCreate()
        one, two = p.parse_args(common + control), p.parse_args(common + experiment)
        rows = df.diff(_pairs(spark, one).cache(), config_of(one), config_of(two)).cache()
        rows.where(~F.col("kind").isin("same", "both_fail")).orderBy("ordinal").show(truncate=False)
        summary = df.diff_summary(rows).first()
        print(summary.asDict())
        return 0 if summary["total"] == summary["equal"] else 2
    if command == "checkid":
        spark = SparkSession.builder.getOrCreate()
        for h, r in ((h, spark.range(1).select(seqid.parse(F.lit(h), "optional").alias("r")).first()["r"]) for h in rest):
            print(h, "BAD" if not r["mate"] else f"{r['format']} mate {r['mate']} {r['id'].asDict()}")
        return 0
    print("usage: readmerge assemble|diff|hang|checkid ...", file=sys.stderr)
    return 1


def _split(args: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Options before, between and behind two ``--``."""
    at = [i for i, x in enumerate(args) if x == "--"]
    if len(at) != 2:
        raise SystemExit("usage: readmerge diff common -- control -- experimental")
    return args[: at[0]], args[at[0] + 1 : at[1]], args[at[1] + 1 :]


if __name__ == "__main__":
    sys.exit(main())
