"""Codes of log lines and what they advise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The level of each code's line.
LEVELS = {
    "BADNT": "ERR", "BADID": "ERR", "MOD": "INFO", "NODATA": "ERR", "NOFILE": "ERR", "NOQUAL": "ERR", "NOTPAIRED": "ERR", "BADSEQ": "ERR",
    "READLEN": "ERR", "EOF": "ERR", "STAT": "STAT", "KLNG": "ERR", "FMER": "DBG", "RMER": "DBG", "FML": "DBG", "OLD": "INFO", "BESTOLP": "INFO",
    "NOFP": "ERR", "NORP": "ERR", "LOWQ": "ERR", "NEGS": "ERR", "OOM": "ERR", "BUILD": "INFO", "RECR": "INFO", "MISM": "INFO", "PHRED OFFSET": "INFO",
}
HINTS = {
    "BADID": "The header has no known format, or lacks a tag; read with tag='optional' if the tag is missing.",
    "PHRED OFFSET": "All scores suit another offset; set phred=64 if the files have it.",
    "READLEN": "A read continues on another line; each record must have four lines.",
    "EOF": "A file ended inside a record or before its mate.",
}


def line(code: Column) -> Column:
    """Level and code as a log line has them, parted by a tab."""
    out = F.when(code == "STAT", "STAT")
    for k, level in LEVELS.items():
        if k != "STAT":
            out = out.when(code == k, f"{level}\t{k}")
    return out.otherwise("ERR\tUNKNOWN ERROR")


def hint(code: Column) -> Column:
    """Advice on a code, null if there is none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, text in HINTS.items():
        out = out.when(code == k, text)
    return out
