"""Registered queries over read pairs derived from the given tables, and DuckDB SQL that computes the same rows.

SQL follows the pair view of ``plans.sim`` (reads of 64 bases, Ns in forward reads only).  Floating results are emitted as
``floor(x * 10000 + 0.5)``.
"""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import kmers, nt, phred, seqid
from .operators import clip, diff, filters, kernel, stats
from .operators.algorithms import REGISTRY, algorithm
from .operators.assemble import _matrices, _reads, assemble, overlap_offsets
from .operators.config import AssemblerConfig
from .plans import sim
from .sources import fastq, ordered, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LENGTH = sim.LENGTH


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _fixed(c):
    return F.floor(c * 10000 + 0.5).cast("long")


# --- SQL of the reference results ----------------------------------------------------------------------------------

_USED_F, _USED_R = (40, 30, 20, 2), (40, 35, 10, 2)


def _g(x: str) -> str:
    """A value with six significant digits, as all tables have."""
    return f"cast(printf('%g', {x}) as double)"


_P, _Q = "power(10.0, -a / 10.0)", "power(10.0, -b / 10.0)"
# the models' tables by their formulas, so that a wrong table of the engine shows
_FORMULAS = {
    "bayes": (f"(1 - {_P}) * (1 - {_Q}) + {_P} * {_Q} / 3", f"(1 - {_P}) * {_Q} / 3 + (1 - {_Q}) * {_P} / 3 + 2 * {_P} * {_Q} / 9"),
    "pear": (f"1 - (1 - {_Q}) * {_P} / 3 - (1 - {_P}) * {_Q} / 3 - 2 * (1 - {_P}) * (1 - {_Q}) / 9", f"(1 - {_P}) * {_Q} / 3 + (1 - {_Q}) * {_P} / 3 + {_P} * {_Q} / 2"),
    "uparse": (f"1 - {_P} * {_Q} / (1 - {_P} - {_Q} + 4 * {_P} * {_Q} / 3)", f"1 - ({_P} + {_Q} / 3) / ({_P} + {_Q} - 4 * {_P} * {_Q} / 3)"),
}
_LIST = lambda qs: ", ".join(f"({q})" for q in qs)


def _table(formulas: tuple[str, str], bs=_USED_R) -> str:
    """Rows a, b, v (match), w (mismatch) for all used pairs of scores."""
    v, w = (_g(f"ln({x})") for x in formulas)
    return f"SELECT a, b, {v} AS v, {w} AS w FROM (VALUES {_LIST(_USED_F)}) x(a), (VALUES {_LIST(bs)}) y(b)"


def _scores(qs) -> str:
    """Rows q, v (right), w (wrong)."""
    return f"SELECT q, {_g('ln(1 - power(10.0, -q / 10.0))')} AS v, {_g('ln(power(10.0, -q / 10.0))')} AS w FROM (VALUES {_LIST(qs)}) x(q)"


_NN = "-1.38629"

_KMERS = """
fk AS (SELECT ordinal, p, substr(f_seq, cast(p - 6 as bigint), 8) AS km FROM pairs, range(8, 64) t(p) WHERE instr(substr(f_seq, cast(p - 7 as bigint), 9), 'N') = 0),
fk2 AS (SELECT ordinal, p, km FROM (SELECT *, row_number() OVER (PARTITION BY ordinal, km ORDER BY p) AS rn FROM fk) WHERE rn <= 2),
rk AS (SELECT ordinal, j, substr(rc_seq, cast(j - 6 as bigint), 8) AS km FROM pairs, range(8, 64) t(j)),
hits AS (SELECT DISTINCT fk2.ordinal, 64 + j - p AS ov FROM fk2 JOIN rk ON fk2.ordinal = rk.ordinal AND fk2.km = rk.km WHERE 64 + j - p BETWEEN 2 AND 64),
cand AS (SELECT ordinal, ov FROM hits UNION ALL SELECT p.ordinal, r.ov FROM pairs p, range(2, 65) r(ov) WHERE p.ordinal NOT IN (SELECT ordinal FROM hits))
"""
_EVERY = "cand AS (SELECT p.ordinal, r.ov FROM pairs p, range(2, 65) r(ov))"


def _score_sql(name: str) -> str:
    """The score of a candidate from m, x, u (matches, mismatches, unknown), for models that count."""
    if name in ("simple_bayesian", "uparse"):
        e = 0.36
        m, x = {
            "simple_bayesian": (f"ln(0.25 * (1 - 2 * {e} + {e} * {e}))", f"ln((3 * {e} - 2 * {e} * {e}) / 18)"),
            "uparse": (f"ln(1 - {e} * {e} * (1 - 2 * {e} + 4 * {e} * {e} / 3))", f"ln(1 - 4 * {e} / 3 / (2 * {e} - 4 * {e} * {e} / 3))"),
        }[name]
        return f"({_NN} * (128 - 2 * ov + u) + m * {m} + x * {x})"
    return {
        "ea_util": "ln((cast(x + u as double) * (x + u) + 1) / ov)",
        "flash": "CASE WHEN m = 0 THEN 0.0 ELSE cast('-infinity' as double) END",
        "stitch": "CASE WHEN m > x THEN ln(cast(m - x as double) / 128) WHEN m < x THEN ln(18446744073709551616.0::DOUBLE / 128) ELSE cast('-infinity' as double) END",
    }[name]


def _best_sql(name: str = "simple_bayesian", cand: str = _KMERS, tag: str = "") -> str:
    """CTEs up to best (ordinal, ov, score, m, x, u, examined); no row where nothing wins."""
    c = cand.replace("cand AS", f"cand{tag} AS").strip()
    return f"""{c},
counted{tag} AS (SELECT c.ordinal, cast(c.ov as bigint) AS ov, length(right(f_seq, c.ov)) - length(replace(right(f_seq, c.ov), 'N', '')) AS u,
  hamming(right(f_seq, c.ov), left(rc_seq, c.ov)) AS ham FROM cand{tag} c JOIN pairs p ON c.ordinal = p.ordinal),
mxu{tag} AS (SELECT ordinal, ov, u, ov - ham AS m, ham - u AS x, count(*) OVER (PARTITION BY ordinal) AS examined FROM counted{tag}),
scored{tag} AS (SELECT *, {_score_sql(name)} AS score FROM mxu{tag}),
best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, ov) AS rn FROM scored{tag} WHERE score > {_NN} * 128) WHERE rn = 1)"""


_MERGE = f"""
fr AS (SELECT b.ordinal, b.ov, p.f_seq, p.rc_seq, p.f_qual, reverse(p.r_qual) AS c_qual, p.template, length(rtrim(p.f_qual, '#')) AS f_clear, length(rtrim(p.r_qual, '#')) AS r_clear,
  b.examined, b.score, b.x FROM best b JOIN pairs p ON b.ordinal = p.ordinal),
mt AS ({_table(_FORMULAS['bayes'])}),
qs AS ({_scores(sorted({*_USED_F, *_USED_R}))}),
bases AS (SELECT ordinal, ov, i, examined, score, x, template,
  CASE WHEN i <= 64 THEN substr(f_seq, i, 1) END AS fb, CASE WHEN i <= 64 THEN ascii(substr(f_qual, i, 1)) - 33 END AS fq, CASE WHEN i <= 64 THEN i > f_clear END AS fd,
  CASE WHEN i > 64 - ov THEN substr(rc_seq, i - 64 + ov, 1) END AS rb, CASE WHEN i > 64 - ov THEN ascii(substr(c_qual, i - 64 + ov, 1)) - 33 END AS rq,
  CASE WHEN i > 64 - ov THEN (64 - (i - 64 + ov)) >= r_clear END AS rd
  FROM (SELECT fr.*, unnest(range(1, 129 - ov)) AS i FROM fr)),
fused AS (SELECT bases.ordinal, ov, i, examined, score, x, template,
  CASE WHEN rb IS NULL THEN fb WHEN fb IS NULL THEN rb WHEN fb = 'N' OR fb = rb THEN rb WHEN fq < rq THEN rb ELSE fb END AS base,
  CASE WHEN rb IS NULL THEN q1.v WHEN fb IS NULL THEN q2.v WHEN fd AND rd THEN {_NN} WHEN fd THEN q2.v WHEN rd THEN q1.v WHEN fb = 'N' OR fb = rb THEN mt.v ELSE mt.w END AS p
  FROM bases LEFT JOIN qs q1 ON q1.q = fq LEFT JOIN qs q2 ON q2.q = rq LEFT JOIN mt ON mt.a = fq AND mt.b = rq),
merged AS (SELECT ordinal, ov, any_value(examined) AS examined, any_value(score) AS score, any_value(x) AS x, any_value(template) AS template, string_agg(base, '' ORDER BY i) AS sequence,
  sum(p) / (128 - ov + 1) AS quality, sum(CASE WHEN base NOT IN ('A', 'C', 'G', 'T') THEN 1 ELSE 0 END) AS degenerates, min(p) AS least FROM fused GROUP BY ordinal, ov),
ok AS (SELECT * FROM merged WHERE quality >= ln(0.6))
"""


def _full(select: str, keys: str = sim.KEYS) -> str:
    return f"{sim.pairs_sql(keys)}, {_best_sql()}, {_MERGE} {select}"


def _pairs_only(select: str) -> str:
    return f"{sim.pairs_sql()} {select}"


# --- assembly ------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return sim.read_pairs(spark, d)


def _assembled(spark: SparkSession, d: str, cfg: AssemblerConfig | None = None, **more) -> DataFrame:
    return assemble(_pairs(spark, d), cfg, with_logp=more.pop("with_logp", False), **more)


@query("assemble_simple_bayesian", _full("SELECT ordinal, ov AS overlap, sequence FROM ok"))
def _(spark, d):
    return _assembled(spark, d).where("status = 'OK'").select("ordinal", F.col("overlap").cast("long").alias("overlap"), "sequence")


@query("merged_quality", _full("SELECT ordinal, cast(floor(exp(quality) * 10000 + 0.5) as bigint) AS quality FROM ok"))
def _(spark, d):
    return _assembled(spark, d).where("status = 'OK'").select("ordinal", _fixed(F.exp("quality")).alias("quality"))


@query("merged_counts", _full("SELECT ordinal, cast(x as bigint) AS mismatches, cast(degenerates as bigint) AS degenerates, cast(length(sequence) as bigint) AS len, cast(examined as bigint) AS examined FROM ok"))
def _(spark, d):
    ok = _assembled(spark, d).where("status = 'OK'")
    return ok.select("ordinal", *[F.col(a).cast("long").alias(b) for a, b in (("overlap_mismatches", "mismatches"), ("degenerates", "degenerates"), ("sequence_length", "len"), ("overlaps_examined", "examined"))])


@query("lineitem_assembly_summary", _full("SELECT ov AS overlap, cast(count(*) as bigint) AS n, cast(sum(length(sequence)) as bigint) AS bases FROM ok GROUP BY ov", "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem"))
def _(spark, d):
    pairs = sim.read_pairs(spark, d, "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem", "lineitem")
    ok = assemble(pairs, with_logp=False).where("status = 'OK'")
    return ok.groupBy(F.col("overlap").cast("long").alias("overlap")).agg(F.count("*").alias("n"), F.sum(F.col("sequence_length").cast("long")).alias("bases"))


@query("kmer_candidates", f"{sim.pairs_sql()}, {_KMERS} SELECT ordinal, cast(count(*) as bigint) AS examined, count(*) = 63 AS slow FROM cand GROUP BY ordinal")
def _(spark, d):
    return _assembled(spark, d).select("ordinal", F.col("overlaps_examined").cast("long").alias("examined"), "slow")


def _best_query(name: str):
    sql = f"{sim.pairs_sql()}, {_best_sql(name, _EVERY)} SELECT ordinal, ov AS overlap, cast(floor(score * 10000 + 0.5) as bigint) AS score FROM best"

    @query(f"best_overlap_{name}", sql)
    def _(spark, d):
        cfg = AssemblerConfig(algorithm=algorithm(name), exhaustive=True, threshold=1e-9)
        out = _assembled(spark, d, cfg).where("overlap is not null")
        return out.select("ordinal", F.col("overlap").cast("long").alias("overlap"), _fixed(F.col("overlap_score")).alias("score"))


for _name in ("simple_bayesian", "uparse", "ea_util", "flash", "stitch"):
    _best_query(_name)


def overlap_scores(pairs: DataFrame, name: str) -> DataFrame:
    """ordinal and the model's score of each pair at its column ``true_overlap``."""
    model = algorithm(name)

    def run(batches):
        for b in batches:
            parts, _ = _reads(*(b.column(c) for c in ("f_seq", "f_qual", "r_seq", "r_qual")))
            place, out = b.column("true_overlap").to_numpy(), np.zeros(len(b))
            for o in np.unique(place):
                at = np.flatnonzero(place == o)
                out[at] = model.score(kernel.paired(_matrices(parts, at, 33), int(o)))
            yield pa.RecordBatch.from_arrays([b.column("ordinal"), pa.array(out)], ["ordinal", "score"])

    return pairs.select("ordinal", "f_seq", "f_qual", "r_seq", "r_qual", "true_overlap").mapInArrow(run, "ordinal long, score double")


def _position_sum(table: str, matched: str) -> str:
    """Values of places, added from the first on as the model does: in any other order a sum that lies halfway between two results rounds by chance."""
    return f"""{sim.pairs_sql()}, mt AS ({table}),
places AS (SELECT ordinal, i, substr(f_seq, 64 - true_overlap + i, 1) AS fb, substr(rc_seq, i, 1) AS rb, ascii(substr(f_qual, 64 - true_overlap + i, 1)) - 33 AS fq, ascii(substr(reverse(r_qual), i, 1)) - 33 AS rq,
  ascii(substr(f_qual, 65 - i, 1)) - 33 AS alias_q FROM (SELECT *, unnest(range(1, true_overlap + 1)) AS i FROM pairs))
SELECT ordinal, cast(floor(sum({matched} ORDER BY i) * 10000 + 0.5) as bigint) AS score FROM places LEFT JOIN mt ON mt.a = fq AND mt.b = """


_POSITION_SQL = {
    "pear": _position_sum(_table(_FORMULAS['pear'], _USED_F), "CASE WHEN fb = 'N' THEN -ln(0.25) WHEN fb = rb THEN v ELSE w END") + "alias_q GROUP BY ordinal",
    "rdp_mle": _position_sum(_table(_FORMULAS['bayes']), f"CASE WHEN fb = 'N' OR fb = rb THEN v ELSE w END - ({_NN})") + "rq GROUP BY ordinal",
}


def _score_query(name: str):
    sql = _POSITION_SQL.get(name)
    if sql is None:
        one = "cand AS (SELECT ordinal, true_overlap AS ov FROM pairs)"
        sql = f"{sim.pairs_sql()}, {_best_sql(name, one)} SELECT ordinal, CASE WHEN score = cast('-infinity' as double) THEN NULL ELSE cast(floor(score * 10000 + 0.5) as bigint) END AS score FROM scored"

    @query(f"overlap_score_{name}", sql)
    def _(spark, d):
        s = overlap_scores(_pairs(spark, d), name)
        return s.select("ordinal", F.when(F.col("score") > float("-inf"), _fixed(F.col("score"))).alias("score"))


for _name in REGISTRY:
    _score_query(_name)


# --- reads of other lengths and files ------------------------------------------------------------------------------

# reads cut to 45 to 64 bases; some null, empty or short, some scores null or too few
_CUT = """
CASE WHEN ordinal % 97 = 0 THEN NULL WHEN ordinal % 71 = 0 THEN substr(f_seq, 1, 12) WHEN ordinal % 67 = 0 THEN substr(f_seq, 1, 8) WHEN ordinal % 89 = 0 THEN substr(f_seq, 1, 1) ELSE substr(f_seq, cast(1 + ordinal % 20 as int), 64) END AS f_seq,
CASE WHEN ordinal % 83 = 0 THEN NULL WHEN ordinal % 79 = 0 THEN 'II' WHEN ordinal % 97 = 0 THEN f_qual WHEN ordinal % 71 = 0 THEN substr(f_qual, 1, 12) WHEN ordinal % 67 = 0 THEN substr(f_qual, 1, 8) WHEN ordinal % 89 = 0 THEN substr(f_qual, 1, 1) ELSE substr(f_qual, cast(1 + ordinal % 20 as int), 64) END AS f_qual,
CASE WHEN ordinal % 73 = 0 THEN '' ELSE substr(r_seq, cast(1 + ordinal % 15 as int), 64) END AS r_seq,
CASE WHEN ordinal % 73 = 0 THEN '' ELSE substr(r_qual, cast(1 + ordinal % 15 as int), 64) END AS r_qual"""


def mixed_pairs(spark: SparkSession, d: str) -> DataFrame:
    _pairs(spark, d).createOrReplaceTempView("readmerge_uncut")
    return spark.sql(f"SELECT ordinal, id, {_CUT} FROM readmerge_uncut")


def _mixed_sql(high: str) -> str:
    return f"""{sim.pairs_sql()}, cut AS (SELECT ordinal, {_CUT} FROM pairs),
read AS (SELECT *, reverse(translate(r_seq, 'ACGTN', 'TGCAN')) AS rc, length(f_seq) AS f, length(r_seq) AS r, coalesce(length(f_seq) >= 12 AND length(r_seq) >= 12 AND length(f_seq) = length(f_qual) AND length(r_seq) = length(r_qual), false) AS fine FROM cut),
cand AS (SELECT *, unnest(range(12, {high} + 1)) AS ov FROM read WHERE fine AND f > 12 AND r > 12),
counted AS (SELECT *, length(right(f_seq, ov)) - length(replace(right(f_seq, ov), 'N', '')) AS u, hamming(right(f_seq, ov), left(rc, ov)) AS ham FROM cand),
scored AS (SELECT *, {_NN} * (f + r - 2 * ov + u) + (ov - ham) * ln(0.25 * (1 - 2 * 0.36 + 0.36 * 0.36)) + (ham - u) * ln((3 * 0.36 - 2 * 0.36 * 0.36) / 18) AS score FROM counted),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, ov) AS rn FROM scored WHERE score > {_NN} * (f + r)) WHERE rn = 1)
SELECT read.ordinal, CASE WHEN NOT read.fine THEN 'BADR' WHEN best.ov IS NULL THEN 'NOALGN' ELSE 'OK' END AS status, cast(best.ov as bigint) AS overlap, cast(best.f + best.r - best.ov as bigint) AS len,
  cast(best.ham - best.u as bigint) AS mismatches, cast(floor(best.score * 10000 + 0.5) as bigint) AS score FROM read LEFT JOIN best ON best.ordinal = read.ordinal"""


def _mixed_query(name: str, high: str, **settings):
    @query(name, _mixed_sql(high))
    def _(spark, d):
        out = assemble(mixed_pairs(spark, d), AssemblerConfig(min_overlap=12, exhaustive=True, threshold=1e-9, **settings), with_logp=False)
        numbers = [F.col(a).cast("long").alias(b) for a, b in (("overlap", "overlap"), ("sequence_length", "len"), ("overlap_mismatches", "mismatches"))]
        return out.select("ordinal", "status", *numbers, F.when(F.col("overlap").isNotNull(), _fixed(F.col("overlap_score"))).alias("score"))


_mixed_query("assemble_mixed_lengths", "least(f, r)")
_mixed_query("assemble_max_overlap", "least(f + r - 13, 40)", max_overlap=40)


def _from_files(spark: SparkSession, d: str, pairs: DataFrame | None = None, split_bytes: int = fastq.SPLIT_BYTES, **how) -> DataFrame:
    """Pairs of the table, which come in order of their ordinals, written as FASTQ files and read back."""
    pairs = _pairs(spark, d) if pairs is None else pairs
    files = sinks.write_fastq_pairs(pairs, f"{ordered.session_folder(spark)}/pairs", in_order=True, **how)
    return fastq.read_fastq_pairs(spark, *files, mode="FAILFAST", split_bytes=split_bytes)


@query("fastq_files_assembled", _full("SELECT ordinal, ov AS overlap, sequence FROM ok"))
def _(spark, d):
    out = assemble(_from_files(spark, d), with_logp=False).where("status = 'OK'")
    return out.select(F.col("id.x").cast("long").alias("ordinal"), F.col("overlap").cast("long").alias("overlap"), "sequence")


_FILE_SQL = f"{sim.pairs_sql()} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS record, ordinal, f_seq, f_qual, r_seq, r_qual FROM pairs"


def _records(df: DataFrame) -> DataFrame:
    return df.select(F.col("ordinal").alias("record"), F.col("id.x").cast("long").alias("ordinal"), "f_seq", "f_qual", "r_seq", "r_qual")


@query("fastq_one_file_in_ranges", _FILE_SQL)
def _(spark, d):
    """One file a mate, written by many tasks and read in ranges: record n of the files is the n-th pair."""
    return _records(_from_files(spark, d, layout="single", split_bytes=1 << 19))


@query("fastq_bzip2_in_blocks", _FILE_SQL)
def _(spark, d):
    """As before, with bzip2 files of many streams that are read by their blocks."""
    return _records(_from_files(spark, d, layout="single", compression="bzip2", split_bytes=1 << 16))


_DOTS = "CASE WHEN ordinal % 7 = 0 THEN replace(f_seq, 'N', '.') ELSE lower(f_seq) END"


@query("fastq_dots_assembled", _full("SELECT ordinal, ov AS overlap, sequence FROM ok"))
def _(spark, d):
    """Files that write N as a dot, and bases in small letters, give the same merged rows."""
    pairs = _pairs(spark, d).withColumn("f_seq", F.expr(_DOTS))
    out = assemble(_from_files(spark, d, pairs), with_logp=False).where("status = 'OK'")
    return out.select(F.col("id.x").cast("long").alias("ordinal"), F.col("overlap").cast("long").alias("overlap"), "sequence")


@query("fasta_records", _full("SELECT concat('>SIM:', cast(ordinal % 7 as varchar), ':FC:', cast(ordinal % 8 as varchar), ':', cast(ordinal % 100 as varchar), ':', cast(ordinal as varchar), ':', cast(ordinal % 1000 as varchar), ':', substr(template, 1, 6)) AS head, sequence FROM ok"))
def _(spark, d):
    lines = sinks.fasta(_assembled(spark, d)).select(F.split("value", "\n").alias("v"))
    return lines.select(F.split(F.col("v")[0], ";")[0].alias("head"), F.col("v")[1].alias("sequence"))


# --- clipping ------------------------------------------------------------------------------------------------------


@query("primer_trim_fixed", _full("SELECT ordinal, substr(sequence, 6, length(sequence) - 12) AS sequence FROM merged"))
def _(spark, d):
    out = _assembled(spark, d, AssemblerConfig(forward_trim=5, reverse_trim=7, threshold=1e-9))
    return out.where("status = 'OK'").select("ordinal", "sequence")


def _windows_sql(seq: str, qual: str, primer: str, penalty: float, tag: str = "", scores=_USED_F) -> str:
    """CTE win(ordinal, s, v): the value of a primer at each start from 0, the last place left out; lengths are 64."""
    p = len(primer)
    return f"""qw{tag} AS ({_scores(scores)}),
spots{tag} AS (SELECT ordinal, s, x, substr(sq, s + x, 1) AS b, ascii(substr(ql, s + x, 1)) - 33 AS q FROM (SELECT ordinal, {seq} AS sq, {qual} AS ql, unnest(range(0, {64 - p})) AS s FROM pairs), range(1, {p + 1}) t(x)),
win{tag} AS (SELECT ordinal, s, exp(sum(CASE WHEN b = 'N' OR b = substr('{primer}', x, 1) THEN v ELSE w END) / (s + {p + 1})) - (s + {p}) * {penalty!r} AS v FROM spots{tag} JOIN qw{tag} USING (q) GROUP BY ordinal, s)"""


def _place_sql(primer: str, tag: str, threshold: float) -> str:
    """CTE at(ordinal, cut): bases through the end of the best place of a primer, null where there is none."""
    p = len(primer)
    return f"""at{tag} AS (SELECT ordinal, CASE WHEN v > {threshold ** p!r} THEN s + {p} END AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY s) AS rn FROM (SELECT *, max(v) OVER (PARTITION BY ordinal) AS top FROM win{tag}) WHERE v > top - 1e-12) WHERE rn = 1)"""


_PRIMER = "ACGTNC"
_PRIMER_SQL = f"""{sim.pairs_sql()}, qs AS ({_scores(_USED_F)}),
places AS (SELECT ordinal, s, x, substr(f_seq, s + x, 1) AS b, ascii(substr(f_qual, s + x, 1)) - 33 AS q FROM (SELECT *, unnest(range(0, 58)) AS s FROM pairs), range(1, 7) t(x) WHERE x <> 5),
win AS (SELECT ordinal, s, exp(sum(CASE WHEN b = 'N' OR b = substr('{_PRIMER}', x, 1) THEN v ELSE w END) / (s + 7)) - (s + 6) * 0.001 AS v FROM places JOIN qs USING (q) GROUP BY ordinal, s),
top AS (SELECT ordinal, max(v) AS v FROM win GROUP BY ordinal)
SELECT w.ordinal, cast(min(CASE WHEN w.v > exp(6 * ln(0.6)) THEN w.s + 7 ELSE 0 END) as bigint) AS place FROM win w JOIN top USING (ordinal) WHERE abs(w.v - top.v) < 1e-12 GROUP BY w.ordinal"""


@query("primer_offset", _PRIMER_SQL)
def _(spark, d):
    out = clip.with_primer_offset(_pairs(spark, d), "place", "f_seq", "f_qual", _PRIMER, threshold=0.6, penalty=0.001)
    return out.select("ordinal", "place")


def _plus(*ctes: str) -> str:
    return ", ".join(x.strip().rstrip(",") for x in (sim.pairs_sql(), _best_sql(), _MERGE, *ctes))


_BEFORE_SQL = f"""{_plus(_windows_sql("f_seq", "f_qual", "ACGT", 0.0, "_f"), _place_sql("ACGT", "_f", 0.5), _windows_sql("r_seq", "r_qual", "ACG", 0.0, "_r", _USED_R), _place_sql("ACG", "_r", 0.5))},
cut AS (SELECT b.ordinal, at_f.cut AS fo, at_r.cut AS ro, coalesce(string_agg(fused.base, '' ORDER BY i) FILTER (i > at_f.cut AND i <= 128 - b.ov - at_r.cut), '') AS sequence,
  coalesce(sum(fused.p) FILTER (i > at_f.cut AND i <= 128 - b.ov - at_r.cut), 0) / (128 - b.ov - at_f.cut - at_r.cut + 1) AS quality
  FROM best b JOIN at_f ON at_f.ordinal = b.ordinal JOIN at_r ON at_r.ordinal = b.ordinal JOIN fused ON fused.ordinal = b.ordinal
  WHERE 2 + at_f.cut < 64 AND 2 + at_r.cut < 64 AND 128 - b.ov - at_f.cut - at_r.cut >= 0 GROUP BY b.ordinal, b.ov, at_f.cut, at_r.cut)
SELECT p.ordinal, CASE WHEN f.cut IS NULL THEN 'NOFP' WHEN r.cut IS NULL THEN 'NORP' WHEN c.ordinal IS NULL THEN 'NOALGN' WHEN c.quality < ln(0.5) THEN 'LOWQ' ELSE 'OK' END AS status,
  cast(c.fo as bigint) AS forward_offset, cast(c.ro as bigint) AS reverse_offset, c.sequence AS sequence
FROM pairs p LEFT JOIN at_f f ON f.ordinal = p.ordinal LEFT JOIN at_r r ON r.ordinal = p.ordinal LEFT JOIN cut c ON c.ordinal = p.ordinal"""

_AFTER_SQL = f"""{_plus()},
looks AS (SELECT fused.ordinal, i - j AS s, j, base, p FROM fused, range(1, 5) t(j) WHERE i - j >= 0 AND i - j < 128 - ov - 4),
win_m AS (SELECT ordinal, s, CASE WHEN bool_and(base = 'N' OR base = substr('ACGT', j, 1)) THEN exp(sum(p) / (s + 5)) END AS v FROM looks GROUP BY ordinal, s),
{_place_sql("ACGT", "_m", 0.3)}
SELECT p.ordinal, CASE WHEN m.ordinal IS NULL THEN 'NOALGN' WHEN coalesce(length(m.sequence) <= a.cut, true) THEN 'NOFP' WHEN m.quality < ln(0.3) THEN 'LOWQ' ELSE 'OK' END AS status,
  cast(CASE WHEN m.ordinal IS NOT NULL THEN coalesce(CASE WHEN a.cut < length(m.sequence) THEN a.cut END, 0) END as bigint) AS forward_offset, cast(CASE WHEN m.ordinal IS NOT NULL THEN 0 END as bigint) AS reverse_offset,
  substr(m.sequence, cast(1 + coalesce(CASE WHEN a.cut < length(m.sequence) THEN a.cut END, 0) as bigint)) AS sequence
FROM pairs p LEFT JOIN merged m ON m.ordinal = p.ordinal LEFT JOIN at_m a ON a.ordinal = p.ordinal"""


def _clipped(out: DataFrame) -> DataFrame:
    return out.select("ordinal", "status", F.col("forward_offset").cast("long").alias("forward_offset"), F.col("reverse_offset").cast("long").alias("reverse_offset"), "sequence")


@query("primers_before", _BEFORE_SQL)
def _(spark, d):
    return _assembled(spark, d, AssemblerConfig(forward_primer="ACGT", reverse_primer="ACG", threshold=0.5)).transform(_clipped)


@query("primers_after", _AFTER_SQL)
def _(spark, d):
    return _assembled(spark, d, AssemblerConfig(forward_primer="ACGT", primers_after=True, threshold=0.3)).transform(_clipped)


@query("overhang_trim", f"""{sim.pairs_sql()}, {_windows_sql("reverse(f_seq)", "reverse(f_qual)", "TGCA", 0.0)}, top AS (SELECT ordinal, max(v) AS v FROM win GROUP BY ordinal)
SELECT w.ordinal, cast(min(CASE WHEN w.v > exp(4 * ln(0.6)) THEN 64 - w.s - 4 ELSE 64 END) as bigint) AS bases FROM win w JOIN top USING (ordinal)
WHERE w.s = (SELECT min(s) FROM win z WHERE z.ordinal = w.ordinal AND z.v > top.v - 1e-12) GROUP BY w.ordinal""")
def _(spark, d):
    return clip.trim_overhangs(_pairs(spark, d), forward="ACGT", skip=True).select("ordinal", F.length("f_seq").cast("long").alias("bases"))


# --- filters -------------------------------------------------------------------------------------------------------


def _filter_query(name: str, spec: str, keep: str, before: bool = False, **more):
    stage = f"SELECT o.ordinal, CASE WHEN {keep} THEN 'OK' ELSE 'MODULE' END AS status FROM ok o JOIN pairs p ON o.ordinal = p.ordinal"
    if before:
        stage = f"SELECT p.ordinal, CASE WHEN NOT ({keep}) THEN 'MODULE' WHEN o.ordinal IS NOT NULL THEN 'OK' END AS status FROM pairs p LEFT JOIN ok o ON o.ordinal = p.ordinal"

    @query(f"filter_{name}", _full(f"SELECT * FROM ({stage}) WHERE status IS NOT NULL"))
    def _(spark, d):
        out = _assembled(spark, d, AssemblerConfig(modules=(filters.load(spec),)), with_logp=name == "min_phred", **more)
        return out.where("status in ('OK', 'MODULE')").select("ordinal", "status")


_filter_query("short", "short:96", "length(sequence) >= 96")
_filter_query("long", "long:100", "length(sequence) <= 100")
_filter_query("degenerate", "degenerate", "degenerates = 0")
_filter_query("empty", "empty", "length(sequence) > 0")
_filter_query("mismatches", "completely_miss_the_point:0", "x = 0")
_filter_query("min_phred", "min_phred:2", f"least >= {_g('ln(1 - power(10.0, -0.2))')}")
_filter_query("min_overlapbits", "min_overlapbits:-150", "score >= -150 * ln(2)")
_filter_query("overlap_stat", "overlap_stat", "true")
_filter_query("validtag", "validtag:AC:GT:TT", "substr(p.template, 1, 2) IN ('AC', 'GT', 'TT')", before=True)


def _marked(name: str, sign: str):
    """after and before the pair of the dearest order; its header is read from the pairs."""
    sql = _full(f"SELECT * FROM (SELECT p.ordinal, CASE WHEN NOT (p.ordinal {sign} (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders))) THEN 'MODULE' WHEN o.ordinal IS NOT NULL THEN 'OK' END AS status FROM pairs p LEFT JOIN ok o ON o.ordinal = p.ordinal) WHERE status IS NOT NULL")

    @query(f"filter_{name}", sql)
    def _(spark, d):
        pairs = _pairs(spark, d)
        dearest = spark.read.parquet(f"{d}/orders.parquet").agg(F.max(F.struct("o_totalprice", -F.col("o_orderkey"))).alias("m")).select(-F.col("m")["col2"]).first()[0]
        head = pairs.where(F.col("ordinal") == dearest).select("id").first()["id"]
        header = f"{head['instrument']}:{head['run']}:{head['flowcell']}:{head['lane']}:{head['tile']}:{head['x']}:{head['y']} 1:N:0:{head['tag']}"
        out = assemble(pairs, AssemblerConfig(modules=(filters.load(f"{name}:{header}"),)), with_logp=False)
        return out.where("status in ('OK', 'MODULE')").select("ordinal", "status")


_marked("after", ">=")
_marked("before", "<")


_IDSET_SQL = _full("SELECT * FROM (SELECT p.ordinal, CASE WHEN p.ordinal NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 25) THEN 'MODULE' WHEN o.ordinal IS NOT NULL THEN 'OK' END AS status FROM pairs p LEFT JOIN ok o ON o.ordinal = p.ordinal) WHERE status IS NOT NULL")


def _idset_query(name: str, thin: bool) -> None:
    @query(name, _IDSET_SQL)
    def _(spark, d):
        pairs = _pairs(spark, d)
        wanted = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 25").select(F.col("l_orderkey").alias("ordinal")).distinct()
        ids = pairs.join(wanted, "ordinal", "left_semi").select("id")
        out = assemble(pairs, AssemblerConfig(modules=(filters.id_set(ids, thin=thin),)), with_logp=False)
        return out.where("status in ('OK', 'MODULE')").select("ordinal", "status")


_idset_query("filter_idset", False)
_idset_query("filter_idset_bloom", True)


_OTHER_SQL = f"""{sim.pairs_sql()}, {_best_sql()}, {_MERGE}, {_windows_sql("f_seq", "f_qual", "ACGTAC", 0.01)}, hit AS (SELECT ordinal, max(v) > exp(6 * ln(0.9)) AS hit FROM win GROUP BY ordinal)
SELECT ordinal, status FROM (SELECT h.ordinal, CASE WHEN h.hit THEN 'MODULE' WHEN o.ordinal IS NOT NULL THEN 'OK' END AS status FROM hit h LEFT JOIN ok o ON o.ordinal = h.ordinal) WHERE status IS NOT NULL"""


@query("filter_other_primer", _OTHER_SQL.replace(f"{_MERGE}, ", _MERGE.rstrip() + ", "))
def _(spark, d):
    out = _assembled(spark, d, AssemblerConfig(modules=(filters.load("other_primer:f:ACGTAC"),)))
    return out.where("status in ('OK', 'MODULE')").select("ordinal", "status")


_PEAR_SQL = f"""{_plus()},
each AS (SELECT DISTINCT ov, x FROM merged),
steps AS (SELECT ov, x, i, ceil((ov - 2 * x + i) / 2.0) - 1 AS last FROM (SELECT ov, x, unnest(range(ov, 64)) AS i FROM each)),
sums AS (SELECT ov, x, i, coalesce(sum(exp(lgamma(i + 1) - lgamma(k + 1) - lgamma(i - k + 1) + k * ln(0.25) + (i - k) * ln(0.75))), 0) AS f FROM steps LEFT JOIN range(0, 65) t(k) ON k < last AND k <= i GROUP BY ov, x, i),
p AS (SELECT ov, x, CASE WHEN min(f) <= 0 THEN 0 ELSE exp(sum(ln(f))) END AS p FROM sums GROUP BY ov, x)
SELECT a.ordinal, CASE WHEN m.ordinal IS NULL THEN 'NOALGN' WHEN m.quality < ln(0.6) THEN 'LOWQ' WHEN 1 - power(coalesce(p.p, 1), 2) < 0.05 THEN 'OK' ELSE 'MODULE' END AS status
FROM pairs a LEFT JOIN merged m ON m.ordinal = a.ordinal LEFT JOIN p ON p.ov = m.ov AND p.x = m.x"""


@query("filter_pear_test", _PEAR_SQL)
def _(spark, d):
    return _assembled(spark, d, AssemblerConfig(modules=(filters.load("pear_test:cutoff=0.05"),)), keep_reads=True).select("ordinal", "status")


def _has_no_run(batch: pa.RecordBatch) -> np.ndarray:
    """Forward reads without four Gs in a row."""
    return ~np.array(pc.match_substring(batch.column("f_seq"), "GGGG").to_numpy(zero_copy_only=False))


def _is_long(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("sequence_length").to_numpy() >= batch.column("overlap").to_numpy() + 70


@query("filter_batch_modules", _full("""SELECT * FROM (SELECT p.ordinal, CASE WHEN f_seq LIKE '%AAAA%' THEN 'first' WHEN f_seq LIKE '%GGGG%' THEN 'run' WHEN f_seq LIKE '%TTTT%' THEN 'last'
  WHEN o.ordinal IS NULL THEN NULL WHEN o.x > 0 THEN 'completely_miss_the_point' WHEN length(o.sequence) < o.ov + 70 THEN 'long_enough' ELSE 'none' END AS module
  FROM pairs p LEFT JOIN ok o ON o.ordinal = p.ordinal) WHERE module IS NOT NULL"""))
def _(spark, d):
    """Batch functions between Column modules; the first that rejects is named."""
    has = lambda name, run: filters.precheck(name, ~F.contains("f_seq", F.lit(run)))
    modules = (has("first", "AAAA"), filters.batch_module("run", "precheck", ("f_seq",), _has_no_run), has("last", "TTTT"), filters.load("completely_miss_the_point:0"), filters.batch_module("long_enough", "check", ("sequence_length", "overlap"), _is_long))
    out = _assembled(spark, d, AssemblerConfig(modules=modules)).where("status in ('OK', 'MODULE')")
    return out.select("ordinal", F.coalesce("reject_module", F.lit("none")).alias("module"))


@query("overlap_offsets", _full("SELECT ordinal, 64 - ov AS merged, 64 - ov AS forward, 64 - ov AS reverse FROM ok"))
def _(spark, d):
    out = overlap_offsets(_assembled(spark, d, keep_reads=True).where("status = 'OK'"))
    return out.select("ordinal", *[F.col(c).cast("long").alias(n) for c, n in (("overlap_offset", "merged"), ("overlap_forward_offset", "forward"), ("overlap_reverse_offset", "reverse"))])


# --- statistics and comparison -------------------------------------------------------------------------------------

_STATUS_SQL = """, st AS (SELECT p.ordinal, CASE WHEN m.ordinal IS NULL THEN 'NOALGN' WHEN m.quality < ln(0.6) THEN 'LOWQ' WHEN length(sequence) < 100 THEN 'MODULE' ELSE 'OK' END AS status, e.n AS examined
  FROM pairs p LEFT JOIN merged m ON m.ordinal = p.ordinal JOIN (SELECT ordinal, count(*) AS n FROM cand GROUP BY ordinal) e ON e.ordinal = p.ordinal)"""


def _stat_sql() -> str:
    codes = " UNION ALL ".join(f"SELECT '{s}' AS code, cast(count(*) as bigint) AS value FROM st WHERE status = '{s}'" for s in ("OK", "BADR", "NOFP", "NORP", "NOALGN", "LOWQ", "MODULE"))
    return f"{sim.pairs_sql()}, {_best_sql()}, {_MERGE}{_STATUS_SQL} SELECT 'READS' AS code, cast(count(*) as bigint) AS value FROM st UNION ALL SELECT 'SLOW' AS code, cast(count(*) as bigint) AS value FROM st WHERE examined = 63 UNION ALL {codes}"


def _counted(spark, d) -> DataFrame:
    return _assembled(spark, d, AssemblerConfig(modules=(filters.load("short:100"),)))


@query("stat_counts", _stat_sql())
def _(spark, d):
    return stats.stat_counts(_counted(spark, d))


@query("reject_counts", f"{sim.pairs_sql()}, {_best_sql()}, {_MERGE}{_STATUS_SQL} SELECT 'SHORT' AS module, cast(count(*) as bigint) AS rejected FROM st WHERE status = 'MODULE' HAVING count(*) > 0")
def _(spark, d):
    return stats.reject_counts(_counted(spark, d))


@query("overlap_histogram", _full("SELECT cast(v as bigint) AS overlap, cast(coalesce(n, 0) as bigint) AS n FROM range(0, 65) t(v) LEFT JOIN (SELECT ov, count(*) AS n FROM ok GROUP BY ov) ON ov = v WHERE v <= (SELECT max(ov) FROM ok)"))
def _(spark, d):
    return stats.overlap_histogram(_assembled(spark, d)).select(F.col("overlap").cast("long").alias("overlap"), "n")


@query("written_statistics", f"""{_stat_sql()} UNION ALL SELECT 'OVERLAP ' || ov, cast(count(*) as bigint) FROM st JOIN merged USING (ordinal) WHERE status = 'OK' GROUP BY ov
  UNION ALL SELECT 'EXAMINED ' || examined, cast(count(*) as bigint) FROM st WHERE status IN ('OK', 'MODULE') GROUP BY examined UNION ALL SELECT 'SHORT', cast(count(*) as bigint) FROM st WHERE status = 'MODULE'""")
def _(spark, d):
    """Counts that come with the write itself: one job writes and counts."""
    counts = sinks.write_assembly(_counted(spark, d), "", layout="null")
    status = counts["status"]
    rows = [("READS", sum(status.values())), ("SLOW", counts["slow"][True]), *((k, status[k]) for k in ("OK", "BADR", "NOFP", "NORP", "NOALGN", "LOWQ", "MODULE"))]
    rows += [(f"{name.upper()} {v}", n) for name in ("overlap", "examined") for v, n in counts[name].items() if v is not None]
    return spark.createDataFrame([*rows, ("SHORT", counts["reject_module"]["SHORT"])], "code string, value long")


@query("examined_histogram", _full("SELECT cast(v as bigint) AS examined, cast(coalesce(n, 0) as bigint) AS n FROM range(1, 64) t(v) LEFT JOIN (SELECT examined, count(*) AS n FROM ok GROUP BY examined) e ON e.examined = v WHERE v <= (SELECT max(examined) FROM ok)"))
def _(spark, d):
    return stats.examined_histogram(_assembled(spark, d)).select(F.col("examined").cast("long").alias("examined"), "n")


@query("phred_offset_warning", _pairs_only("SELECT cast(min(least(CASE WHEN f_qual LIKE '%#%' THEN 35 WHEN f_qual LIKE '%5%' THEN 53 ELSE 73 END, CASE WHEN r_qual LIKE '%#%' THEN 35 WHEN r_qual LIKE '%+%' THEN 43 ELSE 73 END)) as bigint) AS least, false AS suspicious FROM pairs"))
def _(spark, d):
    return stats.phred_offset_warning(_pairs(spark, d)).select(F.col("least").cast("long").alias("least"), "suspicious")



def _tagged(sql: str, tag: str) -> str:
    """The same steps under other names."""
    return re.sub(r"\b(fk2|fk|rk|hits|cand|counted|mxu|scored|best|fr|mt|qs|bases|fused|merged|ok)\b(?!\()", rf"\1{tag}", sql.replace("mt.", "mt_.").replace("qs.", "qs_.")).replace("mt_.", f"mt{tag}.").replace("qs_.", f"qs{tag}.")


_LONGER = _KMERS.replace("BETWEEN 2 AND 64", "BETWEEN 30 AND 64").replace("range(2, 65) r(ov)", "range(30, 65) r(ov)")
_DIFF_SQL = f"""{_plus()}, {_tagged(_best_sql(cand=_LONGER) + "," + _MERGE, "_e").strip()}
SELECT p.ordinal, CASE WHEN a.ordinal IS NULL AND b.ordinal IS NULL THEN 'both_fail' WHEN a.ordinal IS NULL THEN 'gained' WHEN b.ordinal IS NULL THEN 'lost' WHEN length(a.sequence) <> length(b.sequence) THEN 'length'
  WHEN a.sequence <> b.sequence THEN 'nt' WHEN b.quality > a.quality + 1e-9 THEN 'better' WHEN b.quality < a.quality - 1e-9 THEN 'worse' ELSE 'same' END AS kind,
  CASE WHEN length(a.sequence) = length(b.sequence) AND a.sequence <> b.sequence THEN cast(hamming(a.sequence, b.sequence) as bigint) END AS changed_bases
FROM pairs p LEFT JOIN ok a ON a.ordinal = p.ordinal LEFT JOIN ok_e b ON b.ordinal = p.ordinal"""


@query("diff_min_overlap", _DIFF_SQL)
def _(spark, d):
    pairs = _pairs(spark, d)
    return diff.diff(pairs, AssemblerConfig(), AssemblerConfig(min_overlap=30))


@query("diff_trim_summary", _full("SELECT cast((SELECT count(*) FROM pairs) as bigint) AS total, cast(0 as bigint) AS better, cast(0 as bigint) AS worse, cast((SELECT count(*) FROM merged) as bigint) AS changed, cast(0 as bigint) AS gained, cast(0 as bigint) AS lost, cast((SELECT count(*) FROM pairs) - (SELECT count(*) FROM merged) as bigint) AS equal"))
def _(spark, d):
    pairs = _pairs(spark, d)
    one = AssemblerConfig(threshold=1e-9)
    return diff.diff_summary(diff.diff(pairs, one, replace(one, forward_trim=3)))


@query("diff_module_summary", _full("SELECT cast((SELECT count(*) FROM pairs) as bigint) AS total, cast(0 as bigint) AS better, cast(0 as bigint) AS worse, cast(0 as bigint) AS changed, cast(0 as bigint) AS gained, cast(count(*) FILTER (WHERE length(sequence) > 100) as bigint) AS lost, cast((SELECT count(*) FROM pairs) - count(*) FILTER (WHERE length(sequence) > 100) as bigint) AS equal FROM ok"))
def _(spark, d):
    return diff.diff_summary(diff.diff(_pairs(spark, d), AssemblerConfig(), AssemblerConfig(modules=(filters.load("long:100"),))))


# --- scalar functions ----------------------------------------------------------------------------------------------

_ALPHABET = "ACGTUMRWSYKVHDBNXacgtun.-4EZ"
_MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "X": 15, ".": 15, "-": 3, "4": 8}


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))


@query("nt_encode", f"SELECT o_orderkey AS k, cast(CASE {' '.join(f"WHEN c = '{c}' THEN {v}" for c, v in _MASKS.items())} ELSE 0 END as bigint) AS mask FROM (SELECT o_orderkey, upper(substr('{_ALPHABET}', cast(1 + o_orderkey % {len(_ALPHABET)} as bigint), 1)) AS c FROM orders)")
def _(spark, d):
    c = F.substr(F.lit(_ALPHABET), (F.col("k") % len(_ALPHABET) + 1).cast("int"), F.lit(1))
    return _orders(spark, d).select("k", nt.from_ascii(c).cast("long").alias("mask"))


@query("nt_complement", "SELECT o_orderkey AS k, cast(((m & 1) << 3) | ((m & 8) >> 3) | ((m & 2) << 1) | ((m & 4) >> 1) as bigint) AS paper, cast(CASE WHEN m IN (7, 11) THEN 7 ELSE ((m & 1) << 3) | ((m & 8) >> 3) | ((m & 2) << 1) | ((m & 4) >> 1) END as bigint) AS reference, bit_count(m) <> 1 AS degenerate, substr('NACMGRSVTWYHKDBN', m + 1, 1) AS letter FROM (SELECT o_orderkey, cast(o_orderkey % 16 as int) AS m FROM orders)")
def _(spark, d):
    m = (F.col("k") % 16).cast("int")
    return _orders(spark, d).select("k", nt.complement(m, "paper").cast("long").alias("paper"), nt.complement(m).cast("long").alias("reference"), nt.is_degenerate(m).alias("degenerate"), nt.to_ascii(m).alias("letter"))


@query("reverse_complement", _pairs_only("SELECT ordinal, rc_seq AS seq FROM pairs"))
def _(spark, d):
    return _pairs(spark, d).select("ordinal", nt.reverse_complement(F.col("r_seq")).alias("seq"))


@query("phred_decode", f"SELECT o_orderkey AS k, cast(CASE WHEN v > 46 THEN 13 ELSE v END as bigint) AS q FROM (SELECT o_orderkey, o_orderkey % 94 AS v FROM orders)")
def _(spark, d):
    return _orders(spark, d).select("k", phred.index_of(F.chr(F.col("k") % 94 + 33)).cast("long").alias("q"))


@query("phred_logprob", "SELECT o_orderkey AS k, cast(floor((CASE WHEN q = 0 THEN -2.0 ELSE ln(1 - power(10.0, -q / 10.0)) END) * 1000 + 0.5) as bigint) AS p FROM (SELECT o_orderkey, cast(least(o_orderkey % 60, 46) as double) AS q FROM orders)")
def _(spark, d):
    return _orders(spark, d).select("k", F.floor(phred.log_probability(F.col("k") % 60) * 1000 + 0.5).cast("long").alias("p"))


_STEPS_SQL = " ".join(f"WHEN p < {_g(f'ln(1 - power(10.0, -{i} / 10.0))')} THEN {i - 1 if (i - 1) % 3 == 0 else i} WHEN p = {_g(f'ln(1 - power(10.0, -{i} / 10.0))')} THEN {i}" for i in range(1, 46))


@query("phred_requantise", f"SELECT o_orderkey AS k, cast(CASE WHEN p <= -2 THEN 1 {_STEPS_SQL} ELSE 45 END as bigint) AS q FROM (SELECT o_orderkey, -cast(o_orderkey % 2500 as double) / 1000.0 AS p FROM orders)")
def _(spark, d):
    return _orders(spark, d).select("k", phred.requantise(-(F.col("k") % 2500).cast("double") / 1000.0).cast("long").alias("q"))


@query("kmers8", f"{sim.pairs_sql()}, {_KMERS} SELECT p.ordinal, cast(count(fk.p) as bigint) AS n, min(fk.km) AS least, cast(coalesce(sum(fk.p), 0) as bigint) AS places FROM pairs p LEFT JOIN fk ON fk.ordinal = p.ordinal GROUP BY p.ordinal")
def _(spark, d):
    k = _pairs(spark, d).select("ordinal", kmers.kmers(F.col("f_seq")).alias("k"))
    return k.select("ordinal", F.size("k").cast("long").alias("n"), F.array_min(F.transform("k", lambda x: x["kmer"])).alias("least"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x["posn"]).alias("places"))


def _kmer_query(name: str, k: int, reverse: bool, seq: str = "f_seq", source: str = "pairs") -> None:
    place = f"substr({seq}, p + 1, {k + 1})" if reverse else f"substr({seq}, p - {k - 1}, {k + 1})"
    bases = f"reverse(substr({seq}, p + 1, {k}))" if reverse else f"substr({seq}, p - {k - 2}, {k})"
    code = f"list_reduce(list_transform(string_split(translate({bases}, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, b: a * 4 + b)"
    span = f"range(0, length({seq}) - {k})" if reverse else f"range({k}, length({seq}))"
    rows = f"SELECT ordinal, p, {code} AS kmer FROM (SELECT ordinal, {seq}, unnest({span}) AS p FROM {source}) WHERE instr({place}, 'N') = 0"
    sql = f"SELECT ordinal, cast(count(*) as bigint) AS n, cast(sum(p) as bigint) AS places, cast(min(kmer) as bigint) AS least, cast(max(kmer) as bigint) AS most, cast(sum(kmer % 1000003) as bigint) AS total FROM ({rows}) GROUP BY ordinal"

    @query(name, _full(sql) if source == "ok" else _pairs_only(sql))
    def _(spark, d):
        df = _assembled(spark, d, with_logp=False).where("status = 'OK'") if source == "ok" else _pairs(spark, d)
        found = kmers.kmer_table(df, seq, k, reverse=reverse).groupBy("ordinal")
        return found.agg(F.count("*").alias("n"), F.sum("posn").alias("places"), F.min("kmer").alias("least"), F.max("kmer").alias("most"), F.sum(F.col("kmer") % 1000003).alias("total"))


_kmer_query("kmers3", 3, False)
_kmer_query("kmers8_reverse", 8, True)
_kmer_query("kmers31", 31, False)
_kmer_query("kmers31_of_merged", 31, True, "sequence", "ok")


@query("bcliff_mask", _pairs_only("SELECT ordinal, cast(length(rtrim(f_qual, '#')) as bigint) AS f_clear, cast(length(rtrim(r_qual, '#')) as bigint) AS r_clear FROM pairs"))
def _(spark, d):
    return _pairs(spark, d).select("ordinal", *[F.length(F.rtrim(F.col(f"{s}_qual"), F.lit("#"))).cast("long").alias(f"{s}_clear") for s in "fr"])


_HEADERS = {
    "17": ("concat('M', cast(user_id as varchar(20)), ':', cast(event_id % 9 as varchar(20)), ':FC1:', cast(event_id % 8 as varchar(20)), ':1101:', cast(event_id as varchar(20)), ':', cast(user_id as varchar(20)), ' ', cast(1 + event_id % 2 as varchar(20)), ':N:0:', upper(event_type))",
           "concat('M', cast(user_id as varchar(20)), ':', cast(event_id % 9 as varchar(20)), ':FC1:', cast(event_id % 8 as varchar(20)), ':1101:', cast(event_id as varchar(20)), ':', cast(user_id as varchar(20)), ':', upper(event_type))", "1 + event_id % 2"),
    "14": ("concat('H', cast(user_id as varchar(20)), ':', cast(event_id % 8 as varchar(20)), ':12:', cast(event_id as varchar(20)), ':7#', upper(event_type), '/2')",
           "concat('H', cast(user_id as varchar(20)), ':::', cast(event_id % 8 as varchar(20)), ':12:', cast(event_id as varchar(20)), ':7:', upper(event_type))", "2"),
    "converted": ("concat('S', cast(user_id as varchar(20)), ':18:FC2:', cast(event_id % 8 as varchar(20)), ':12:', cast(event_id as varchar(20)), ':7#', upper(event_type), '/1')",
                  "concat('S', cast(user_id as varchar(20)), ':18:FC2:', cast(event_id % 8 as varchar(20)), ':12:', cast(event_id as varchar(20)), ':7:', upper(event_type))", "1"),
    "sra": ("concat(CASE WHEN event_id % 2 = 0 THEN 'SRR' ELSE 'ERR' END, '00', cast(1 + user_id as varchar(20)), '.', cast(event_id as varchar(20)), ' x')",
            "concat(CASE WHEN event_id % 2 = 0 THEN 'SRR' ELSE 'ERR' END, cast(1 + user_id as varchar(20)), ':::', cast(event_id as varchar(20)), ':0:0:0:')", "1"),
}


def _header_query(name: str, header: str, text: str, mate: str):
    @query(f"seqid_parse_{name}", f"SELECT event_id, {text} AS id, cast({mate} as bigint) AS mate FROM events")
    def _(spark, d):
        rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(header).alias("h")).select("event_id", seqid.parse(F.col("h")).alias("r"))
        return rows.select("event_id", seqid.to_string(F.col("r.id")).alias("id"), F.col("r.mate").cast("long").alias("mate"))


for _name, _parts in _HEADERS.items():
    _header_query(_name, *_parts)
