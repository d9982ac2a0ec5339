"""URL filters with DataFrame functions only.

Each URL is expanded into host suffixes times path prefixes (only label counts and path lengths that rules have), the
expressions meet the rules on the first 8 hex digits of their SHA-256, full digests confirm, and the longest rule wins.
Rules are broadcast up to ``broadcast_rules`` of them; beyond that the same join is shuffled.

Defined cases: a null URL, or one without ``://``, has empty host and path; of equally long rules the one with the longer
host wins, then ``block``; equal rows each keep their row; a page without a fitting rule gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a local relation (host, path, verdict)."""
    one = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*one)))


def filter_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """key, host, path, rule (host and path of the winning rule, or null) and verdict for each row."""
    expr = F.concat("host", "path")
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        expr.alias("rule"), "verdict", F.sha2(expr, 256).alias("digest"), F.substring(F.sha2(expr, 256), 1, 8).alias("prefix"),
        (F.length(expr)).alias("n"), F.length("host").alias("n_host"),
    )
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")
    ).first()  # distinct small numbers
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", "url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")) for n in sorted(shape["labels"])]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]
    exprs = F.array_compact(F.array(*(F.concat(s, p) for s in suffixes for p in prefixes)))
    spread = base.select("key", "url", "host", "path", F.posexplode_outer(exprs).alias("pos", "expr"))
    spread = spread.withColumn("full", F.sha2("expr", 256)).withColumn("prefix", F.substring("full", 1, 8))
    side = F.broadcast(known) if shape["n"] <= broadcast_rules else known
    met = spread.join(side, (spread["prefix"] == side["prefix"]) & (spread["full"] == side["digest"]), "left")
    fits = F.when(F.col("rule").isNotNull(), F.struct("n", "n_host", "verdict", "rule"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # one expression of each row counts the row; rules are distinct
    best = met.groupBy("key", "url", "host", "path").agg(F.max(fits).alias("best"), F.sum(first.cast("int")).alias("copies"))
    rows = best.select("key", "host", "path", "best", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


ORACLE = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM parts),
fits AS (SELECT s.rid, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY s.rid ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS k
         FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.rid = s.rid AND f.k = 1
"""
