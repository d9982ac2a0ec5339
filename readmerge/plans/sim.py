"""Read pairs derived from table keys in SQL that Spark and DuckDB evaluate alike.

A key gives a 128-base template by MD5; the forward read is its first 64 bases, the reverse read the reverse complement
of 64 bases that overlap the forward read by 20 to 44.  Errors, Ns, low tails and mixed scores follow from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LENGTH = 64
#: Bytes of a table, as stored, whose keys make one partition of pairs.
KEY_BYTES = 1 << 20

_TEMPLATE = " || ".join(f"translate(md5(concat('t{i}-', cast(k as varchar(20)))), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(4))

#: Steps over ``keys(k)``: run in both engines.
STEPS = f"""
t0 AS (SELECT k, 20 + k % 25 AS true_overlap, {_TEMPLATE} AS template FROM keys),
t1 AS (SELECT k, true_overlap, template, substr(template, 1, 64) AS f0, substr(template, cast(65 - true_overlap as int), 64) AS c0 FROM t0),
t2 AS (SELECT k, true_overlap, template,
  CASE WHEN k % 7 = 0 THEN concat(substr(f0, 1, cast(40 + k % 20 as int)), 'N', substr(f0, cast(42 + k % 20 as int), 64)) ELSE f0 END AS f_seq,
  CASE WHEN k % 3 = 0 THEN concat(substr(c0, 1, cast(k % 18 as int)), translate(substr(c0, cast(1 + k % 18 as int), 1), 'ACGT', 'CGTA'), substr(c0, cast(2 + k % 18 as int), 64)) ELSE c0 END AS rc_seq,
  CASE WHEN k % 5 = 0 THEN concat(repeat('I', 54), repeat('#', 10)) WHEN k % 5 = 1 THEN concat(repeat('?', 32), repeat('5', 32)) ELSE repeat('I', 64) END AS f_qual,
  CASE WHEN k % 4 = 0 THEN concat(repeat('D', 40), repeat('+', 24)) WHEN k % 4 = 1 THEN concat(repeat('I', 58), repeat('#', 6)) ELSE repeat('I', 64) END AS r_qual
  FROM t1),
pairs AS (SELECT k AS ordinal, true_overlap, template, f_seq, f_qual, rc_seq, reverse(translate(rc_seq, 'ACGTN', 'TGCAN')) AS r_seq, r_qual FROM t2)
"""

KEYS = "SELECT o_orderkey AS k FROM orders"


def pairs_sql(keys: str = KEYS) -> str:
    """The WITH clause that defines ``pairs``."""
    return f"WITH keys AS ({keys}), {STEPS}"


def read_pairs(spark: SparkSession, sf_dir: str, keys: str = KEYS, table: str = "orders") -> DataFrame:
    """Pairs with identifiers, in order of their ordinals.  Deriving a read costs far more than reading a key, so keys are dealt out by the table's size."""
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    source.createOrReplaceTempView(f"readmerge_{table}")
    dealt = spark.sql(keys.replace(f"FROM {table}", f"FROM readmerge_{table}")).repartitionByRange(max(1, -(-size // KEY_BYTES)), "k").sortWithinPartitions("k")
    dealt.createOrReplaceTempView(f"readmerge_keys_{table}")
    ident = "named_struct('instrument', 'SIM', 'run', cast(ordinal % 7 as string), 'flowcell', 'FC', 'lane', cast(ordinal % 8 as int), 'tile', cast(ordinal % 100 as int), 'x', cast(ordinal as int), 'y', cast(ordinal % 1000 as int), 'tag', substr(template, 1, 6))"
    return spark.sql(f"{pairs_sql(f'SELECT k FROM readmerge_keys_{table}')} SELECT ordinal, {ident} AS id, f_seq, f_qual, r_seq, r_qual, rc_seq, true_overlap FROM pairs")
