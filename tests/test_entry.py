import duckdb
import pytest

import __spark_entry__ as entry
from readmerge import catalog


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["assemble_simple_bayesian", "merged_quality", "filter_after", "stat_counts", "primer_offset", "overlap_score_pear", "best_overlap_stitch", "kmers8", "seqid_parse_14"])
def test_equal_to_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, data).select(*cols).collect()), key=str) == want


@pytest.mark.parametrize("name", ["overlap_score_pear", "overlap_score_rdp_mle"])
def test_sums_of_places_do_not_depend_on_the_order_of_rows(spark, tmp_path, name):
    """Values have six digits, so sums can lie halfway between two results: the SQL adds in the model's order, whatever order a join leaves."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT unnest([37360, 630160])::BIGINT AS o_orderkey")  # both lie halfway in pear
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    want = sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select("ordinal", "score").collect())) == want
