"""SQL of the corpus operators: against brute force on odd rows, and against their queries on the small tables."""

import duckdb
import pytest

from readmerge.llm import decontaminate, jaccard, queries, suffix, warc

ODD = [
    (1, None), (2, ""), (3, "a b c d e f g h i j k l m n"), (3, "a b c d e f g h i j k l m n"), (4, "x A b C d E f g H i j k l m n y"), (None, "a b c d e f g h i j k l m n"),
    (5, "one two"), (6, "ONE, two!"), (7, "é" * 60 + " zz"), (8, "qq " + "é" * 60), (9, "p" * 49), (10, "p" * 51 + "q" + "p" * 60), (11, "a b c d e f g h i j k l m o"),
]
ITEMS = [(1, "b c d e f g h i j k l"), (20, "b c d e f g h i j k l"), (3, "One Two"), (4, None), (5, ""), (None, "a b c")]


def sql(text, **tables):
    con = duckdb.connect()
    for name, (kinds, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({kinds})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return sorted(con.execute(text).fetchall(), key=str)


@pytest.mark.parametrize("rows", [ODD, []])
def test_sql_equals_brute_force(rows):
    docs = ("doc_id BIGINT, text VARCHAR", rows)
    want = decontaminate.brute_force(rows, [r for r in ITEMS if r[0] is not None and r[1]])
    assert sql(decontaminate.ORACLE, documents=docs, benchmark=("item_id BIGINT, text VARCHAR", ITEMS)) == sorted(want, key=str)
    assert sql(suffix.ORACLE, documents=docs) == sorted(suffix.brute_force(rows), key=str)
    assert sql(jaccard.ORACLE, documents=docs) == sorted(jaccard.brute_force(rows), key=str)


def test_sql_of_archives():
    rows = [(1, None), (2, ""), (3, "abc"), (4, "abc"), (5, "é" * 9), (6, "abc")]
    pages = con_pages(rows)
    assert sorted(pages.execute(warc.ORACLE).fetchall(), key=str) == sorted(warc.brute_force(rows), key=str)


def con_pages(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    return con


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_suffix", "op6_jaccard", "op10_warc"])
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_items_of_a_common_line_meet_a_text_once(spark):
    line = " ".join(f"w{i}" for i in range(40))
    items = [(i, line) for i in range(300)] + [(1000, line + " more words at the end of this one item")]
    docs = [(1, f"start {line} end"), (2, f"{line} more words at"), (3, "nothing here")]
    bench = decontaminate.Benchmark(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10, 5)
    named = bench.members.groupBy("set").count().collect()
    assert sorted(r["count"] for r in named) == [1, 301]  # two sets of items, whatever the number of windows
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, decontaminate.digest_columns(found).collect())) == decontaminate.brute_force(docs, items)


def test_bitmap_grows_with_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST", 1 << 16)
    few = decontaminate.Benchmark(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), "item_id", "text", 10, 5)
    words = [(i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(600)]
    more = decontaminate.Benchmark(spark.createDataFrame(words, "item_id long, text string"), "item_id", "text", 10, 5)
    assert few.bits == 1 << 16 and more.bits >= decontaminate.BITS * more.table.select("h").distinct().count() > few.bits
