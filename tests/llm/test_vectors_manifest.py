"""Vector operators and the manifest against brute force and SQL."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readmerge.llm import merkle, numbering, vectors, whiten


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(8)
        for _ in range(40):
            v = (centre + rng.normal(0, 0.12, 8)) * rng.choice([1, 1e-3, 2.0])
            rows.append((len(rows) + 3, v.astype(np.float32).tolist(), c % 2))
    rows += [rows[5], (1, rows[7][1], rows[7][2]), (1, rows[90][1], rows[90][2]), (None, rows[11][1], rows[11][2]), (2, rows[13][1], 1 - rows[13][2])]
    odd = [None, [], [0.0] * 8, [1.0, None] * 4, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [3e38] * 8, [1e-40] * 8, [1.0] * 3, [2.0] * 3, [0.0, 1.0], [-0.0, 1.0], [-0.0, 2.0]]
    rows += [(500 + i, v, 1) for i, v in enumerate(odd)] + [(600, [1.0] * 8, None), (601, None, None), (None, [5.0, 1.0], 1), (None, [5.0, 1.01], 1)]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("key", "x", "node", "digest")})


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.mark.parametrize(("seed", "block"), [(0, 256), (1, 5), (2, 16)])
def test_near_vectors(spark, seed, block):
    rows = vector_rows(seed)
    assert order(vectors.near_vectors(vector_table(spark, rows), block=block).collect()) == order(vectors.brute_force(rows))


def test_near_vectors_of_no_rows(spark):
    assert vectors.near_vectors(vector_table(spark, [])).count() == 0
    assert order(vectors.near_vectors(vector_table(spark, [(4, None, 1)])).collect()) == [(4, 0, 4, True)]


def test_near_vectors_at_the_threshold(spark):
    """Pairs just above and below a cosine of 0.98: nothing below is linked, and of those above nearly all are found."""
    rng = np.random.default_rng(5)
    a = vectors.unit(rng.standard_normal((600, 64)))
    side = rng.standard_normal((600, 64))
    side = vectors.unit(side - np.einsum("ij,ij->i", side, a)[:, None] * a)
    cos = np.where(np.arange(600) % 2, 0.9801, 0.9799)
    b = a * cos[:, None] + side * np.sqrt(1 - cos**2)[:, None]
    rows = [(2 * i + j, v.tolist(), 0) for i in range(600) for j, v in enumerate((a[i], b[i]))]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert not any(got[2 * i] for i in range(0, 600, 2))
    assert sum(got[2 * i] for i in range(1, 600, 2)) >= 297


def test_near_vectors_data(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = order(vectors.op11_vectors(spark, data).collect())
    assert got == order(vectors.brute_force(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    assert order(con.execute(vectors.ORACLE).fetchall()) == got


def test_sql_of_near_vectors(spark):
    rows = vector_rows(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r for r in rows if r[1] != [3e38] * 8 and r[1] != [1e-40] * 8])
    want = vectors.brute_force([r for r in rows if r[1] != [3e38] * 8 and r[1] != [1e-40] * 8])
    assert order(con.execute(vectors.ORACLE).fetchall()) == order(want)


def check_whitened(got, rows, components=16):
    head, y = whiten.brute_force(rows, components)
    found: dict = {}
    for r in got:
        found.setdefault(r.component, []).append(r)
    key = lambda k: (k is None, k or 0)
    at = sorted(range(len(head)), key=lambda i: (key(head[i][0]), head[i][2]))
    assert sorted(found) == list(range(1, y.shape[1] + 1))
    for c, rs in found.items():
        rs.sort(key=lambda r: (key(r.vec_id), r.deviation))
        assert [(r.vec_id, r.n, int(r.deviation)) for r in rs] == [head[i] for i in at]
        w = np.array([r.whitened for r in rs])
        assert min(np.abs(w - s * y[at, c - 1]).max() for s in (1, -1)) < 1e-8
        assert all(r.identity_error < 1e-8 for r in rs)


def test_whitening_data(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitened(whiten.op12_whiten(spark, data).collect(), rows)


def test_whitening_of_odd_rows_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for i in range(230)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (900, None), (901, []), (902, [math.nan] * 6), (903, [None] * 6), (904, [math.inf] + [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("key", "x", "index", "digest", "at")})
    got = whiten.whiten(table, rows_per_block=10).collect()
    check_whitened(got, rows)
    want = np.linalg.eigvalsh(np.cov(np.unique(np.floor(64 * np.array([r[1] for r in rows[:230]])), axis=0).T, bias=True))[::-1]
    assert np.allclose(sorted({r.explained for r in got})[::-1], want / want.sum(), rtol=1e-9)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 2, schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and max(r.identity_error for r in flat) < 1e-9
    with pytest.raises(ValueError, match="entries"):
        whiten.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def tampered(k):
    return zlib.crc32(str(k).encode()) % 7 == 0


def proved(spark, rows):
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("key", "group", "pos", "tree", "n", "digest", "now")})
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table, key="doc_id", group="lang", columns=merkle.COLUMNS, now={"n_chars": found})


ODD_DOCS = [(i, "web", lang, i * 3, f"text {i}") for lang, n in (("en", 70), ("de", 1), ("fr", 16), ("é", 9), ("", 2)) for i in range(n)]
ODD_DOCS += [(None, None, None, None, None), (4, "a", None, 1, ""), (4, "a", None, 1, ""), (4, "a", None, None, "x" * 100_000), (-5, "ü", None, -1, "é"), (None, "s", "en", 2, "t"), (3, "other", "en", 9, "same id")]


def test_manifest_of_odd_rows(spark):
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(map(tuple, proved(spark, ODD_DOCS).collect()), key=key) == sorted(merkle.brute_force(ODD_DOCS, tampered), key=key)


@pytest.mark.parametrize("height", [1, 2, 3, 5])
def test_blocks_as_appends(height):
    """Blocks of any height, raised and appended to the tree above, have the root of the whole tree and its witnesses."""
    nodes = [merkle.join(b"%d" % i) for i in range(70)]
    for n in range(1, len(nodes) + 1):
        whole = merkle.Appender(n)
        for d in nodes[:n]:
            whole.append(d)
        root = whole.close()
        level, at, paths = nodes[:n], list(range(n)), [b""] * n
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 1 << height):
                tree = merkle.Appender(1 << height, height)
                for d in level[i : i + (1 << height)]:
                    tree.append(d)
                up.append(tree.close(height if len(level) > 1 << height else None))
                for k, p in enumerate(at):
                    if i <= p < i + (1 << height):
                        paths[k] += b"".join(tree.witness[p - i].tolist())
            level, at = up, [p >> height for p in at]
        assert level[0] == root
        for k in range(n):
            assert b"".join(whole.witness[k].tolist()) == paths[k]
            assert merkle.fold(nodes[k], [paths[k][i - 64 : i] for i in range(len(paths[k]), 0, -64)], k, n) == root


def test_manifest_of_several_blocks(spark):
    rows = [(i, "web", "en" if i % 9 else "de", i, f"t{i}") for i in range(9300)]
    assert sorted(map(tuple, proved(spark, rows).collect())) == sorted(merkle.brute_force(rows, tampered))


def test_manifest_data(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select(*merkle.COLUMNS).collect()]
    got = sorted(map(tuple, merkle.op13_merkle(spark, data).collect()))
    assert got == sorted(merkle.brute_force(rows, tampered))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(con.execute(merkle.ORACLE).fetchall()) == got


def test_manifest_of_no_rows(spark):
    assert proved(spark, []).count() == 0


def test_numbers_in_order(spark):
    rows = [(g, i % 7) for g in (None, "a", "b") for i in range(50)]
    got = numbering.in_order(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], ["v"], "at").collect()
    for g in (None, "a", "b"):
        part = sorted((r.at, r.v) for r in got if r.g == g)
        assert [a for a, _ in part] == list(range(50)) and [v for _, v in part] == sorted(v for _, v in part)
