"""Files written in order by many tasks."""

import bz2
import gzip
import os

import pytest
from pyspark.sql import functions as F

from readmerge.plans import sim
from readmerge.sources import ordered, sinks
from readmerge.sources.fastq import read_fastq_pairs
from readmerge.sources.ordered import write_in_order

N = 5000


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts for a small table
    yield spark.range(0, N, 1, 7).select(F.col("id").alias("ordinal"), F.format_string("row %d é", "id").alias("value"), F.format_string("other %d", "id").alias("more")).repartition(9, F.hash("ordinal"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lines(column="value"):
    return "".join(f"row {i} é\n" if column == "value" else f"other {i}\n" for i in range(N))


@pytest.mark.parametrize(("compression", "read"), [("none", bytes), ("gzip", gzip.decompress), ("bzip2", bz2.decompress)])
def test_one_file_in_order(rows, tmp_path, compression, read):
    write_in_order(rows.select("ordinal", "value"), f"{tmp_path}/out/all.txt", layout="single", compression=compression)
    assert read((tmp_path / "out/all.txt").read_bytes()).decode() == lines()
    assert os.listdir(f"{tmp_path}/out") == ["all.txt"]
    with pytest.raises(FileExistsError):
        write_in_order(rows.select("ordinal", "value"), f"file://{tmp_path}/out/all.txt", layout="single")


def test_several_columns_stay_in_step(rows, tmp_path):
    write_in_order(rows, f"{tmp_path}/one", layout="single")
    write_in_order(rows, f"file://{tmp_path}/parts")
    for c in ("value", "more"):
        assert (tmp_path / "one" / c).read_text() == lines(c)
        parts = sorted((tmp_path / "parts" / c).iterdir())
        assert len(parts) > 2 and "".join(p.read_text() for p in parts) == lines(c)
    sizes = [[len(p.read_text().splitlines()) for p in sorted((tmp_path / "parts" / c).iterdir())] for c in ("value", "more")]
    assert sizes[0] == sizes[1]
    assert sorted(os.listdir(tmp_path)) == ["one", "parts"]


def test_a_failed_write_leaves_nothing(rows, tmp_path):
    bad = rows.select("ordinal", F.when(F.col("ordinal") == 4321, F.raise_error("no")).otherwise(F.col("value")).cast("string").alias("value"))
    for layout in ("single", "parts"):
        with pytest.raises(Exception, match="no"):
            write_in_order(bad, f"{tmp_path}/out", layout=layout)
        assert os.listdir(tmp_path) == []


def test_parts_out_of_order_are_refused(rows, tmp_path):
    with pytest.raises(Exception, match="order|overlap"):
        write_in_order(rows.select("ordinal", "value"), f"{tmp_path}/out", in_order=True)
    with pytest.raises(Exception, match="overlap"):
        write_in_order(rows.select("ordinal", "value").sortWithinPartitions("ordinal"), f"{tmp_path}/out", in_order=True)
    assert os.listdir(tmp_path) == []


def test_rows_in_order_are_not_shuffled(spark, tmp_path):
    rows = spark.range(0, N, 1, 5).select(F.col("id").alias("ordinal"), F.format_string("row %d é", "id").alias("value"))
    write_in_order(rows, f"{tmp_path}/out", in_order=True, layout="single")
    assert (tmp_path / "out").read_text() == lines()


def test_a_task_that_fails_once_counts_once(tmp_path):
    """A task attempt that wrote half of its part and died, and one whose part nobody committed."""
    import pyarrow as pa

    w = ordered._Writer({"path": f"{tmp_path}/out", "staging": f"{tmp_path}/out.x", "layout": "parts"}, ["value"])
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array([str(i) for i in range(a, b)])], ["ordinal", "value"])

    def dies():
        yield batch(0, 10)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        w.write(dies())
    w.write(iter([batch(0, 20)]))  # finished, but another attempt is the one that counts
    messages = [w.write(iter([batch(20, 30)])), w.write(iter([])), w.write(iter([batch(0, 10), batch(10, 20)]))]
    w.commit(messages)
    assert [p.read_text().split() for p in sorted((tmp_path / "out/value").iterdir())] == [[str(i) for i in range(20)], [str(i) for i in range(20, 30)]]
    assert os.listdir(tmp_path) == ["out"]


def test_null_and_stdout(rows, tmp_path, capfd):
    write_in_order(rows.select("ordinal", "value"), f"{tmp_path}/out", layout="null")
    assert os.listdir(tmp_path) == []
    capfd.readouterr()
    write_in_order(rows.select("ordinal", "value"), "", layout="stdout")
    assert capfd.readouterr().out == lines()


def test_no_rows(rows, tmp_path):
    for layout in ("single", "parts"):
        write_in_order(rows.where("ordinal < 0").select("ordinal", "value"), f"{tmp_path}/{layout}", layout=layout)
    assert (tmp_path / "single").read_text() == "" and os.listdir(f"{tmp_path}/parts/value") == []


def test_shuffled_pairs_come_back_whole(spark, data, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    pairs = sim.read_pairs(spark, data).repartition(11)
    want = [(i, r.ordinal, r.f_seq, r.r_qual) for i, r in enumerate(pairs.orderBy("ordinal").collect())]
    for layout, more in (("single", {"split_bytes": 20_000}), ("parts", {})):
        files = sinks.write_fastq_pairs(pairs, f"{tmp_path}/{layout}", layout=layout)
        got = read_fastq_pairs(spark, *files, mode="FAILFAST", **more).orderBy("ordinal").collect()
        assert [(int(r.id.x), r.f_seq, r.r_qual) for r in got] == [w[1:] for w in want]
        assert layout == "parts" or [r.ordinal for r in got] == [w[0] for w in want]


def test_what_is_only_counted_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(0, N, 1, 7).select((N - F.col("id")).alias("ordinal"), (F.col("id") % 3).alias("kind")).mapInArrow(run, "ordinal long, kind long")
    counts = write_in_order(rows, "", layout="null", tally=("kind",))
    assert sum(counts["kind"].values()) == N == made.value  # in any order; ranges of ordinals would need all rows twice


def test_pairs_come_in_order(spark, data):
    pairs = sim.read_pairs(spark, data, "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem", "lineitem")
    at = [r["ordinal"] for r in sorted(pairs.select("ordinal", F.monotonically_increasing_id().alias("m")).collect(), key=lambda r: r["m"])]
    assert at == sorted(set(at))
