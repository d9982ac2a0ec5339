"""Growing FASTQ files as a stream, and modules that look at a mark."""

import pytest
from pyspark.sql import functions as F

from readmerge.operators import filters
from readmerge.operators.assemble import assemble
from readmerge.operators.config import AssemblerConfig
from readmerge.plans import sim
from readmerge.sources import sinks
from readmerge.streaming import fastq_live, live


@pytest.fixture(scope="module")
def texts(spark, data):
    df = sim.read_pairs(spark, data).where("ordinal between 1 and 400").orderBy("ordinal")
    rows = df.select(sinks.fastq_text("f", 1), sinks.fastq_text("r", 2)).collect()
    return [r[0] + "\n" for r in rows], [r[1] + "\n" for r in rows]


def drain(stream, folder, name):
    """Run a stream to the end of what is there; results go to files, so batches of several runs come together."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_growing_files(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(fastq_live, "MARK_BYTES", 2000)
    f, r = texts
    files = [[f"{tmp_path}/f0", f"{tmp_path}/f1"], [f"{tmp_path}/r0", f"{tmp_path}/r1"]]
    stream = lambda: fastq_live.stream_fastq_pairs(spark, *files)

    def add(name, text):
        with open(f"{tmp_path}/{name}", "a") as out:
            out.write(text)

    def found():
        got = spark.read.schema(stream().schema).parquet(f"{tmp_path}/out").collect()
        return sorted((r.ordinal >> 40, r.ordinal & ((1 << 40) - 1), r.f_seq, r.r_qual) for r in got)

    lines = lambda t: t.split("\n")
    want = lambda pair, a, b, first=0: [(pair, i - first, lines(f[i])[1], lines(r[i])[3]) for i in range(a, b)]
    add("f0", "".join(f[:50]) + f[50][:70])  # the mate's file has fewer records, this one ends in a record
    add("r0", "".join(r[:40]))
    drain(stream(), tmp_path, "out")
    assert found() == want(0, 0, 40)
    add("r0", "".join(r[40:55]))
    drain(stream(), tmp_path, "out")
    assert found() == want(0, 0, 50)
    add("f0", f[50][70:] + "".join(f[51:200]))
    add("r0", "".join(r[55:199]) + r[199][:-1])  # the last line may go on
    add("f1", "".join(f[300:]))
    drain(stream(), tmp_path, "out")
    assert found() == want(0, 0, 199)
    add("r0", "\n")
    add("r1", "".join(r[300:380]))
    drain(stream(), tmp_path, "out")
    drain(stream(), tmp_path, "out")  # nothing new
    assert found() == want(0, 0, 200) + want(1, 300, 380, 300)


def test_one_running_stream(spark, tmp_path, texts):
    f, r = texts
    for name in "fr":
        (tmp_path / name).write_text("")
    stream = live.assemble_stream(fastq_live.stream_fastq_pairs(spark, [f"{tmp_path}/f"], [f"{tmp_path}/r"]))
    q = stream.select("ordinal", "status").writeStream.format("memory").queryName("growing").outputMode("append").start()
    for a in range(0, 400, 100):
        for name, t in (("f", f), ("r", r)):
            with open(f"{tmp_path}/{name}", "a") as out:
                out.write("".join(t[a : a + 100]))
        q.processAllAvailable()
        assert spark.table("growing").count() == a + 100
    q.stop()
    assert sorted(x.ordinal for x in spark.table("growing").collect()) == list(range(400))


def test_faults_in_a_growing_file(spark, tmp_path, texts):
    f, r = texts
    broken = [*f[:3], f[3].split("\n")[0] + "\nACGT\nACGT\n", *f[4:8]]  # no plus line
    (tmp_path / "f").write_text("".join(broken))
    (tmp_path / "r").write_text("".join(r[:8]))
    drain(fastq_live.stream_fastq_pairs(spark, [f"{tmp_path}/f"], [f"{tmp_path}/r"]), tmp_path, "out")
    assert sorted(x.ordinal for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 4, 5, 6, 7]
    with pytest.raises(Exception, match="READLEN"):
        drain(fastq_live.stream_fastq_pairs(spark, [f"{tmp_path}/f"], [f"{tmp_path}/r"], mode="FAILFAST"), tmp_path, "strict")
    with pytest.raises(ValueError, match="PREFIX|DROPMALFORMED"):
        fastq_live.stream_fastq_pairs(spark, ["a"], ["b"], mode="PREFIX")
    (tmp_path / "f").write_text("")
    with pytest.raises(OSError, match="short"):
        fastq_live.complete(f"{tmp_path}/f", 100, 0)


@pytest.mark.parametrize("name", ["after", "before"])
def test_marks_in_streams(spark, data, tmp_path, name):
    pairs = sim.read_pairs(spark, data).where("ordinal between 1 and 300").select("ordinal", "id", "f_seq", "f_qual", "r_seq", "r_qual")
    i = pairs.where("ordinal >= 150").orderBy("ordinal").first()
    header = ":".join(str(i["id"][f]) for f in ("instrument", "run", "flowcell", "lane", "tile", "x", "y")) + " 1:N:0:" + i["id"]["tag"]
    cfg = AssemblerConfig(modules=(filters.load(f"{name}:{header}"),))
    schema = pairs.schema
    stream = lambda: live.assemble_stream(live.read_stream(spark, f"{tmp_path}/in", schema), cfg).select("ordinal", "status")
    (tmp_path / "in").mkdir()
    for n, cut in enumerate(("ordinal < 100", "ordinal >= 100 and ordinal < 200", "ordinal >= 200")):
        pairs.where(cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(stream(), tmp_path, "out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, assemble(pairs, cfg).select("ordinal", "status").collect()))
    assert len({s for o, s in got if o < i["ordinal"]} & {"MODULE"}) == (name == "after") and {s for o, s in got if o >= i["ordinal"]} & {"MODULE"} == ({"MODULE"} if name == "before" else set())
    # a mark that comes late: the pairs behind it in an earlier batch were judged without it
    (tmp_path / "late").mkdir()
    late = lambda: live.assemble_stream(live.read_stream(spark, f"{tmp_path}/late", schema), cfg).select("ordinal", "status")
    for cut in ("ordinal >= 200", "ordinal < 200"):
        pairs.where(cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
        drain(late(), tmp_path, "late-out")
    rejected = {r.ordinal for r in spark.read.parquet(f"{tmp_path}/late-out").where("status = 'MODULE'").collect()}
    every = {r.ordinal for r in pairs.select("ordinal").collect()}
    assert rejected == ({o for o in every if not i["ordinal"] <= o < 200} if name == "after" else {o for o in every if i["ordinal"] <= o < 200})
