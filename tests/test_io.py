import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from readmerge.functions import nt
from readmerge.operators import stats
from readmerge.operators.assemble import assemble
from readmerge.plans import cli, sim
from readmerge.sources import sinks
from readmerge.sources.fastq import Malformed, fastq_diagnostics, read_fastq_pairs, records
from readmerge.streaming import live


def fastq(rows, mate, side):
    return "".join(f"@M{r['id']['run']}:1:FC:{r['id']['lane']}:{r['id']['tile']}:{r['id']['x']}:{r['id']['y']} {mate}:N:0:{r['id']['tag']}\n{r[side + '_seq']}\n+\n{r[side + '_qual']}\n" for r in rows)


@pytest.fixture(scope="module")
def rows(spark, data):
    return sim.read_pairs(spark, data).where("ordinal between 1 and 60").orderBy("ordinal").collect()


def test_round_trip_of_all_compressions(spark, rows, tmp_path):
    (tmp_path / "f.txt").write_text(fastq(rows[:20], 1, "f"))
    (tmp_path / "r.gz").write_bytes(gzip.compress(fastq(rows[:20], 2, "r").encode()))
    (tmp_path / "f2").write_bytes(bz2.compress(fastq(rows[20:], 1, "f").encode()))
    (tmp_path / "r2").write_bytes(fastq(rows[20:], 2, "r").encode().replace(b"\n", b"\r\n")[:-2])
    got = read_fastq_pairs(spark, [f"{tmp_path}/f.txt", f"file://{tmp_path}/f2"], [f"{tmp_path}/r.gz", f"{tmp_path}/r2"]).orderBy("ordinal").collect()
    assert [(r["f_seq"], r["f_qual"], r["r_seq"], r["r_qual"], r["id"]["x"]) for r in got] == [(r["f_seq"], r["f_qual"], r["r_seq"], r["r_qual"], r["id"]["x"]) for r in rows]


def test_index_replaces_the_tag(spark, rows, tmp_path):
    strip = lambda t: "\n".join(x[: x.rindex(":") + 1] if x.startswith("@") else x for x in t.split("\n"))
    for name, text in (("f", strip(fastq(rows[:3], 1, "f"))), ("r", strip(fastq(rows[:3], 2, "r"))), ("i", strip(fastq(rows[:3], 1, "f")))):
        (tmp_path / name).write_text(text)
    got = read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r", f"{tmp_path}/i").collect()
    assert sorted(r["id"]["tag"] for r in got) == sorted(r["f_seq"][:49] for r in rows[:3])
    assert read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r").count() == 0  # tags are asked for


@pytest.mark.parametrize(
    "text, code",
    [("@a\nACZ\n+\nIII\n", "BADNT"), ("@a\nACG\n+\nII\n", "NOQUAL"), ("@a\nACG\nACG\n+\n", "READLEN"), ("@a\nACG\n?\nIII\n", "BADSEQ"), ("@a\nACG\n", "EOF"), ("a\nACG\n+\nIII\n", "BADID")],
)
def test_malformed_records(tmp_path, text, code):
    (tmp_path / "x").write_text(text)
    assert next(x for x in records(f"{tmp_path}/x") if isinstance(x, Malformed)).args == (code,)


def test_modes(spark, rows, tmp_path):
    f, r = fastq(rows[:6], 1, "f"), fastq(rows[:6], 2, "r")
    broken = f.split("\n")
    broken[9] = "?" + broken[9][1:]  # the third record
    (tmp_path / "f").write_text("\n".join(broken))
    (tmp_path / "r").write_text(r)
    read = lambda mode: read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r", mode=mode)
    assert (read("PREFIX").count(), read("DROPMALFORMED").count()) == (2, 5)
    with pytest.raises(Exception, match="BADNT"):
        read("FAILFAST").collect()
    (tmp_path / "f").write_text(fastq(rows[1:7], 1, "f"))  # identifiers do not agree
    assert (read("PREFIX").count(), read("DROPMALFORMED").count()) == (0, 0)
    with pytest.raises(Exception, match="NOTPAIRED"):
        read("FAILFAST").collect()


def test_a_short_mate_file_is_an_error(spark, rows, tmp_path):
    (tmp_path / "f").write_text(fastq(rows[:5], 1, "f"))
    (tmp_path / "r").write_text(fastq(rows[:3], 2, "r"))
    files = (f"{tmp_path}/f", f"{tmp_path}/r")
    with pytest.raises(Exception, match="EOF"):
        read_fastq_pairs(spark, *files, mode="FAILFAST").collect()
    for mode in ("PREFIX", "DROPMALFORMED"):
        assert read_fastq_pairs(spark, *files, mode=mode).count() == 3
        lost = fastq_diagnostics(spark, *files, mode=mode).collect()
        assert [(r["file_pair"], r["record"], r["code"], r["line"], r["path"]) for r in lost] == [(0, 3, "EOF", "ERR\tEOF", f"{tmp_path}/r")]
        assert lost[0]["header"].startswith("M") and "ended" in lost[0]["hint"]


@pytest.mark.parametrize("change", [lambda r: ["x" + r[0][1:], *r[1:]], lambda r: [r[0], r[1][:30], r[1][30:], *r[2:]], lambda r: [r[0], r[1], r[3]], lambda r: [r[0], "", *r[2:]], lambda r: ["@" + r[0], *r[1:]]])
def test_faults_in_one_record_leave_the_others_in_step(spark, rows, tmp_path, change):
    lines = fastq(rows[:4], 1, "f").split("\n")
    (tmp_path / "f").write_text("\n".join([*lines[:4], *change(lines[4:8]), *lines[8:]]))
    (tmp_path / "r").write_text(fastq(rows[:4], 2, "r"))
    files = (f"{tmp_path}/f", f"{tmp_path}/r")
    got = read_fastq_pairs(spark, *files, mode="DROPMALFORMED").orderBy("ordinal").collect()
    assert [r["f_seq"] for r in got] == [rows[i]["f_seq"] for i in (0, 2, 3)]
    assert [r["record"] for r in fastq_diagnostics(spark, *files, mode="DROPMALFORMED").collect()] == [1]
    assert read_fastq_pairs(spark, *files).count() == 1


def test_files_over_http(spark, rows, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "f.gz").write_bytes(gzip.compress(fastq(rows[:6], 1, "f").encode()))
    (tmp_path / "r").write_text(fastq(rows[:6], 2, "r"))
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_address[1]}"
        got = read_fastq_pairs(spark, f"{url}/f.gz", f"{url}/r").orderBy("ordinal").collect()
        server.shutdown()
    assert [r["r_seq"] for r in got] == [r["r_seq"] for r in rows[:6]]


def test_output(spark, data, tmp_path):
    out = assemble(sim.read_pairs(spark, data).where("ordinal between 1 and 50"), keep_reads=True).cache()
    ok = out.where("status = 'OK'").collect()
    sinks.write_text(sinks.fasta(out), f"{tmp_path}/fa", "gzip")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/fa").collect()]
    assert sorted(x for x in lines if not x.startswith(">")) == sorted(r["sequence"] for r in ok)
    assert all(x.count(":") == 7 and 0 <= float(x.split(";")[1]) <= 1 for x in lines if x.startswith(">"))
    for value in (r[0] for r in sinks.fastq(out).collect()):
        head, seq, plus, qual = value.split("\n")
        assert head[0] == "@" and plus == "+" and len(seq) == len(qual)
    none = out.withColumn("status", F.lit("NOALGN"))
    one, row = sinks.unaligned(none.where("ordinal = 1"), True).first()[0].split("\n"), out.where("ordinal = 1").first()
    assert one[1] == row["f_seq"] + "-" + row["r_seq"][::-1].translate(str.maketrans(nt.COMPLEMENT_FROM, nt.COMPLEMENT_TO)) and len(one[1]) == len(one[3])


def test_stream_equals_table(spark, data, tmp_path):
    pairs = sim.read_pairs(spark, data).where("ordinal between 1 and 100").select("ordinal", "id", "f_seq", "f_qual", "r_seq", "r_qual")
    pairs.write.parquet(f"{tmp_path}/in")
    stream = live.assemble_stream(live.read_stream(spark, f"{tmp_path}/in", pairs.schema))
    q = stream.select("ordinal", "status", "sequence").writeStream.format("memory").queryName("merged_rows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("merged_rows").collect())) == sorted(map(tuple, assemble(pairs).select("ordinal", "status", "sequence").collect()))
    q = live.running_stats(live.assemble_stream(live.read_stream(spark, f"{tmp_path}/in", pairs.schema))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counts").collect()) == pairs.count()


def test_stream_pairing(spark, tmp_path):
    kind = "id string, ts timestamp, ordinal long, seq string, qual string"
    for side in "fr":
        spark.createDataFrame([("a", None, 1, "ACGT", "IIII"), ("b", None, 2, "AC", "II")], kind).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/{side}")
    f, r = (spark.readStream.schema(kind).parquet(f"{tmp_path}/{s}") for s in "fr")
    q = live.pair_streams(f, r).writeStream.format("memory").queryName("paired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ordinal"] for r in spark.table("paired").collect()) == [1, 2]


def parsed(*args):
    import argparse

    p = argparse.ArgumentParser()
    cli._assembly_options(p)
    return p.parse_args(args)


def test_command_lines(spark, rows, tmp_path, capsys):
    (tmp_path / "f").write_text(fastq(rows, 1, "f"))
    (tmp_path / "r").write_text(fastq(rows, 2, "r"))
    files = ["-f", f"{tmp_path}/f", "-r", f"{tmp_path}/r"]
    assert cli.main(["assemble", *files, "-F", "-w", f"{tmp_path}/out", "-g", f"{tmp_path}/stat", "-U", "-l", "10", "-C", "overlap_stat", "-C", "short:105"]) == 0
    log = dict(x.split("\t", 1)[1].split("\t" if "EXAMINED" not in x else " ", 1) for x in (tmp_path / "stat").read_text().splitlines())
    out = assemble(read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r"), cli.config_of(parsed("-l", "10", "-C", "overlap_stat", "-C", "short:105")), keep_reads=True).orderBy("ordinal")
    assert (tmp_path / "out/merged").read_text() == "".join(r[0] + "\n" for r in sinks.fastq(out).collect())
    assert (tmp_path / "out/unaligned").read_text() == "".join(r[0] + "\n" for r in sinks.unaligned(out, True).collect())
    want = {r["code"]: str(r["value"]) for r in stats.stat_counts(out).collect()}
    assert {k: log[k] for k in ("READS", "NOALGN", "LOWQ", "BADR", "SLOW", "OK")} == {k: want[k] for k in ("READS", "NOALGN", "LOWQ", "BADR", "SLOW", "OK")} and int(want["MODULE"]) == int(log["SHORT"]) > 0
    assert log["OVERLAPS"].split() == [str(r["n"]) for r in stats.overlap_histogram(out).orderBy("overlap").collect()]
    assert log["EXAMINED"].split() == [str(r["n"]) for r in stats.examined_histogram(out).orderBy("examined").collect()]
    assert "NOFP" not in log and "TIME" in log
    capsys.readouterr()
    assert cli.main(["assemble", *files, "-W", f"{tmp_path}/o.bz2", "-G", f"{tmp_path}/log.bz2", "-d", "F"]) == 0
    assert bz2.decompress((tmp_path / "o.bz2").read_bytes()).decode() == "".join(r[0] + "\n" for r in sinks.fasta(assemble(read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r"))).collect())
    (tmp_path / "r").write_text(fastq(rows[:50], 2, "r"))
    assert cli.main(["hang", *files, "-P", "ACGTACGT", "-s", "-d", "Fs"]) == 0
    told = capsys.readouterr()
    assert told.err.splitlines()[0].startswith("ERR\tEOF\tM") and "* * *" in told.err and "STAT" not in told.err and told.out.count(">") > 30
    with pytest.raises(SystemExit):
        cli.main(["assemble", "-h"])
    assert "pear_test:alpha" in capsys.readouterr().out
    assert cli.main(["diff", *files, "--", "--", "-L", "90"]) == 2
    assert cli.main(["diff", *files, "--", "--"]) == 0
    assert cli.main(["checkid", "SRR001666.1 x", "what"]) == 0
    assert "SRA mate 1" in capsys.readouterr().out
    assert cli.main(["what"]) == 1
