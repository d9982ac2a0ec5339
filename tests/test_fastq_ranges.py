"""Files read in ranges equal files read in one piece."""

import bz2
import functools
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from readmerge.functions import seqid
from readmerge.sources import ranges
from readmerge.sources.fastq import SPLIT_BYTES, Malformed, count_files, fastq_diagnostics, plan, read_fastq_pairs, read_piece, records
from readmerge.sources.ranges import FileChanged, HttpFile, Source, find_marks
from readmerge.sources.records import count_range, scan


def quality(rng, n):
    """Scores that look like headers, bases or plus lines."""
    return rng.choice("@+ACGTI") + "".join(rng.choice("@+#IJACGT.") for _ in range(n - 1)) if n else ""


def text_of(n, seed=1, mate=1, end="\n", odd=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 30, 60, 151]) if odd else rng.choice([30, 60, 151])
        seq = "".join(rng.choice("ACGTN.acgt") for _ in range(size))
        out.append(end.join([f"@M1:1:FC:1:1:{i}:7 {mate}:N:0:ACGT", seq, "+" + rng.choice(["", "@again"]), quality(random.Random(i * 2 + mate), size), ""]))
    return "".join(out)


def broken(text, seed):
    """A text with lines left out, doubled, emptied and changed."""
    rng = random.Random(seed)
    lines = text.split("\n")
    for _ in range(25):
        i = rng.randrange(len(lines))
        lines[i : i + 1] = rng.choice([[], [lines[i]] * 2, [""], ["", lines[i]], ["x" + lines[i]], ["@" + lines[i]], ["+"], [lines[i] + "\r\r"], ["é" + lines[i]], ["@", "", "+"]])
    return "\n".join(lines)


def listed(source, at=0, skip=0):
    return [r for c in scan(source, at, skip) for r in zip(*(x.to_pylist() for x in (c.header, c.seq, c.qual, c.fault)), strict=True)]


def by_lines(data: bytes):
    """The records of a file by its definition, line by line, for tests."""
    from readmerge.sources.records import _LETTER, fault

    lines = [x.rstrip(b"\r") for x in (data[:-1] if data.endswith(b"\n") else data).split(b"\n")] if data else []
    out, i = [], 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        four = lines[i : i + 4]
        if len(four) < 4:
            return [*out, (None, None, None, "EOF")]
        wrong = fault(*four)
        out.append((None, None, None, wrong) if wrong else (four[0][1:].decode(errors="replace"), four[1].translate(_LETTER).decode(), four[3].decode(errors="replace"), None))
        if four[2][:1] == b"+":
            i += 4
        else:
            i += 1
            while i < len(lines) and not (lines[i][:1] == b"@" and len(lines) - i > 2 and lines[i + 2][:1] == b"+"):
                i += 1
    return out


@pytest.mark.parametrize("chunk", [37, 1000, 1 << 20])
@pytest.mark.parametrize("seed", range(6))
def test_records_by_chunks(tmp_path, monkeypatch, seed, chunk):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    text = text_of(120, seed, end="\r\n" if seed % 2 else "\n", odd=seed > 2)
    data = (broken(text, seed) if seed > 1 else text).encode()[: -1 if seed == 5 else None]
    (tmp_path / "x").write_bytes(data)
    want = by_lines(data)
    assert listed(Source.of(f"{tmp_path}/x")) == want
    assert [x if isinstance(x, tuple) else x.args[0] for x in records(f"{tmp_path}/x")] == [w[:3] if w[3] is None else w[3] for w in want]


@pytest.mark.parametrize("seed", range(8))
def test_64_ranges_equal_one(spark, tmp_path, seed):
    text = text_of(800, seed, end="\r\n" if seed % 2 else "\n", odd=True)
    data = (broken(text, seed) if seed > 3 else text).encode()
    if seed == 7:  # no record begins in most ranges, and the text looks like records
        data = b"@\n" * 2000 + text[:5000].encode() + b"\n" * 3000 + b"x" * 9000 + b"\n@h\nAC\n+\nII\n"
    (tmp_path / "x").write_bytes(data)
    source = Source.of(f"{tmp_path}/x")
    want = by_lines(data)
    found = count_files(spark, [source], -(-len(data) // 64))[0]
    assert len(found) in (63, 64) and sum(c.count for c in found) == len(want)
    at = 0
    for c in found:
        for k, pos in [(0, c.first), *c.marks] if c.count else []:
            assert listed(source, pos)[:3] == want[at + k : at + k + 3]
        at += c.count


def bits_of_streams(text, sizes):
    """bzip2 streams one after another, of blocks of at most 100,000 bytes."""
    out, at = b"", 0
    for n in sizes:
        out += bz2.compress(text[at : at + n], 1)
        at += n
    return out + bz2.compress(text[at:], 1) + bz2.compress(b"")


@pytest.mark.parametrize("sizes", [[], [70_000, 0, 450_000]])
def test_bzip2_blocks(spark, tmp_path, sizes):
    text = text_of(5000, 3).encode()
    (tmp_path / "x").write_bytes(bits_of_streams(text, sizes))
    source = Source.of(f"{tmp_path}/x")
    assert b"".join(d for _, d in source.chunks(0)) == text
    for n in (3, 9):
        found = count_files(spark, [source], -(-source.size // n))[0]
        assert len(found) in (n, n - 1) and sum(c.count for c in found) == 5000 and sum(c.count > 0 for c in found) > 2
        want, at = by_lines(text), 0
        for c in found:
            for k, pos in [(0, c.first), *c.marks] if c.count else []:
                assert next(scan(source, pos)).header[0].as_py() == want[at + k][0]
            at += c.count


def test_marks_at_every_bit_and_by_chance(tmp_path, monkeypatch):
    for shift in range(8):
        n = ((0x5A << 48 | ranges.BLOCK) << 56 | 0x5A5A << 8) << (8 - shift) if shift else (0x5A << 48 | ranges.BLOCK) << 64 | 0x5A5A
        assert [(b % 8, m) for b, m in find_marks(n.to_bytes(16, "big"))] == [(shift, ranges.BLOCK)]
    text = text_of(2000, 4).encode()
    (tmp_path / "x").write_bytes(bz2.compress(text, 1))
    true = ranges.find_marks
    monkeypatch.setattr(ranges, "find_marks", lambda d: sorted({*true(d), *((b, ranges.BLOCK) for b in range(1003, len(d) * 8, 90_001))}))  # marks inside blocks
    source = Source.of(f"{tmp_path}/x")
    assert b"".join(d for _, d in source.chunks(0)) == text
    parts = [count_range(source, a, b) for a, b in source.cuts(-(-source.size // 4))]
    assert sum(c.count for c in parts) == 2000


def test_a_damaged_block_is_an_error(tmp_path):
    data = bytearray(bz2.compress(text_of(3000, 4).encode(), 1))
    data[len(data) // 2] ^= 8
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(OSError, match="bzip2"):
        listed(Source.of(f"{tmp_path}/x"))


def rows(spark, *files, **more):
    return sorted(map(tuple, read_fastq_pairs(spark, *files, **more).collect()))


@pytest.mark.parametrize("packed", [False, True])
def test_pairs_by_ranges(spark, tmp_path, packed):
    f, r = text_of(3000, 5, 1).encode(), text_of(3000, 6, 2).encode()
    (tmp_path / "f").write_bytes(bz2.compress(f, 1) if packed else f)
    (tmp_path / "r").write_bytes(r)
    files = (f"{tmp_path}/f", f"{tmp_path}/r")
    size = 30_000 if not packed else 20_000
    assert len(plan(spark, [list(files)], size)) > (5 if packed else 15)
    assert len(plan(spark, [list(files)], SPLIT_BYTES)) == 1
    got = rows(spark, *files, split_bytes=size)
    assert len(got) == 3000 and got == rows(spark, *files)
    index = rows(spark, *files, files[0], split_bytes=size)
    assert index == rows(spark, *files, files[0]) and len(index) == 3000


@pytest.mark.parametrize("mode", ["PREFIX", "DROPMALFORMED"])
def test_faults_by_ranges(spark, tmp_path, mode):
    lines = text_of(2000, 7, 1).split("\n")
    lines[4 * 1500] = lines[4 * 1500].replace(":1500:", ":1:")  # another pair's mate
    lines[4 * 1600 + 1] = "?"
    (tmp_path / "f").write_text("\n".join(lines))
    (tmp_path / "r").write_text(text_of(1990, 8, 2))
    files = (f"{tmp_path}/f", f"{tmp_path}/r")
    one, many = ({k: sorted(map(tuple, g(spark, *files, mode=mode, split_bytes=n).collect())) for k, g in (("rows", read_fastq_pairs), ("lost", fastq_diagnostics))} for n in (SPLIT_BYTES, 20_000))
    assert one == many
    assert len(one["rows"]) == (1500 if mode == "PREFIX" else 1988)
    assert [x[1:3] for x in one["lost"]] == ([(1500, "NOTPAIRED")] if mode == "PREFIX" else [(1500, "NOTPAIRED"), (1600, "BADNT"), (1990, "EOF")])
    with pytest.raises(Exception, match="NOTPAIRED|BADNT|EOF"):
        rows(spark, *files, mode="FAILFAST", split_bytes=20_000)


def test_letters_of_old_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"@M1:1:FC:1:1:1:7 1:N:0:A\nAC.t-\xce\n+\nIIIIII\n")
    (tmp_path / "r").write_text("@M1:1:FC:1:1:1:7 2:N:0:A\nACGT\n+\nIIII\n")
    assert [r.f_seq for r in read_fastq_pairs(spark, f"{tmp_path}/f", f"{tmp_path}/r", mode="FAILFAST").collect()] == ["AC.t-N"]


class Flaky(http.server.BaseHTTPRequestHandler):
    """A server with ranges and tags that closes connections early."""

    files: dict = {}
    limit, ranges, tag = 40_000, True, '"one"'
    log_message = lambda *a: None

    def do_GET(self):
        data = self.files[self.path]
        given = self.headers.get("Range")
        fits = self.headers.get("If-Range") in (None, self.tag)
        at = int(given[6:-1]) if given and self.ranges and fits else 0
        self.send_response(206 if given and self.ranges and fits else 200)
        if given and self.ranges and fits:
            self.send_header("Content-Range", f"bytes {at}-{len(data) - 1}/{len(data)}")
        self.send_header("ETag", self.tag)
        self.send_header("Content-Length", str(len(data) - at))
        self.end_headers()
        self.wfile.write(data[at : at + self.limit])
        self.close_connection = True


@pytest.fixture
def server():
    kind = type("Handler", (Flaky,), {"files": {}})
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(kind)) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield kind, f"http://127.0.0.1:{s.server_address[1]}"
        s.shutdown()


def test_lost_connections(spark, server):
    kind, url = server
    kind.files.update({"/f": text_of(2500, 5, 1).encode(), "/r": bz2.compress(text_of(2500, 6, 2).encode(), 1)})
    assert len(kind.files["/f"]) > 8 * kind.limit
    assert HttpFile(f"{url}/f", wait=0).read() == kind.files["/f"]
    assert HttpFile(f"{url}/f", 1234, wait=0).read() == kind.files["/f"][1234:]
    got = rows(spark, f"{url}/f", f"{url}/r", split_bytes=100_000)
    assert len(got) == 2500 and len(plan(spark, [[f"{url}/f", f"{url}/r"]], 100_000)) > 2


def test_a_server_without_ranges_and_one_that_fails(server):
    kind, url = server
    kind.files["/f"] = text_of(2500, 5, 1).encode()
    kind.ranges, kind.limit = False, 1 << 30
    assert HttpFile(f"{url}/f", 1234, wait=0).read() == kind.files["/f"][1234:]
    assert Source.of(f"{url}/f").kind == "stream"
    kind.limit = 0
    with pytest.raises(ConnectionError, match="attempts"):
        HttpFile(f"{url}/f", wait=0, retries=2).read()


def test_a_changed_file_is_an_error(server):
    kind, url = server
    kind.files["/f"] = text_of(900, 5, 1).encode()
    f = HttpFile(f"{url}/f", wait=0)
    f.read(50_000)
    kind.tag = '"two"'
    with pytest.raises(FileChanged):
        f.read()
    with pytest.raises(FileChanged):
        list(Source(f"{url}/f", len(kind.files["/f"]), "plain", '"one"').chunks(0))


def test_no_file(server, tmp_path):
    with pytest.raises((FileNotFoundError, OSError)):
        Source.of(f"{tmp_path}/none")
    with pytest.raises(Malformed):
        list(read_piece(type("P", (), {"number": 0, "first": 0, "count": -1, "files": [(Source.of(__file__).asdict(), 0, 0)] * 2})(), "FAILFAST"))


def test_marks_are_searched_once_and_blocks_decoded_once(tmp_path, monkeypatch):
    text = text_of(9000).encode()
    (tmp_path / "f.bz2").write_bytes(b"".join(bz2.compress(text[i : i + 200_000]) for i in range(0, len(text), 200_000)))
    source, searched, decoded = Source.of(f"{tmp_path}/f.bz2"), [], []
    find, one = ranges.find_marks, ranges.one_block
    monkeypatch.setattr(ranges, "find_marks", lambda data: searched.append(len(data)) or find(data))
    monkeypatch.setattr(ranges, "one_block", lambda *a: decoded.append(1) or one(*a))
    assert b"".join(c for _, c in source.chunks(0)) == text
    assert sum(searched) < 1.1 * source.size and len(decoded) == -(-len(text) // 200_000)
    decoded.clear()
    assert next(source.inner(source.size // 2, source.size))[1] in text and len(decoded) == 1


def test_tasks_get_their_own_piece_and_neighbours_are_read_as_one():
    import pickle

    from readmerge.sources.fastq import Piece, _Reader, _together

    pieces = [Piece(n, 10 * i, 10 if i < 99 else -1, [({"path": str(n)}, i, 0)]) for n in range(2) for i in range(100)]
    some = _together(pieces, 20)
    assert len(some) == 20 and [p.first for p in some] == [*range(0, 1000, 100)] * 2 and [p.count for p in some] == ([100] * 9 + [-1]) * 2
    assert [p.files[0][1] for p in some] == [p.first // 10 for p in some] and _together(pieces, 200) == pieces
    import json
    from dataclasses import asdict

    size = [len(pickle.dumps(_Reader({"plan": json.dumps([asdict(p) for p in x])}))) for x in (pieces[:1], pieces)]
    assert size[0] == size[1]


def test_headers_are_parsed_once(spark, tmp_path):
    for mate in (1, 2):
        (tmp_path / str(mate)).write_text(text_of(5, mate=mate))
    plan_text = read_fastq_pairs(spark, f"{tmp_path}/1", f"{tmp_path}/2", mode="FAILFAST")._jdf.queryExecution().optimizedPlan().toString()
    once = spark.range(1).selectExpr("cast(id as string) AS h").select(seqid.parse(F.col("h")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("RLIKE") <= 2 * once.count("RLIKE")
