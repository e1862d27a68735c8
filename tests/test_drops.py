"""The drop source: whole files, log, packing, backlog, files larger than a worker."""
import gzip
import io
import json
import os
import subprocess
import sys
import zlib

import pyarrow.fs as pafs
import pytest

from tagscope.streaming import drops, ingest

LOCAL = pafs.LocalFileSystem()


def gz(path, lines):
    with gzip.open(path, "wt") as f:
        f.write("".join(line + "\n" for line in lines))


def line(tag, second, value=1.0):
    return json.dumps({"TagName": tag, "DateTime": f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}", "Value": value})


@pytest.mark.parametrize("raw,whole", [
    (gzip.compress(b"a\nb\n"), True), (gzip.compress(b"a") + gzip.compress(b"b"), True), (gzip.compress(b""), True),
    (gzip.compress(os.urandom(3_000_000)), True), (gzip.compress(bytes(50_000_000)), True),
    (b"", False), (b"text", False), (gzip.compress(b"abc" * 1000)[:-1], False), (gzip.compress(b"abc" * 1000)[:15], False),
    (gzip.compress(b"a\n") + b"junk", False), (gzip.compress(b"a\n") + gzip.compress(b"b\n")[:-5], False)])
def test_whole_files(tmp_path, raw, whole):
    path = str(tmp_path / "f.gz")
    (tmp_path / "f.gz").write_bytes(raw)
    assert drops.is_whole(LOCAL, path) == whole
    if whole:
        assert b"".join(drops.unpacked(io.BytesIO(raw))) == gzip.decompress(raw)


def test_lines(tmp_path):
    path = str(tmp_path / "f.gz")
    (tmp_path / "f.gz").write_bytes(gzip.compress(b"one\r\n\n  \ntwo\n" + b"x" * 3_000_000 + b"\nlast") + gzip.compress(b" part\nend\n"))
    assert [(len(t), p) for t, p in drops.lines_of(LOCAL, path)] == [(3, None), (3, None), (3_000_000, None), (9, None), (3, None)]
    assert list(drops.lines_of(LOCAL, path, max_line=1_500_000)) == [
        ("one", None), ("two", None), ("x" * drops.KEPT_OF_LONG, drops.TOO_LONG), ("last part", None), ("end", None)]


def test_packing():
    files = [("a", 10), ("big", 100), ("b", 60), ("c", 50), ("d", 1), ("zero", 0)]
    assert drops.packed(files, 100) == [[("big", 100)], [("a", 10), ("b", 60)], [("c", 50), ("d", 1), ("zero", 0)]]
    assert drops.packed([], 100) == []


def test_log_survives_restarts_and_folds(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    options = {"path": str(src), "state": str(tmp_path / "log"), "patterns": "hs_*", "maxFiles": "2"}
    for i in range(3):
        gz(src / f"hs_{i}.json.gz", ["x"])
        os.utime(src / f"hs_{i}.json.gz", (i, i))
    gz(src / "other.gz", ["x"])
    r = drops.DropStreamReader(options)
    assert r.latestOffset() == {"entry": 1}
    r = drops.DropStreamReader(options)                       # a restart before Spark noted the offset
    assert r.latestOffset() == {"entry": 2} and r.latestOffset() == {"entry": 2}
    names = [[f for p in r.partitions({"entry": a}, {"entry": b}) for f, _ in p.files] for a, b in ((0, 1), (1, 2), (0, 2), (2, 2))]
    assert names == [["hs_0.json.gz", "hs_1.json.gz"], ["hs_2.json.gz"], ["hs_0.json.gz", "hs_1.json.gz", "hs_2.json.gz"], []]
    r.commit({"entry": 1})
    r.commit({"entry": 1})                                    # told twice
    assert drops.FileLog(options["state"]).done() == (1, ["hs_0.json.gz", "hs_1.json.gz"])
    assert drops.DropStreamReader(options).latestOffset() == {"entry": 2}
    os.remove(src / "hs_0.json.gz")
    r.commit({"entry": 2})
    assert sorted(os.listdir(options["state"])) == ["done.json"]
    assert drops.FileLog(options["state"]).done() == (2, ["hs_1.json.gz", "hs_2.json.gz"])      # only what is still there
    gz(src / "hs_3.json.gz", ["x"])
    assert drops.DropStreamReader(options).latestOffset() == {"entry": 3}


def test_backlog_of_five_thousand_files(spark, tmp_path):
    src, sink, rej, ck = (str(tmp_path / x) for x in ("in", "sink", "rej", "ck"))
    os.makedirs(src)
    for i in range(5000):
        raw = gzip.compress(line(f"T{i % 7}", i % 3600).encode(), 1)
        with open(f"{src}/hs_{i:04d}.json.gz", "wb") as f:
            f.write(raw if i % 1000 else raw[:-3])
    assert ingest.drain_ingest(spark, src, sink, rej, ck, max_files=2500) == 2
    assert ingest.read_ingested(spark, sink).count() == 4995
    bad = spark.read.json(rej).collect()
    assert len(bad) == 5 and {r.reason for r in bad} == {"unreadable file"}
    assert ingest.drain_ingest(spark, src, sink, rej, ck, max_files=2500) == 0          # nothing twice
    assert ingest.read_ingested(spark, sink).count() == 4995


def test_a_file_larger_than_the_memory_limit(tmp_path):
    """Unpacked 600 MB, read with 300 MB of address space on top of what the process holds."""
    path = tmp_path / "hs_big.json.gz"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    block = ("".join(line("T", i % 3600) + "\n" for i in range(1000))).encode()
    with open(path, "wb") as f:
        for _ in range(600_000_000 // len(block)):
            f.write(packer.compress(block))
        f.write(packer.flush())
    code = f"""
import resource
from tagscope.streaming import drops
held = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (held + 300_000_000,) * 2)
print(sum(b.num_rows for b in drops.read_files({str(tmp_path)!r}, [("hs_big.json.gz", 0)], drops.MAX_LINE)))"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == str(600_000_000 // len(block) * 1000), out.stderr[-2000:]


def test_same_rejects_in_batch_and_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    os.makedirs(src)
    gz(f"{src}/hs_1.json.gz", [line("A", 1), "not json", '{"Value": 3}', "", '{"TagName": "B", "DateTime": "yesterday"}', "[1]"])
    good, bad = ingest.split_batch(ingest.read_drops(spark, src))
    assert [tuple(r)[0] for r in good.collect()] == ["A"]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [
        ("[1]", "malformed"), ("not json", "malformed"), ('{"TagName": "B", "DateTime": "yesterday"}', "malformed"),
        ('{"Value": 3}', "missing field")]
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"hs_1.json.gz"}
