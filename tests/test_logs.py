"""Log files: byte ranges, pushed filters, entries over blocks, tails."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import logs
from tessella.sources import logfile, ranges, tail


@pytest.mark.parametrize("text", ["", "a", "\n", "a\n\nbc\n" * 9 + "end", "x" * 50 + "\ny\n", "é\n" * 20])
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_ranges(tmp_path, monkeypatch, text, size):
    monkeypatch.setattr(ranges, "CHUNK", 4)
    path = str(tmp_path / "f")
    data = text.encode()
    open(path, "wb").write(data)
    [(name, n, _)] = ranges.files(path)
    parts = ranges.split(name, 0, n, size)
    got = sorted(x for p in parts for x in ranges.started(p))
    assert b"".join(d for _, d in got) == data and all(data[at : at + len(d)] == d for at, d in got)
    whole = data[: data.rfind(b"\n") + 1]
    got = sorted(x for p in parts for x in ranges.ended(p))
    assert b"".join(d for _, d in got) == whole and all(data[at : at + len(d)] == d for at, d in got)


def lines_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        stamp = f"202{rng.randrange(3)}-0{rng.randrange(1, 4)}-02T0{rng.randrange(3)}:04:05.678{rng.choice(['-0500', '+0100'])}"
        out.append(rng.choice([f"{stamp} {rng.choice('DIWEFX')} {rng.choice(['NETWORK', '-', 'REPL', 'UNKNOWN'])} [conn {i}] text {i}.é", f"{stamp} {rng.choice('IE')} A [] ", "no record", "", f"{stamp[:10]}"]) if i else stamp + "Z I A [x] utc")
    return out


FILTERS = [
    {},
    {"severity": {}},
    {"date": ("2021",)},
    {"date": ("2021", "02"), "time": ("01", "04")},
    {"severity": {"name": "Error"}},
    {"severity": {"value": 0}},
    {"severity": {"level": "X"}},
    {"severity": {"name": "Nonsense"}},
    {"component": "UNKNOWN", "severity": {"value": 4}},
    {"component": "not one", "date": ("x",)},
    {"context": "conn12"},
]


@pytest.mark.parametrize("wanted", FILTERS)
def test_search_and_scan_agree_with_the_plain_filter(spark, tmp_path, wanted):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(lines_of(150)))
    (folder / "b.log").write_text("\r\n".join(lines_of(90, 2)) + "\r\n")
    (folder / "_skipped").write_text("\n".join(lines_of(9, 3)))
    parsed = logs.parse_mongo(spark.read.text(str(folder))).drop("value")
    want = sorted(map(repr, (parsed.where(logs.mongo_filter(wanted)) if wanted else parsed).collect()))
    assert sorted(map(repr, logs.find_logs(spark, str(folder), wanted).drop("value").collect())) == want
    found = logs.scan_logs(spark, str(folder), wanted, range_bytes=700)
    assert sorted(map(repr, found.drop("file", "at").collect())) == want
    assert {r.file.rsplit("/", 1)[1] for r in found.collect()} <= {"a.log", "b.log"}
    for r in found.where("corrupt is null").collect():
        with open(r.file, "rb") as f:
            f.seek(r.at)
            assert f.readline().decode().startswith("-".join(r.date) + "T")


@pytest.mark.parametrize("timestamp, n", [("iso8601-utc", 1), ("ctime", 2)])
def test_timestamps(spark, tmp_path, timestamp, n):
    (tmp_path / "log").write_text("2020-01-02T03:04:05.678Z I A [x] one\nTue Jan 2 03:04:05.678 W B [y] two\nTue Jan 2 03:04:05 W B [y] three\n")
    want = sorted(map(repr, logs.parse_mongo(spark.read.text(str(tmp_path / "log")), timestamp=timestamp).drop("value").collect()))
    assert sorted(map(repr, logs.scan_logs(spark, str(tmp_path / "log"), None, timestamp).drop("file", "at").collect())) == want
    assert len([r for r in want if "corrupt=None" in r]) == n
    assert logs.scan_logs(spark, str(tmp_path / "log"), {"severity": {"level": "W"}}, timestamp).count() == (2 if timestamp == "ctime" else 0)


def test_filters_are_pushed(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(lines_of(50)))
    df = logs.scan_logs(spark, str(tmp_path / "log"), {"date": ("2021",), "severity": {"name": "Error"}})
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert "EqualTo(year,2021)" in pushed and "EqualTo(level,E)" in pushed
    reader = logfile.LogReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    other = GreaterThan(("at",), 5)
    assert list(reader.pushFilters([IsNotNull(("year",)), EqualTo(("year",), "2021"), In(("level",), ("E", "W")), EqualTo(("level",), "E"), other])) == [other]
    assert reader.allowed == {"year": {"2021"}, "level": {"E"}}


def brute_entries(text):
    out = []
    for i, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None]):
        if re.match(logs.ENTRY_START, line):
            out.append([len(out) + 1, i + 1, line])
        elif out:
            out[-1][2] += "\n" + line
    return [tuple(x) for x in out]


def log_text(rng, n):
    out = ["loose line"] * rng.randrange(3)
    for i in range(n):
        out.append(f"2020-01-0{i % 9 + 1} 03:04:05 info: entry {i}")
        out += [f"  line {j} {'x' * rng.choice([0, 30, 200])}" for j in range(rng.choice([0, 0, 0, 1, 3, 60]))]
    return "\n".join(out)


@pytest.mark.parametrize("size", [256, 1000, 5000, None])
def test_entries_over_blocks(spark, tmp_path, size):
    rng = random.Random(size)
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {"a": log_text(rng, 80), "b": log_text(rng, 3) + "\n", "c": "no entry\n" * 200, "d": "", "e": log_text(rng, 1) + "\n" + "rest\n" * 500}
    for name, text in texts.items():
        (folder / name).write_text(text)
    found = logs.file_entries(spark, str(folder), size).collect()
    got = {}
    for r in found:
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.entry_num, r.line_num, r.entry))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_entries(t) for k, t in texts.items() if brute_entries(t)}


def test_gathered_over_batches(spark, tmp_path):
    """Arrow batches end anywhere within a block."""
    text = log_text(random.Random(3), 40)
    (tmp_path / "log").write_text(text)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert sorted((r.entry_num, r.line_num, r.entry) for r in logs.file_entries(spark, str(tmp_path / "log"), 600).collect()) == brute_entries(text)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def tailed(spark, path, checkpoint, out, **options):
    tail.register(spark)
    stream = spark.readStream.format("tail").options(path=path, **options).load()
    return stream.writeStream.foreachBatch(lambda d, _: out.extend((os.path.basename(r.file), r.offset, r.value) for r in d.collect())).option("checkpointLocation", checkpoint).start()


def test_tail_of_a_folder(spark, tmp_path):
    folder, out = tmp_path / "logs", []
    folder.mkdir()
    (folder / "a").write_text("one\ntw")
    stream = tailed(spark, str(folder), str(tmp_path / "c"), out, start="begin", rangebytes=16)
    try:
        stream.processAllAvailable()
        assert out == [("a", 0, "one")]
        with open(folder / "a", "a") as f:  # a line far longer than a range, in three steps
            f.write("o\n" + "x" * 100)
        (folder / "b").write_text("first of b\r\nsecond\n")
        stream.processAllAvailable()
        open(folder / "a", "a").write("y" * 50)
        stream.processAllAvailable()
        open(folder / "a", "a").write("\nafter\n")
        stream.processAllAvailable()
        assert sorted(out) == sorted([("a", 0, "one"), ("a", 4, "two"), ("a", 8, "x" * 100 + "y" * 50), ("a", 159, "after"), ("b", 0, "first of b"), ("b", 12, "second")])
        out.clear()
        (folder / "b").write_text("cut\n")  # smaller: from its start
        os.rename(folder / "a", tmp_path / "old")
        (folder / "a").write_text("another file of the same name, " + "longer " * 60 + "\n")
        stream.processAllAvailable()
        assert sorted(x[:2] for x in out) == [("a", 0), ("b", 0)]
    finally:
        stream.stop()
    out.clear()
    open(folder / "b", "a").write("while it was down\n")
    stream = tailed(spark, str(folder), str(tmp_path / "c"), out, start="begin", rangebytes=16)
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert out == [("b", 4, "while it was down")]


def test_tail_from_the_end_and_ranges(tmp_path):
    (tmp_path / "log").write_text("old\n")
    reader = tail.TailReader({"path": str(tmp_path / "log"), "rangebytes": "10"})
    start = reader.initialOffset()
    open(tmp_path / "log", "a").write("new line one\nnew line two\n")
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    assert [(p.start, p.stop) for p in parts] == [(4, 14), (14, 24), (24, 30)]
    assert sorted(t for p in parts for b in reader.read(p) for t in b.to_pydict()["value"]) == ["new line one", "new line two"]
    assert reader.partitions(end, end) == [] and json.loads(end["files"])
    assert tail.TailReader({"path": str(tmp_path / "none")}).latestOffset() == {"files": "{}"}
