"""The event bus against a plain simulation."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.streaming import bus

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "id long, type string, message string, cancel boolean, at timestamp"
SECOND = 1_000_000


def plain(requests, pace, until):
    """Updates before `until` of (second, id, type, message, cancel), ids one by one, second by second."""
    out = []
    for id_ in {r[1] for r in requests}:
        own = sorted(r for r in requests if r[1] == id_)
        busy, start, text, kind = False, 0, "", ""
        for now in range(int(until)):
            if busy and (now - start) % pace == 0 and now > start:
                n = (now - start) // pace
                out.append((id_, "RUNNING", n, bus.apply_kind(kind, text[:n]), int(n / len(text) * 100), now * SECOND))
                if n == len(text):
                    out.append((id_, "DONE", n + 1, bus.apply_kind(kind, text), None, now * SECOND))
                    busy = False
            for _, _, k, message, cancel in (r for r in own if r[0] == now):
                n = (now - start) // pace
                if cancel and busy:
                    out += [(id_, "CANCELED", n + 1, "cancelling", None, now * SECOND), (id_, "DONE", n + 2, bus.apply_kind(kind, text[:n]), None, now * SECOND)]
                    busy = False
                elif not cancel and not busy:
                    kind = k.lower() if k and k.lower() in bus.NAMES else "reverse"
                    if message:
                        busy, start, text = True, now, message
                    else:
                        out.append((id_, "DONE", 1, "", None, now * SECOND))
    return sorted(out, key=str)


def given(seed, n):
    """At most one request of an id a second."""
    rng = random.Random(seed)
    found = {(rng.randrange(200), rng.randrange(6)): (rng.choice(["yell", "Compress", None, "other"]), rng.choice(["a B!c", "xyz", "", None, "a longer message"]), rng.random() < 0.3) for _ in range(n)}
    return [(at, id_, *rest) for (at, id_), rest in found.items()]


def put(folder, name, requests):
    rows = [json.dumps({"id": i, "type": k, "message": m, "cancel": c, "at": (START + dt.timedelta(seconds=s)).isoformat()}) for s, i, k, m, c in requests]
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(rows) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.json")


def told(df):
    base = int(START.timestamp()) * SECOND
    return sorted(((r.id, r.status, r.step, r.message, r.percent, r.at_us - base) for r in df.collect()), key=str)


@pytest.mark.parametrize("files", [1, 4])
def test_event_time_in_any_batches(spark, tmp_path, files):
    """Out of order within the delay, in batches of any size, with repeats, cancels and ids that are free again."""
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    requests = given(files, 150)
    random.Random(1).shuffle(requests)
    for k in range(files):
        put(folder, f"f{k}", requests[k::files])
    put(folder, "last", [(400, 99, "yell", "", False)])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    found = bus.replayed(spark, bus.bus(source, pace=3, delay="300 seconds"), str(tmp_path / "out"))
    assert told(found.where("id < 99")) == [x for x in plain(requests, 3, 100) if x[0] < 99]
    assert {"RUNNING", "CANCELED", "DONE"} == {r.status for r in found.collect()}


def test_restart(spark, tmp_path):
    """What was active or waiting when a stream ended goes on in the next one."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    requests = given(9, 120)
    stream = lambda: bus.bus(spark.readStream.schema(SCHEMA).json(folder), pace=7)
    put(folder, "a", [r for r in requests if r[0] < 60])
    newest = max(r[0] for r in requests if r[0] < 60)
    first = told(bus.replayed(spark, stream(), out))
    assert first == plain([r for r in requests if r[0] < 60], 7, newest)
    put(folder, "b", [r for r in requests if r[0] >= 60] + [(500, 99, "yell", "", False)])
    assert [x for x in told(bus.replayed(spark, stream(), out)) if x[0] < 99] == plain(requests, 7, 500)
    assert all(x in plain(requests, 7, 500) for x in first)


def test_processing_time(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    os.makedirs(folder)
    source = spark.readStream.schema("id long, type string, message string, cancel boolean").json(folder)
    stream = bus.bus(source, pace=0.1, event_time=False).writeStream.foreachBatch(lambda d, _: out.extend(tuple(r) for r in d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    put_rows = lambda name, rows: open(f"{folder}/{name}.json", "w").write("\n".join(map(json.dumps, rows)) + "\n")
    try:
        put_rows("a", [{"id": 1, "type": "yell", "message": "abcd"}, {"id": 1, "type": "yell", "message": "again"}, {"id": 2, "message": "x" * 9000}])
        end = time.time() + 60
        while time.time() < end and not any(r[0] == 2 for r in out):
            time.sleep(0.2)
        put_rows("b", [{"id": 2, "cancel": True}])
        while time.time() < end and not {1, 2} <= {r[0] for r in out if r[6]}:
            time.sleep(0.2)
        put_rows("c", [{"id": 1, "type": "yell", "message": "after"}])
        while time.time() < end and not any(r[4] == "AFTER" for r in out):
            time.sleep(0.2)
    finally:
        stream.stop()
    assert [r[4] for r in out if r[0] == 1 and r[6]] == ["ABCD", "AFTER"]
    assert [r[2] for r in out if r[0] == 2][-2:] == ["CANCELED", "DONE"]
