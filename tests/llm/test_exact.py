"""Exact duplicates against a brute-force version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, best[0], len(members), sha) for i, _ in members]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    texts = ["", None, " \t", "a b", "ab", " ab ", "a b", "é\x0bx", "é x", "😀 y", "😀y ", "long " * 20_000, "long " * 20_000 + " "]
    texts += [rng.choice(["hot copy", "hotcopy", "hot  copy"]) for _ in range(300)] + [f"t{rng.randrange(60)}" for _ in range(150)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share, tracked", [(0.0001, 1 << 16), (0.2, 64), (0.9, 16)])  # all groups frequent; one; none
def test_copies(spark, share, tracked):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.copies(docs, share, tracked)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean", "string"]
    found = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    stay = exact.without_copies(docs, share, tracked).collect()
    assert sorted(r.doc_id for r in stay) == sorted({r.keep_id for r in found})


def test_frequent_digests_are_counted_exactly(spark):
    rng = random.Random(5)
    texts = ["hot"] * 900 + ["warm"] * 250 + [f"c{rng.randrange(3000)}" for _ in range(2000)]
    rng.shuffle(texts)
    keys = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).select(*exact._keys()).withColumn("row", F.monotonically_increasing_id())
    # 64 counters of 3,150 rows: counts are off by up to 172, and yet what is returned is exact
    found = exact.frequent(keys.checkpoint(), 0.07, 64).collect()
    first = {t: min(i for i, x in enumerate(texts) if x == t) for t in ("hot", "warm")}
    assert sorted((r.group_size, r.keep_id) for r in found) == [(250, first["warm"]), (900, first["hot"])]
    with pytest.raises(ValueError):
        exact.frequent(keys, 0.01, 64)


def test_many_empty_partitions(spark):
    rows = corpus(6)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = exact.copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "x y", 1), (None, "xy", 2), (7, "x  y", 3), (7, "x  y", 4), (7, " xy ", 5), (None, "only", 6), (1, "q", 7), (1, "q", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    for name in ("row", "kept", "whole", "winner", "length", "tie", "group_size"):
        docs = docs.withColumn(name, F.lit("own"))
    for share, tracked in ((0.0001, 1 << 16), (0.9, 16)):
        found = exact.copies(docs, share, tracked).collect()
        assert len(found) == 8 and sum(r.kept for r in found) == 3
        assert {r.keep_id for r in found if r.group_size == 5} == {7}
        stay = exact.without_copies(docs, share, tracked)
        assert stay.columns == docs.columns
        got = sorted(stay.select("digest", "row").collect())
        assert [r.row for r in got] == ["own"] * 3 and got[0].digest in (3, 4, 5) and got[1].digest == 6 and got[2].digest in (7, 8)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, other int")
    assert exact.copies(docs).collect() == [] and exact.without_copies(docs).collect() == []


def test_no_python_and_one_shuffle_of_rows(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    plan = exact.copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert plan.count("hashpartitioning") == 1  # of the digests that aren't frequent
