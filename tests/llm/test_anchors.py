"""Vector codes against a brute-force k-means, and trees against their definition."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import anchors

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Rows of (vec_id, label, code, error), and the hash of the final codebooks."""
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // 4
    parts = [[r[1][p * width : (p + 1) * width] for r in good] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def nearest(x, book):
        away = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            owners = [nearest(x, book)[0] for x in part]
            for k in set(owners):
                own = [x for x, o in zip(part, owners, strict=True) if o == k]
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [[nearest(x, book) for x in part] for part, book in zip(parts, books, strict=True)]
    out = [(r[0], r[2], "".join(f"{p[j][0]:02x}" for p in last), sum(p[j][1] for p in last)) for j, r in enumerate(good)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(seed, n, dims=8, spread=1.0, clusters=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dims)) * 0.1) * spread
    rows = [(i, [float(np.float32(x)) for x in row], int(rng.integers(3))) for i, row in enumerate(v)]
    for i in range(0, n, 9):  # copies of one vector
        rows[i] = (i, rows[1][1], None)
    return rows


@pytest.mark.parametrize("entries, spread, block", [(256, 1.0, 4096), (16, 1.0, 50), (40, 0.004, 4096), (16, 2000.0, 4096)])
def test_codes(spark, monkeypatch, entries, spread, block):
    monkeypatch.setattr(anchors, "BLOCK", block)
    rows = vectors(entries, 400, spread=spread)
    rows[5:9] = [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [float("nan")] * 8, 1), (8, [float("-inf")] * 8, None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("code", F.lit("own")).repartition(3)
    found, books = anchors.encoded(df, entries=entries)
    want, sha = brute(rows, entries)
    assert books.sha256() == sha
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    for r in anchors.decoded(found, books).join(df.select("vec_id", "embedding"), "vec_id").limit(50).collect():
        off = sum((np.floor(1024 * np.float64(x)) / 1024 - y) ** 2 for x, y in zip(r.embedding, r.vector, strict=True))
        assert abs(off * 1024**2 - r.error) < 1e-6 * (1 + r.error)


def test_trees():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (1500, 5)), np.tile([[3, 1, 4, 1, 5]], (200, 1))]).astype(np.int32)
    tree = anchors.grown(points)
    assert sorted(tree.order.tolist()) == list(range(1700))
    for ball, (a, b) in enumerate(zip(tree.start, tree.stop, strict=True)):
        own = points[tree.order[a:b]]
        assert (tree.total[ball] == own.sum(0)).all()
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1).max()) <= tree.radius[ball] + 1e-6
        if tree.other[ball]:
            assert tree.start[ball + 1] == a and tree.stop[ball + 1] == tree.start[tree.other[ball]] and tree.stop[tree.other[ball]] == b
        else:
            assert b - a <= anchors.LEAF or tree.radius[ball] == 0
    anchor = anchors.anchored(points.astype(float), 40)
    assert len(set(anchor.tolist())) == 40


def test_wholly_owned_balls_need_no_points(monkeypatch):
    """Two far clusters and two entries: no point is looked at."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 20, (600, 4)), rng.integers(5000, 5020, (600, 4))])
    tree = anchors.grown(points)
    seen = []
    monkeypatch.setattr(anchors, "squared", lambda p, c, f=anchors.squared: seen.append(len(p)) or f(p, c))
    _, _, counts, sums = anchors.assigned(points, tree, np.array([[0] * 4, [5000] * 4, [2500] * 4])[:2], each=False)
    assert counts.tolist() == [600, 600] and (sums == [points[:600].sum(0), points[600:].sum(0)]).all()
    assert seen == [2]  # only the distance between both entries


def test_ties_go_to_the_lower_entry():
    points = np.array([[0, 0], [2, 0], [1, 0], [1, 5]] * 30)
    code, away, _, _ = anchors.assigned(points, anchors.grown(points), np.array([[2, 0], [0, 0], [0, 0]]), each=True)
    assert code[:4].tolist() == [1, 0, 0, 0] and away[:4].tolist() == [0, 0, 1, 26]


def test_large_components_and_refusals(spark):
    rows = [(i, [float((i * 7919) % 30_000), -3.0, 1.5, float(i)], i % 2) for i in range(60)]
    found, books = anchors.encoded(spark.createDataFrame(rows, ROWS), entries=5)
    want, sha = brute(rows, 5)
    assert books.sha256() == sha and sorted(map(tuple, found.collect())) == sorted(want)
    for bad in ([(1, [40_000.0] * 4, 0)], [(1, [1.0] * 6, 0)], [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]):
        with pytest.raises(Exception):
            anchors.encoded(spark.createDataFrame(bad, ROWS))[0].collect()


def test_null_and_repeated_ids_empty_vectors_and_tables(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None), (None, [0.5] * 4, None), (3, [1.0] * 4, 1), (3, [0.0] * 4, 1), (4, [9.0] * 4, 2)]
    found, books = anchors.encoded(spark.createDataFrame(rows, ROWS), entries=3)
    want, sha = brute(rows, 3)
    assert books.sha256() == sha and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    found, _ = anchors.encoded(spark.createDataFrame([(1, [], 0), (2, [], 0)], ROWS))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "00000000", 0), (2, 0, "00000000", 0)]
    found, books = anchors.encoded(spark.createDataFrame([(1, None, 0)], ROWS))
    assert found.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
