"""Compression of vectors to codes of four bytes: k-means over each of four parts, on anchors-hierarchy metric trees.

Vectors are cut into blocks where they are read. For each part position a block gets a metric tree, built middle-out: about
sqrt(n) anchors, each new one the point farthest from its anchor, take over the points that are nearer to them (points
nearer to their anchor than half the distance between both anchors need no look); each anchor's points are divided in
the same way, and the anchors are then merged two by two into the smallest balls. A ball caches the count and the sum of
its points and its radius about their mean. The trees don't depend on the codebooks, so they are written once and read
by every round.

A round broadcasts the codebooks (256 entries a position at most) and goes down the trees. A ball inherits its parent's list
of candidate entries and drops those that can't own any of its points: of the entry nearest to the centre and another
one, the bisecting plane must cut the ball for the other to stay. A ball with one candidate left is wholly owned: its cached
sum and count go to that entry and its points aren't looked at. Points of leaves meet the candidates of their leaf only.
Distances and sums are whole numbers, so results are exact and don't depend on blocks, and entries get a row each and
task, which are summed by Spark; only the codebooks pass the driver.

Defined cases: vectors that are null or hold null, NaN or infinite components are left out; with fewer than 256 vectors the
codebook has as many entries; equal ids are ordered by their components, null ids come last in the first codebook; equal
vectors get equal codes, and many of them end in one leaf, as a ball without radius; null labels are one label; empty vectors
have empty parts and no error; an empty table gives an empty result; other columns are ignored. Vectors of different
lengths, of a length that isn't a multiple of four, or with components of 2 ** 15 or more (distances could leave 63
bits) are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, small, work_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a block, and points up to which a ball is a leaf.
BLOCK = 4096
LEAF = 96
#: Whole components are below this, so the distance of two parts of up to 2,048 components is below 2 ** 63.
MOST = 1 << 25


# --- trees


@dataclass
class Tree:
    """Balls in pre-order: children of ball i are i + 1 and other[i] (0: a leaf). Its points are order[start:stop]."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    other: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centre, exact for whole numbers that `exact` has converted."""
    return (points * points).sum(1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(1)[None, :]


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles, if all terms of their squared distances fit in 53 bits; otherwise as integers."""
    most = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return [a.astype(np.float64 if 4 * most * most * max(1, a.shape[1]) <= 1 << 53 else np.int64) for a in arrays]


def anchored(points: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point, of k anchors at most; fewer if the points are that few different ones."""
    owner = np.zeros(len(points), np.int64)
    spread = np.sqrt(((points - points[0]) ** 2).sum(1))
    pivots = [points[0]]
    for new in range(1, k):
        far = int(np.argmax(spread))
        if spread[far] <= 0:
            break
        pivot = points[far]
        between = np.sqrt(((np.asarray(pivots) - pivot) ** 2).sum(1))
        # nearer to its anchor than half the way to the new one: it stays there
        may = np.flatnonzero(spread > between[owner] / 2)
        own = np.sqrt(((points[may] - pivot) ** 2).sum(1))
        nearer = own < spread[may]
        owner[may[nearer]], spread[may[nearer]] = new, own[nearer]
        pivots.append(pivot)
    return owner


def merged(counts: np.ndarray, means: np.ndarray, radii: np.ndarray) -> list:
    """A binary nesting of the balls 0, 1, ...: always the two whose common ball is least are put together."""
    nested: list = list(range(len(counts)))
    counts, means, radii = counts.astype(float), means.copy(), radii.copy()
    alive = np.ones(len(counts), bool)
    size = (np.sqrt(np.maximum(squared(means, means), 0)) + radii[:, None] + radii[None, :]) / 2
    np.fill_diagonal(size, np.inf)
    for _ in range(len(counts) - 1):
        a, b = divmod(int(np.argmin(size)), len(counts))
        mean = (counts[a] * means[a] + counts[b] * means[b]) / (counts[a] + counts[b])
        radii[a] = max(np.linalg.norm(means[a] - mean) + radii[a], np.linalg.norm(means[b] - mean) + radii[b])
        counts[a], means[a], nested[a], alive[b] = counts[a] + counts[b], mean, (nested[a], nested[b]), False
        row = (np.sqrt(((means - mean) ** 2).sum(1)) + radii + radii[a]) / 2
        row[~alive] = np.inf
        size[a], size[:, a], size[b], size[:, b] = row, row, np.inf, np.inf
        size[a, a] = np.inf
    return nested[int(np.flatnonzero(alive)[0])]


def grown(points: np.ndarray) -> Tree:
    """The tree of the points, whole numbers."""
    points = points.astype(np.float64)
    order: list[np.ndarray] = []
    balls: list[list] = []  # start, stop, other
    at = 0

    def leaf(ids: np.ndarray) -> None:
        nonlocal at
        order.append(ids)
        balls.append([at, at + len(ids), 0])
        at += len(ids)

    def place(node, parts: list[np.ndarray]) -> None:
        if not isinstance(node, tuple):
            return build(parts[node])
        own = len(balls)
        balls.append([at, 0, 0])
        place(node[0], parts)
        balls[own][2] = len(balls)
        place(node[1], parts)
        balls[own][1] = at

    def build(ids: np.ndarray) -> None:
        if len(ids) <= LEAF:
            return leaf(ids)
        owner = anchored(points[ids], int(np.ceil(np.sqrt(len(ids)))))
        if not owner.any():
            return leaf(ids)
        parts = [ids[owner == k] for k in range(owner.max() + 1)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # an anchor that lost all its points leaves equal ones
            return leaf(ids)
        means = np.array([points[p].mean(0) for p in parts])
        radii = np.array([np.sqrt(((points[p] - m) ** 2).sum(1).max()) for p, m in zip(parts, means, strict=True)])
        place(merged(np.array([len(p) for p in parts]), means, radii), parts)

    build(np.arange(len(points)))
    start, stop, other = (np.array([b[i] for b in balls], np.int32) for i in range(3))
    order = np.concatenate(order).astype(np.int32)
    running = np.concatenate([np.zeros((1, points.shape[1])), np.cumsum(points[order], 0)])
    total = running[stop] - running[start]
    mean = total / (stop - start)[:, None]
    radius = np.array([np.sqrt(((points[order[a:b]] - m) ** 2).sum(1).max()) if m.size else 0.0 for a, b, m in zip(start, stop, mean, strict=True)])
    return Tree(order, start, stop, other, radius, total)


#: Room for rounding when an entry is dropped: such an entry is kept, which costs time only.
_SLACK = 1e-9


def assigned(points: np.ndarray, tree: Tree, entries: np.ndarray, each: bool) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each point, or None for both without `each`, and the counts and sums of
    entries. Ties go to the lower entry: one is dropped only where it is farther for every point of the ball."""
    n, dims = points.shape
    points, entries = exact(points, entries)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros((len(entries), dims), np.int64)
    code = np.zeros(n, np.int64) if each else None
    between = np.sqrt(np.maximum(squared(entries, entries), 0))
    centres = tree.total / (tree.stop - tree.start)[:, None]
    lists: dict[int, np.ndarray] = {0: np.arange(len(entries))}
    for ball in range(len(tree.start)):  # parents come before their children
        if (candidates := lists.pop(ball, None)) is None:
            continue  # below a ball that is wholly owned
        a, b = tree.start[ball], tree.stop[ball]
        if len(candidates) > 1:
            away = ((entries[candidates] - centres[ball]) ** 2).sum(1)
            best = int(np.argmin(away))
            # the bisecting plane of the best and another entry is (away - best) / (2 between) from the centre
            apart = away - away[best] - 2.0 * tree.radius[ball] * between[candidates[best], candidates]
            candidates = candidates[apart <= _SLACK * (away + away[best] + 1.0)]
        if len(candidates) == 1:
            owner = candidates[0]
            counts[owner] += b - a
            sums[owner] += tree.total[ball].astype(np.int64)
            if each:
                code[tree.order[a:b]] = owner
        elif tree.other[ball]:
            lists[ball + 1] = lists[int(tree.other[ball])] = candidates
        else:
            own = tree.order[a:b]
            look = own[:1] if tree.radius[ball] == 0 else own  # equal points
            nearest = np.broadcast_to(candidates[np.argmin(squared(points[look], entries[candidates]), axis=1)], len(own))
            counts += np.bincount(nearest, minlength=len(entries))
            np.add.at(sums, nearest, points[own].astype(np.int64))
            if each:
                code[own] = nearest
    return code, ((points - entries[code]) ** 2).sum(1) if each else None, counts, sums


# --- tables


def usable(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def kept(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the usable vectors, their components as whole numbers."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    v = F.transform(whole, lambda x: F.when(F.abs(x) < MOST, x).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("int"))
    return vectors.where(usable(vector)).select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))


def _blocks(dims: int):
    """Rows (vec_id, label, v) to one row a block: lists of ids and labels, components, trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            lists = rows.column(2)
            if (np.diff(lists.offsets.to_numpy()) != dims).any():
                raise ValueError(f"a vector hasn't {dims} components")
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(rows), dims)
            trees = [grown(part) for part in np.split(v, PARTS, axis=1)]
            ends = pa.array([0, len(rows)], pa.int32())
            packed = [np.concatenate([getattr(t, name).ravel() for t in trees]).tobytes() for name in Tree.__dataclass_fields__]
            columns = [pa.ListArray.from_arrays(ends, rows.column(0)), pa.ListArray.from_arrays(ends, rows.column(1)), pa.array([v.tobytes()]), pa.array([np.array([len(t.start) for t in trees], np.int32).tobytes()]), *[pa.array([p]) for p in packed]]
            return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "v", "balls", *Tree.__dataclass_fields__])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            while sum(map(len, waiting)) >= BLOCK:
                table = pa.Table.from_batches(waiting).combine_chunks()
                yield block(table.slice(0, BLOCK).combine_chunks().to_batches()[0])
                waiting = table.slice(BLOCK).to_batches()
        if sum(map(len, waiting)):
            yield block(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return run


def planted(vectors: DataFrame, dims: int) -> DataFrame:
    """The blocks of kept vectors with their trees, written to the shared folder and read back."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    shape = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, v binary, balls binary, " + ", ".join(f"{name} binary" for name in Tree.__dataclass_fields__)
    path = work_path(vectors.sparkSession, "anchors")
    vectors.mapInArrow(_blocks(dims), shape).write.option("parquet.block.size", 32 << 20).parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _opened(row: dict, dims: int) -> tuple[np.ndarray, list[Tree]]:
    """The components of a block (n, dims), and the trees of its parts."""
    n, width = len(row["order"]) // (4 * PARTS), dims // PARTS
    v = np.frombuffer(row["v"], np.int32).reshape(n, dims)
    balls = np.frombuffer(row["balls"], np.int32)
    ends = np.cumsum(balls)[:-1]
    piece = lambda name, kind, at: np.split(np.frombuffer(row[name], kind), at)
    total = [t.reshape(b, width) for t, b in zip(piece("total", np.float64, ends * width), balls, strict=True)]
    fields = [piece("order", np.int32, np.arange(1, PARTS) * n), *[piece(k, np.int32, ends) for k in ("start", "stop", "other")], piece("radius", np.float64, ends), total]
    return v, [Tree(*f) for f in zip(*fields, strict=True)]


def _round(codebooks: np.ndarray, dims: int):
    """Blocks to the counts and sums of entries, a row each for those that the task's points use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, codebooks.shape[1]), np.int64)
        sums = np.zeros((*counts.shape, dims // PARTS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                v, trees = _opened(row, dims)
                for p, (part, tree) in enumerate(zip(np.split(v, PARTS, axis=1), trees, strict=True)):
                    _, _, n, s = assigned(part, tree, codebooks[p], each=False)
                    counts[p] += n
                    sums[p] += s
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(counts[part, entry]), "s": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    return run


def _last(codebooks: np.ndarray, dims: int):
    """Blocks to vec_id, label, code and error of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i].as_py() for k in ("v", "balls", *Tree.__dataclass_fields__)}
                v, trees = _opened(row, dims)
                codes, error = np.zeros((len(v), PARTS), np.uint8), np.zeros(len(v), np.int64)
                for p, (part, tree) in enumerate(zip(np.split(v, PARTS, axis=1), trees, strict=True)):
                    code, away, _, _ = assigned(part, tree, codebooks[p], each=True)
                    codes[:, p] = code
                    error += away.astype(np.int64)
                ids, labels = (batch.column(k)[i].values for k in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


@dataclass
class Codebooks:
    """entries: whole numbers, by part, entry and position within the part."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def trained(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds over the blocks; first: (entries, dims) vectors that they start from."""
    dims = first.shape[1]
    entries = np.stack(np.split(first, PARTS, axis=1))
    trees = blocks.select("v", "balls", *Tree.__dataclass_fields__)
    for _ in range(rounds):
        found = trees.mapInArrow(_round(entries, dims), "part int, entry int, n long, s array<long>")
        sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims // PARTS)]
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # 4 x 256 rows at most
        entries = entries.copy()
        for part, entry, n, *s in total:
            entries[part, entry] = np.array(s, np.int64) // n
    return Codebooks(entries)


def first_vectors(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The components of the kept vectors with the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if len({len(r.v) for r in rows}) > 1 or rows and len(rows[0].v) % PARTS:
        raise ValueError("vectors must have one length, a multiple of four")
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), -1 if rows and rows[0].v else 0)


def encoded(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of each kept vector, and the codebooks that codes refer to."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's byte names 256 entries")
    whole = kept(vectors, id_column, vector, label)
    first = first_vectors(whole, entries)
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not len(first):
        return whole.sparkSession.createDataFrame([], shape), Codebooks(np.zeros((PARTS, 0, 0), np.int64))
    blocks = planted(whole, first.shape[1])
    books = trained(blocks, first, rounds)
    return blocks.mapInArrow(_last(books.entries, first.shape[1]), shape), books


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", to: str = "vector") -> DataFrame:
    """codes with the vectors that they stand for, as doubles."""
    table = F.lit([[(entry / SCALE).tolist() for entry in part] for part in books.entries])
    byte = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(to, F.concat(*[table[p][byte(p)] for p in range(PARTS)]))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = cut(found)
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(small(cut(sums)), found["label"].eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as chained tables."""
    near = """n{i} AS MATERIALIZED (SELECT vec_id, p, min_by(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT q.vec_id, q.p, e.k, list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q JOIN e{i} e USING (p)) GROUP BY ALL)"""
    means = """e{j} AS MATERIALIZED (SELECT e.p, e.k, coalesce(m.v, e.v) AS v FROM e{i} e LEFT JOIN (
  SELECT p, k, list((s - ((s % c) + c) % c) // c ORDER BY x) AS v FROM (SELECT n.p, n.k, x, sum(q.v[x])::BIGINT AS s, count(*) AS c FROM n{i} n JOIN q USING (vec_id, p), dims GROUP BY ALL) GROUP BY p, k) m USING (p, k))"""
    steps = []
    for i in range(ROUNDS):
        steps += [near.format(i=i), means.format(i=i, j=i + 1)]
    steps.append(near.format(i=ROUNDS))
    return f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, p::INT AS p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM w, range({PARTS}) r(p)),
dims AS MATERIALIZED (SELECT unnest(range(1, (SELECT max(len(v)) FROM q) + 1)) AS x),
e0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS k, v FROM q QUALIFY k < {ENTRIES}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS h FROM e{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes c JOIN w USING (vec_id), books"""


OP11_SQL = _sql()
