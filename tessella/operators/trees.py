"""Search trees of any size, without building them: shape and traversals from the order of keys and of insertion.

A key inserted into a search tree becomes the child of that one of its two neighbours in key order, among the keys inserted
before it, that was inserted later. So in key order a node's neighbours are the nearest nodes on either side that were
inserted earlier, its subtree is what lies between them, and its ancestors are the chains of such neighbours to the left
and to the right.

Nodes are sorted into ranges of keys, a block each. A scan with a stack finds the neighbours within the block, and how many of
the chain lie in it. A node without one in its block (a record low) takes it from the nearest block that has an earlier
node; these few nodes only meet other blocks, in one window over record lows, and the lengths of their chains are summed by
pointer jumping. What the driver holds are four values a block.

Defined cases: of equal keys the first inserted stays; equal orders of insertion go by key; null keys are left out; trees of
different groups don't touch, null is a group; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.session import cut

BLOCK_ROWS = 500_000
#: Up to so many rows a table may be broadcast.
FEW = 1_000_000
SIDES = ("left", "right")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def neighbours(order: np.ndarray, starts: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a lower order (with ties: or an equal one), -1 if there is none; how many there
    are on the chain of those; and the last of that chain, itself if there are none. Chains don't pass the places in starts."""
    n = len(order)
    near, length, base = np.full(n, -1), np.zeros(n, np.int64), np.arange(n)
    stack: list[int] = []
    values, first = order.tolist(), set(starts.tolist())
    for i, v in enumerate(values):
        if i in first:
            stack = []
        while stack and (values[stack[-1]] > v or not ties and values[stack[-1]] == v):
            stack.pop()
        if stack:
            near[i], length[i], base[i] = stack[-1], len(stack), stack[0]
        stack.append(i)
    return near, length, base


def _nearest_block(edge: list, least: np.ndarray, block: int, group, order: int, left: bool) -> int | None:
    """The nearest block on that side whose facing edge is of the group and has a lower order (to the left: or an equal one)."""
    side = range(block - 1, -1, -1) if left else range(block + 1, len(edge))
    for b in side:
        if edge[b] != group:
            return None
        if least[b] < order or left and least[b] == order:
            return b
    return None


def _scanned(number: dict[int, int], first: list[int], edges: dict[str, tuple[list, np.ndarray]]):
    """Rows (group, key, inserted, block, at) of a block to its nodes with what the scans tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        group, key, order, block = (table.column(i).combine_chunks() for i in range(4))
        b, n = number[block[0].as_py()], len(table)
        order = order.to_numpy()
        groups = group.to_pylist()
        changes = np.array([0] + [i for i in range(1, n) if groups[i] != groups[i - 1]])
        rank = first[b] + np.arange(n)
        out = {"group": group, "key": key, "inserted": pa.array(order), "block": pa.array(np.full(n, b, np.int32)), "rank": pa.array(rank)}
        for left, name in ((True, "left"), (False, "right")):
            if left:
                near, length, base = neighbours(order, changes, True)
            else:
                near, length, base = neighbours(order[::-1], n - np.append(changes[1:], n), False)
                near, length, base = np.where(near >= 0, n - 1 - near, -1)[::-1], length[::-1], n - 1 - base[::-1]
            there = near >= 0
            none = pa.array(~there)
            at = pa.array(np.where(there, near, 0))
            out |= {f"{name}_rank": pc.if_else(none, None, pa.array(rank[at.to_numpy()])), f"{name}_key": pc.if_else(none, None, key.take(at)), f"{name}_inserted": pc.if_else(none, None, pa.array(order[at.to_numpy()]))}
            out |= {f"{name}_steps": pa.array(length), f"{name}_base": pa.array(rank[base])}
            # record lows of the block's outer group: what they look for lies in another block, or nowhere
            edge, least = edges[name]
            outer = groups[0] if left else groups[-1]
            ask: list[int | None] = [None] * n
            for i in np.flatnonzero(~there).tolist():
                if groups[i] == outer:
                    ask[i] = _nearest_block(edge, least, b, groups[i], int(order[i]), left)
            out[f"{name}_ask"] = pa.array(ask, pa.int32())
        yield from pa.table(out).to_batches(max_chunksize=50_000)

    return run


def _asked(nodes: DataFrame, side: str) -> DataFrame:
    """(rank, and rank, key, inserted, base and steps of the neighbour): for nodes that ask another block. In that block the record
    lows towards the asking side are met in order of insertion, and the last one that is early enough is the nearest."""
    other = SIDES[1 - SIDES.index(side)]
    offer = F.struct("rank", "key", "inserted", F.col(f"{side}_base").alias("base"), F.col(f"{side}_steps").alias("steps"))
    asks = nodes.where(F.col(f"{side}_ask").isNotNull()).select(F.col(f"{side}_ask").alias("of"), "group", "inserted", F.col("rank").alias("asks"))
    offers = nodes.where(F.col(f"{other}_rank").isNull()).select(F.col("block").alias("of"), "group", "inserted", offer.alias("offer"))
    # an equal order was inserted earlier if its key is lower: on the left, offers come first among equals
    last = F.col("asks").isNotNull() if side == "left" else F.col("asks").isNull()
    rows = asks.join(_few(asks.select("of").distinct()), "of").unionByName(offers.join(_few(asks.select("of").distinct()), "of"), allowMissingColumns=True)
    met = Window.partitionBy("of", "group").orderBy("inserted", last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("found", F.last("offer", ignorenulls=True).over(met)).where("asks is not null").select(F.col("asks").alias("rank"), "found.key", "found.inserted", F.col("found.rank").alias("near"), "found.base", "found.steps")


def _chain_lengths(asked: DataFrame) -> DataFrame:
    """(base, length): the length of the chain of each record low that has one, by pointer jumping."""
    hops = cut(asked.select(F.col("rank").alias("base"), F.col("base").alias("up"), (F.col("steps") + 1).alias("length")))
    while True:
        ends = _few(hops.select(F.col("base").alias("up"), F.col("up").alias("next"), F.col("length").alias("more")))
        joined = hops.join(ends, "up", "left")
        hops = cut(joined.select("base", F.col("next").alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
        if hops.where("up is not null").isEmpty():
            return hops.select("base", "length")


def tree_nodes(rows: DataFrame, key: str, inserted: str, group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, key, inserted, parent, depth, size, pre, in_order, post) of the nodes of a search tree, or of one a group: size counts a
    node's subtree with itself, and the three traversals count from 0. `inserted` is a whole number, the order of insertion."""
    of = F.col(group) if group else F.lit(0)
    nodes = rows.where(F.col(key).isNotNull()).groupBy(of.alias("group"), F.col(key).alias("key")).agg(F.min(F.col(inserted).cast("long")).alias("inserted"))
    nodes = cut(nodes)
    total = nodes.count()
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    if not total:
        return rows.sparkSession.createDataFrame([], f"group {kinds['group']}, key {kinds['key']}, inserted long, parent {kinds['key']}, depth long, size long, pre long, in_order long, post long")
    # each partition is a block, in order of groups and keys; stored, so that it stays what it is
    blocks = max(1, -(-total // block_rows))
    ranged = nodes.repartitionByRange(blocks, "group", "key").sortWithinPartitions("group", "key")
    placed = cut(ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at")))
    by_group = placed.groupBy("block", "group").agg(F.min("inserted").alias("least"), F.min("at").alias("at"), F.count("*").alias("n"))
    pick = F.struct("group", "least")
    edges = by_group.groupBy("block").agg(F.sum("n").alias("n"), F.min_by(pick, "at").alias("head"), F.max_by(pick, "at").alias("tail")).orderBy("block").collect()  # a row a block
    number = {r.block: i for i, r in enumerate(edges)}
    first = np.cumsum([0] + [r.n for r in edges]).tolist()
    faces = {"left": ([r["tail"].group for r in edges], np.array([r["tail"].least for r in edges])), "right": ([r["head"].group for r in edges], np.array([r["head"].least for r in edges]))}
    side = lambda s: f"{s}_rank long, {s}_key {kinds['key']}, {s}_inserted long, {s}_steps long, {s}_base long, {s}_ask int"
    shape = f"group {kinds['group']}, key {kinds['key']}, inserted long, block int, rank long, {side('left')}, {side('right')}"
    scanned = found = cut(placed.select("group", "key", "inserted", "block").mapInArrow(_scanned(number, first, faces), shape))
    for s in SIDES:
        asked = cut(_asked(scanned, s))
        lengths = _chain_lengths(asked) if not asked.isEmpty() else asked.select("base", F.lit(0).cast("long").alias("length"))
        other = asked.select("rank", *[F.col(c).alias(f"tsl_{c}") for c in ("near", "key", "inserted")])
        found = found.join(_few(other), "rank", "left").withColumns({f"{s}_rank": F.coalesce(f"{s}_rank", "tsl_near"), f"{s}_key": F.coalesce(f"{s}_key", "tsl_key"), f"{s}_inserted": F.coalesce(f"{s}_inserted", "tsl_inserted")}).drop("tsl_near", "tsl_key", "tsl_inserted")
        found = found.join(_few(lengths.withColumnRenamed("base", f"{s}_base")), f"{s}_base", "left").withColumn(f"{s}_chain", F.col(f"{s}_steps") + F.coalesce("length", F.lit(0))).drop("length")
    ends = cut(found.groupBy("group").agg(F.min("rank").alias("low"), F.max("rank").alias("high")))
    joined = found.withColumnRenamed("group", "tsl_group").join(_few(ends), F.col("tsl_group").eqNullSafe(F.col("group")))
    low, high = F.coalesce(F.col("left_rank") + 1, F.col("low")), F.coalesce(F.col("right_rank") - 1, F.col("high"))
    size, before = high - low + 1, low - F.col("low")
    # the later of both neighbours; of equal orders the one with the higher key, on the right
    parent = F.when(F.col("right_inserted").isNull() | (F.col("left_inserted") > F.col("right_inserted")), F.col("left_key")).otherwise(F.col("right_key"))
    return joined.select(
        "group", "key", "inserted", parent.alias("parent"), (F.col("left_chain") + F.col("right_chain")).alias("depth"), size.alias("size"),
        (before + F.col("right_chain")).alias("pre"), (F.col("rank") - F.col("low")).alias("in_order"), (before - F.col("left_chain") + size - 1).alias("post"),
    )


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """(group, height, nodes, edges, root) of each tree."""
    return nodes.groupBy("group").agg(F.max("depth").alias("height"), F.count("*").alias("nodes"), (F.count("*") - 1).alias("edges"), F.max(F.when(F.col("depth") == 0, F.col("key"))).alias("root"))
