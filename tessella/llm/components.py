"""Connected components: up to a checked number of edges by union-find in one executor task, beyond it by alternating
large and small stars, in DataFrame joins and aggregates.

A round is a few joins and partial aggregates on edges; a node with very many edges meets them in a join that adaptive
execution can split, never in one list. Each round is checkpointed, so lineage stays short and executors may be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


#: Up to so many edges (tens of MB at most), one task on an executor joins them faster than rounds of shuffles do.
MOST_LOCAL = 300_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges (a, b) of one task; the root of a tree is its least node."""
    parent: dict = {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for start in range(0, len(nodes), 10_000):
        part = nodes[start : start + 10_000]
        yield pd.DataFrame({"node": part, "label": [top(x) for x in part]})


def _toward_least(directed: DataFrame, keep_self: bool) -> DataFrame:
    """For edges (u, v): (v, m) with m the least of u and all its v; with keep_self also (u, m)."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = directed.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))) if keep_self else moved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60, most_local: int = MOST_LOCAL) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component. Nodes without edges
    are not listed; null ends and loops are ignored."""
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    if state[0] <= most_local:
        kind = edges.schema["a"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInPandas(_united, f"node {kind}, label {kind}"))
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: neighbours above u move to the least neighbour
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u itself, move to the least of them
        small = _toward_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keep_self=True)
        edges = cut(small.where("a <> b").distinct())
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))
