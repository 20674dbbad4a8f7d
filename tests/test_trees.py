"""Search trees against trees that are built."""

import random

import pytest

from tessella.operators import trees


def built(rows):
    """(key, inserted, parent, depth, size, pre, in_order, post) of the tree of (key, order)."""
    nodes, root = {}, None
    for key, order in sorted(rows, key=lambda r: (r[1], r[0])):
        if key in nodes:
            continue
        here, above = root, None
        while here is not None:
            above, here = here, nodes[here]["l" if key < here else "r"]
        nodes[key] = {"l": None, "r": None, "order": order, "up": above, "depth": 0 if above is None else nodes[above]["depth"] + 1}
        if above is None:
            root = key
        else:
            nodes[above]["l" if key < above else "r"] = key
    count = {"pre": 0, "in": 0, "post": 0}

    def number(kind, k):
        nodes[k][kind] = count[kind]
        count[kind] += 1

    todo = [(root, 0)] if root is not None else []
    while todo:
        k, state = todo.pop()
        if state == 0:
            number("pre", k)
            todo += [(k, 1)] + ([(nodes[k]["l"], 0)] if nodes[k]["l"] is not None else [])
        elif state == 1:
            number("in", k)
            todo += [(k, 2)] + ([(nodes[k]["r"], 0)] if nodes[k]["r"] is not None else [])
        else:
            number("post", k)
            nodes[k]["size"] = 1 + sum(nodes[c]["size"] for c in (nodes[k]["l"], nodes[k]["r"]) if c is not None)
    return sorted((k, n["order"], n["up"], n["depth"], n["size"], n["pre"], n["in"], n["post"]) for k, n in nodes.items())


def orders(kind, n, rng):
    keys = list(range(n))
    rng.shuffle(keys)
    return {
        "random": [(k, i) for i, k in enumerate(keys)],
        "rising": [(k, k) for k in range(n)],
        "falling": [(k, n - k) for k in range(n)],
        "saw": [(k, (k % 17) * 1000 - k) for k in range(n)],
        "valley": [(k, abs(k - n // 2)) for k in range(n)],
        "ties": [(rng.randrange(n), rng.randrange(5)) for _ in range(n)],
    }[kind]


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "saw", "valley", "ties"])
@pytest.mark.parametrize("block_rows", [7, 60, 10**6])
def test_nodes(spark, kind, block_rows):
    rows = orders(kind, 150, random.Random(block_rows))
    d = spark.createDataFrame(rows, "k int, o int")
    found = trees.tree_nodes(d, "k", "o", block_rows=block_rows).collect()
    assert sorted(tuple(r)[1:] for r in found) == built(rows)


def test_groups_nulls_and_metrics(spark):
    rng = random.Random(2)
    rows = [(g, f"k{rng.randrange(60):03}", i) for i in range(300) for g in [rng.choice(["a", "a", "a", "b", None, f"one {i % 9}"])]] + [("a", None, 1)]
    nodes = trees.tree_nodes(spark.createDataFrame(rows, "g string, k string, o long"), "k", "o", "g", block_rows=25)
    got = {}
    for r in nodes.collect():
        got.setdefault(r["group"], []).append(tuple(r)[1:])
    assert {g: sorted(v) for g, v in got.items()} == {g: built([(k, o) for h, k, o in rows if h == g and k is not None]) for g in {r[0] for r in rows}}
    for r in trees.tree_metrics(nodes).collect():
        own = got[r["group"]]
        assert (r.height, r.nodes, r.edges) == (max(x[3] for x in own), len(own), len(own) - 1) and r.root == next(x[0] for x in own if x[2] is None)


def test_empty(spark):
    assert trees.tree_nodes(spark.createDataFrame([(None, 1)], "k int, o int"), "k", "o").collect() == []
