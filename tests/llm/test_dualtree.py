"""Ranked search against a brute-force version."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import dualtree

TERM = re.compile(dualtree.TERM)
LOWER = str.maketrans(dualtree.UPPER, dualtree.LOWERED)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, t) for i, t in bags if t]
    n, total = len(bags), sum(len(t) for _, t in bags)
    df = {}
    for _, t in bags:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for doc_id, t in bags:
            m = 50 + 50 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in own if x in df)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(i, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(['a', 'b', 'é', 'ß', '中'])}{int(rng.paretovariate(0.7)) % 400}"
    docs = [" ".join(word() for _ in range(rng.choice([1, 5, 30, 80]))) for _ in range(n)]
    docs[3:10] = ["", None, "  ... ", "x" * 100 + " a1", "A1 É1 é1-a1_A1", docs[20], docs[20]]
    docs[11] = " ".join(word() for _ in range(30_000))
    items = [" ".join(rng.choice(docs[20:]).split()[:12]) for _ in range(30)] + ["", None, "zzz", "x" * 100, docs[40], docs[40]]
    return list(enumerate(docs)), list(enumerate(items))


@pytest.mark.parametrize("k, block_terms, seed", [(50, 100_000, 20_000), (5, 40, 60), (1, 100_000, 1)])
def test_ranked(spark, k, block_terms, seed):
    docs, items = corpus(k)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(6)
    found = dualtree.ranked(d, spark.createDataFrame(items, "item_id long, text string"), k, block_terms, seed)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_null_and_repeated_ids(spark):
    docs = [(None, "a b"), (None, "a b"), (2, "a b"), (2, "a"), (2, "a b"), (1, "c"), (7, "b")]
    items = [(None, "a"), (None, "b"), (5, "b c"), (5, "a")]
    found = dualtree.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 4)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for d in (none, some):
        for b in (none, some):
            found = dualtree.ranked(d, b.withColumnRenamed("doc_id", "item_id")).collect()
            assert len(found) == (d is some and b is some)


def test_batches_of_pairs_are_left_out():
    """Related documents lie together, so most pairs of groups need no look; the result is that of all pairs."""
    rng = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(60)] for k in range(20)]
    docs = [[rng.choice(topics[i % 20]) for _ in range(40)] for i in range(2000)]
    items = [(i, w) for i in range(40) for w in set(rng.choices(topics[i % 20], k=12))]
    tree = dualtree.item_tree(items)
    number = {t: j for j, t in enumerate(tree.words)}
    own = [sorted((number[w], d.count(w)) for w in set(d) if w in number) for d in docs]
    begin = np.cumsum([0] + [len(x) for x in own])
    having = np.bincount([t for x in own for t, _ in x], minlength=len(number))
    search = dualtree.Searcher(tree, dualtree.weights(2000, having), 2000, 80_000, 10, np.ones(40, np.int64))
    search.add(list(range(2000)), np.full(2000, 40), begin, np.array([t for x in own for t, _ in x]), np.array([c for x in own for _, c in x]))
    got = search.rows().to_pydict()
    want = brute([(i, " ".join(d)) for i, d in enumerate(docs)], [(i, w) for i, w in items], 10)
    assert sorted(zip(got["item_id"], got["doc_id"], got["score"], strict=True)) == sorted((i, d, s) for i, _, d, s in want)
    assert search.bounds + search.scored < 2000 * 40 / 4


def test_tree_of_items():
    pairs = [(i, f"w{j}") for i in range(50) for j in range(i % 5 * 10, i % 5 * 10 + 8)] + [(None, "w1")]
    tree = dualtree.item_tree(pairs)
    assert len(tree.ids) == 51 and sorted(tree.item[tree.other == 0].tolist()) == list(range(51))
    for node in range(len(tree.parent)):
        own = set(tree.terms[tree.at[node] : tree.at[node + 1]].tolist())
        if tree.other[node]:
            a, b = node + 1, tree.other[node]
            assert tree.parent[a] == tree.parent[b] == node
            assert own == set(tree.terms[tree.at[a] : tree.at[a + 1]].tolist()) | set(tree.terms[tree.at[b] : tree.at[b + 1]].tolist())
        else:
            assert {tree.words[t] for t in own} == {t for i, t in pairs if i == tree.ids[tree.item[node]]}
