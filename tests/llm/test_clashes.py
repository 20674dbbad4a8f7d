"""Columns of users that are named like helper columns, repeated words, repeated ids."""

import random
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, exact, jaccard, mixing, toxicity
from tessella.llm.common import unused

NAMES = ["__source", "__size", "__key", "__copies", "__copy", "__verdict", "__gone", "__again", "__fp", "__id", "__own", "row", "whole", "label", "fp", "digest", "target"]


def clashing(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def stages():
    labels = lambda spark: spark.createDataFrame([(i, 0, int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    return {
        "mixed": lambda d: mixing.mixed(d),
        "one_of_each": lambda d: jaccard.one_of_each(d),
        "remove_leaks": lambda d: decontam.remove_leaks(d, d.sparkSession.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")),
        "without_copies": lambda d: exact.without_copies(d),
        "keep_clean": lambda d: toxicity.keep_clean(d, toxicity.fit(d, labels(d.sparkSession)), 2.0),
    }


@pytest.mark.parametrize("name", list(stages()))
def test_names_of_users_pass(spark, name):
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(60)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(3, texts[3], "s0"), (4, "other " + texts[9], "s1"), (None, texts[5], None), (None, None, "s2")]
    d = clashing(spark, rows)
    out = stages()[name](d)
    assert out.columns == d.columns
    got = out.collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in NAMES)
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(rows)


def test_unused(spark):
    assert unused(spark.range(1), "ID") == "ID_" and unused(spark.range(1), "x") == "x"


def plain_scan(words, items):
    """Every diagonal that a seed hits, one by one."""
    best = {}
    for mask, value, item, place in items.seeds:
        for at, h in enumerate(decontam.seed_hashes(words, mask).tolist()):
            for e in np.flatnonzero(value == np.uint64(h)):
                best.setdefault(int(item[e]), set()).add(at - int(place[e]))
    out = []
    for i, shifts in sorted(best.items()):
        top = None
        for shift in sorted(shifts):
            own = items.words[i]
            a, b = max(0, shift), min(len(words), shift + len(own))
            start, end, equal = decontam.best_segment(words[a:b] == own[a - shift : b - shift])
            if top is None or equal > top[3]:
                top = (i, a + start, a + end, equal, len(own))
        out.append(top)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_scan_of_repeated_words(seed):
    rng = random.Random(seed)
    vocabulary = seed % 3 + 1
    items = decontam.index_items([(k, prose(rng, rng.choice([5, 20, 60]), vocabulary)) for k in range(4)] + [(9, "w0 " * 80)])
    hasher = decontam.WordHasher(decontam.BLANKS)
    for n in (0, 3, 50, 300):
        words = decontam.word_hashes(hasher, prose(rng, n, vocabulary) + " w0" * (n // 2))
        assert decontam.scan(words, items) == plain_scan(words, items)


def test_one_word_over_and_over():
    items = decontam.index_items([(1, "again " * 2000)])
    words = decontam.word_hashes(decontam.WordHasher(decontam.BLANKS), "again " * 20_000)
    decontam.scan(words[:100], items)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    assert decontam.scan(words, items) == [(0, 0, 2000, 2000, 2000)]
    assert time.process_time() - began < 1 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
