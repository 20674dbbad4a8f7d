"""Ranked lexical search of all documents for each item of a benchmark, by a dual tree.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A term that tf of a document's n
terms are scores w * ((10 ** 9 * tf) div (1000 * tf + 20 * m)); w grows with the term's rareness, m with the document's
length; all of it in whole numbers, see `weights` and `Searcher`. An item's documents are those with the highest sums over its
terms.

1. Documents are reduced, where they are read, to the terms that items have, with tf and n; this is written once.
   The counts that weights need (documents and terms in all, documents with each term) are sums over that table.
2. Items form a binary tree, divided so that items with common terms stay together. A node's coordinate maximum for a
   term is w if one of its items has the term.
3. The documents of a batch are put in order of the term that counts most in them, so related ones are neighbours, and
   form a tree of leaves and groups of groups. A node's coordinate maximum for a term is the most that it counts in one of
   its documents.
4. Both trees are searched together: for a node of documents and a node of items the sum of products of the maxima
   bounds the score of all pairs below. If it is less than the weakest k-th score that one of these items has so far,
   no pair below can enter a result and the whole batch of pairs is left out, which is exact. What is left in a leaf is
   scored. k-th scores start with those among some stored documents (`SEED` of them at least), which are reached among
   all documents too; any documents would do, and the result doesn't depend on them.
5. A task returns at most k rows an item; windows with a limit of k, which Spark applies before and after the shuffle,
   put the tasks together.

Items are taken in blocks of about `BLOCK_TERMS` terms, each of which is broadcast and searched in all documents, so
the broadcast is bounded and one block's lives at a time.

Defined cases: a null text has no terms; documents without terms count nowhere; items without terms, or whose terms no
document has, have no rows; items that repeat an id are one item with the terms of all, null ids included; documents
that repeat an id, or have none, are ranked each by its own text, null ids last among equal scores; equal scores by
ascending id; very long texts count whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, WordHasher, work_path

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII bytes that are neither letters nor digits separate terms.
BLANKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
#: Terms of the items of a block, an item is not divided.
BLOCK_TERMS = 100_000
#: Documents whose scores give the first bounds.
SEED = 20_000
#: Documents of a leaf, children of a node, and bytes of text that are cut into terms at once.
LEAF, FAN, PIECE = 8, 4, 1 << 20


# --- terms


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item."""
    lowered = F.translate(F.col("text"), UPPER, LOWERED)
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()


class Vocabulary:
    """Finds terms in texts: by 64-bit hashes first, then byte by byte."""

    def __init__(self, terms: list[str]):
        data = [t.encode("utf-8", "replace") for t in terms]
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.size = np.array([len(t) for t in data], np.int64)
        self.at = np.cumsum(self.size) - self.size
        joined = b" ".join(data)
        hashes = self._hashes(WordHasher(BLANKS), joined)[0]
        order = np.argsort(hashes)
        self.hashes, self.term = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two terms have one hash")
        bits = max(16, len(terms).bit_length() + 4)
        self.present = np.zeros(1 << bits, bool)
        self.present[hashes & np.uint64(len(self.present) - 1)] = True

    @staticmethod
    def _hashes(hasher: WordHasher, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, starts, ends = hasher.bounds(data)
        found = hasher.pieces(hasher.sums(raw), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(ends - starts > 64):  # as WordHasher does
            found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
        return found, raw, starts, ends

    def counted(self, hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms in all) of each text, and sorted by text and term: text, term, times."""
        data = b"\n".join(texts).translate(LOWER)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(length + 1) - length - 1
        hashes, raw, starts, ends = self._hashes(hasher, data)
        text = np.searchsorted(first, starts, "right") - 1
        n = np.bincount(text, minlength=len(texts))
        at = np.flatnonzero(self.present[hashes & np.uint64(len(self.present) - 1)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        term = self.term[place]
        same = (self.hashes[place] == hashes[at]) & (self.size[term] == (ends - starts)[at])
        at, term = at[same], term[same]
        if len(at):
            size = self.size[term]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wrong = raw[np.repeat(starts[at], size) + within] != self.bytes[np.repeat(self.at[term], size) + within]
            equal = np.add.reduceat(wrong, np.cumsum(size) - size) == 0
            at, term = at[equal], term[equal]
        key, times = np.unique(text[at] * len(self.size) + term, return_counts=True)
        return n, key // len(self.size), key % len(self.size), times


def vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, times) of the documents with terms, written to the shared folder and read back."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = held.value, WordHasher(BLANKS)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            piece = (np.cumsum(size) - size) // PIECE  # a longer text is a piece of its own
            for a, b in zip(cuts := np.flatnonzero(np.diff(piece, prepend=-1)), [*cuts[1:], len(texts)], strict=True):
                n, text, term, times = words.counted(hasher, texts[a:b])
                some = np.flatnonzero(n)
                ends = np.searchsorted(text, some, "right")
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(n[some]), *lists], ["doc_id", "n", "terms", "times"])

    path = work_path(spark, "terms")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>").write.parquet(path)
    return spark.read.parquet(path)


# --- items


@dataclass
class Items:
    """A block of items as a binary tree in pre-order: children of node i are i + 1 and other[i] (0: one item, item[i]). The
    terms of node i are terms[at[i]:at[i + 1]]."""

    ids: list
    words: list[str]
    parent: np.ndarray
    other: np.ndarray
    item: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    leaf: np.ndarray = field(init=False)  # of each item its node

    def __post_init__(self):
        self.leaf = np.zeros(len(self.ids), np.int64)
        nodes = np.flatnonzero(self.other == 0)
        self.leaf[self.item[nodes]] = nodes


def _halves(items: list[int], sets: list[set[int]]) -> tuple[list[int], list[int]]:
    """The items by which of two unlike ones they have more terms in common with."""
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    one = min(items, key=lambda i: like(items[0], i))
    two = min(items, key=lambda i: (like(one, i), i == one))
    left = [i for i in items if i == one or i != two and like(one, i) >= like(two, i)]
    right = [i for i in items if i not in set(left)]
    return (left, right) if left and right else (items[: len(items) // 2], items[len(items) // 2 :])


def item_tree(pairs: list[tuple[int | None, str]]) -> Items:
    """The tree of items (item_id, term). Terms are numbered in the order in which the tree's items have them."""
    by_item: dict = {}
    for i, t in pairs:
        by_item.setdefault(i, set()).add(t)
    ids = sorted(by_item, key=lambda i: (i is None, i or 0))
    number: dict[str, int] = {}
    for t in sorted({t for _, t in pairs}):
        number[t] = len(number)
    sets = [{number[t] for t in by_item[i]} for i in ids]
    parent, other, item = [], [], []
    waiting = [(list(range(len(ids))), -1, False)]
    groups: list[list[int]] = []
    while waiting:  # depth first, left before right
        own, above, right = waiting.pop()
        node = len(parent)
        if right:
            other[above] = node
        parent.append(above)
        other.append(0)
        item.append(own[0] if len(own) == 1 else -1)
        groups.append(own)
        if len(own) > 1:
            left, rest = _halves(own, sets)
            waiting += [(rest, node, True), (left, node, False)]
    renumbered: dict[int, int] = {}
    for own, i in zip(groups, item, strict=True):
        if i >= 0:
            for t in sorted(sets[own[0]]):
                renumbered.setdefault(t, len(renumbered))
    lists = [np.array(sorted({renumbered[t] for i in own for t in sets[i]}), np.int32) for own in groups]
    names = sorted(number, key=lambda t: renumbered[number[t]])
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return Items(ids, names, np.array(parent), np.array(other), np.array(item), np.concatenate(lists), at)


def weights(documents: int, having: np.ndarray) -> np.ndarray:
    """w of each term, from the documents that have it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in having], np.int64)


# --- search


class Searcher:
    """The k best documents of each item among those that `add` was given."""

    def __init__(self, items: Items, weight: np.ndarray, documents: int, terms: int, k: int, least: np.ndarray):
        self.items, self.weight, self.documents, self.total, self.k = items, weight, documents, terms, k
        self.least = least  # no document with a lower score is wanted
        self.heaps: list[list[tuple]] = [[] for _ in items.ids]
        self.kth = least.copy()
        self.weakest = np.zeros(len(items.parent), np.int64)
        for node in range(len(items.parent) - 1, -1, -1):
            self.weakest[node] = self.kth[items.item[node]] if not items.other[node] else min(self.weakest[node + 1], self.weakest[items.other[node]])
        self.node_weight = weight[items.terms]
        self.bounds = 0  # pairs of nodes that were compared, and pairs of document and item that were scored
        self.scored = 0

    def _entries(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the nodes' terms, and where each node's begin."""
        at = self.items.at
        size = at[nodes + 1] - at[nodes]
        begin = np.cumsum(size) - size
        return np.repeat(at[nodes] - begin, size) + np.arange(size.sum()), begin

    def _open(self, nodes: np.ndarray, dense: np.ndarray, depth: int) -> np.ndarray:
        """Of the nodes, or after `depth` steps their descendants, those whose bound with the maxima in dense reaches
        their weakest k-th score."""
        kept = []
        while len(nodes):
            entries, begin = self._entries(nodes)
            bound = np.add.reduceat(self.node_weight[entries] * dense[self.items.terms[entries]], begin)
            self.bounds += len(nodes)
            nodes = nodes[bound >= self.weakest[nodes]]
            inner = self.items.other[nodes] > 0
            if depth <= 0:
                kept.append(nodes)
                break
            kept.append(nodes[~inner])
            nodes = nodes[inner]
            nodes = np.concatenate([nodes + 1, self.items.other[nodes]])
            depth -= 1
        return np.concatenate(kept) if kept else nodes

    def _found(self, item: int, score: int, doc_id: int | None) -> None:
        heap = self.heaps[item]
        entry = (score, doc_id is not None, -(doc_id or 0), doc_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry[:3] > heap[0][:3]:
            heapq.heapreplace(heap, entry)
        else:
            return
        if len(heap) == self.k and heap[0][0] > self.kth[item]:
            self.kth[item] = heap[0][0]
            node = self.items.leaf[item]
            self.weakest[node] = heap[0][0]
            while (node := self.items.parent[node]) >= 0:
                low = min(self.weakest[node + 1], self.weakest[self.items.other[node]])
                if low == self.weakest[node]:
                    break
                self.weakest[node] = low

    def add(self, ids: list, n: np.ndarray, begin: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        """Documents: ids, terms in all, where each one's entries begin (and the end of the last), entries."""
        size = np.diff(begin)
        doc = np.repeat(np.arange(len(size)), size)
        m = 50 + 50 * n.astype(np.int64) * self.documents // self.total
        value = 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + 20 * m[doc])
        some = np.flatnonzero(size)
        if not len(some):
            return
        # in order of the term that counts most, then of length
        worth = self.weight[term] * value
        most = np.maximum.reduceat(worth, begin[some])
        heads = np.full(len(size), len(self.weight), np.int64)
        top = np.flatnonzero(worth == np.repeat(most, size[some]))
        np.minimum.at(heads, doc[top], term[top])
        rank = np.empty(len(size), np.int64)
        order = some[np.lexsort((n[some], heads[some]))]
        rank[order] = np.arange(len(order))
        place = rank[doc]
        sort = np.argsort(place, kind="stable")
        place, term, value = place[sort], term[sort].astype(np.int64), value[sort]
        # levels from documents up: node, term, maximum; of each level where nodes begin
        levels, node, group = [(np.searchsorted(place, np.arange(len(order) + 1)), term, value)], place, LEAF
        width = len(self.weight)
        while node[-1] > 0:
            key = node // group * width + term
            sort = np.argsort(key, kind="stable")
            key, value = key[sort], value[sort]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            node, term, value = key[new] // width, key[new] % width, np.maximum.reduceat(value, new)
            levels.append((np.searchsorted(node, np.arange(node[-1] + 2)), term, value))
            group = FAN
        if len(levels) == 1:
            levels.append((np.array([0, len(term)]), term, value))
        self._search(ids, order, levels)

    def _search(self, ids: list, order: np.ndarray, levels: list) -> None:
        dense = np.zeros(len(self.weight), np.int64)
        whole = np.zeros((LEAF, len(self.weight)), np.int64)
        waiting = [(len(levels) - 1, 0, np.zeros(1, np.int64))]
        while waiting:
            level, node, open_items = waiting.pop()
            begin, term, value = levels[level]
            own = slice(begin[node], begin[node + 1])
            dense[term[own]] = value[own]
            open_items = self._open(open_items, dense, 1 if level > 1 else 1 << 30)
            dense[term[own]] = 0
            if not len(open_items):
                continue
            if level > 1:
                last = len(levels[level - 1][0]) - 1
                waiting += [(level - 1, child, open_items) for child in range(min(last, node * FAN + FAN) - 1, node * FAN - 1, -1)]
                continue
            begin, term, value = levels[0]
            first, last = node * LEAF, min(len(order), node * LEAF + LEAF)
            own = slice(begin[first], begin[last])
            row = np.repeat(np.arange(last - first), np.diff(begin[first : last + 1]))
            whole[row, term[own]] = value[own]
            entries, start = self._entries(open_items)
            score = np.add.reduceat(whole[: last - first, self.items.terms[entries]] * self.node_weight[entries], start, axis=1)
            whole[row, term[own]] = 0
            self.scored += score.size
            item = self.items.item[open_items]
            for r, c in zip(*np.nonzero(score >= self.kth[item]), strict=True):
                self._found(int(item[c]), int(score[r, c]), ids[order[first + r]])

    def rows(self) -> pa.RecordBatch:
        found = [(self.items.ids[i], e[3], e[0]) for i, heap in enumerate(self.heaps) for e in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], pa.int64()) for j in range(3)], ["item_id", "doc_id", "score"])


def _searched(stored: DataFrame, items: Items, weight: np.ndarray, documents: int, terms: int, k: int, least: np.ndarray) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best stored documents with the least score or more."""
    held = stored.sparkSession.sparkContext.broadcast((items, weight, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(held.value[0], held.value[1], documents, terms, k, held.value[2])
        for batch in batches:
            lists, times = batch.column(2), batch.column(3)
            begin = lists.offsets.to_numpy().astype(np.int64)
            search.add(batch.column(0).to_pylist(), batch.column(1).to_numpy(), begin - begin[0], lists.flatten().to_numpy(), times.flatten().to_numpy())
        yield search.rows()

    found = stored.mapInArrow(run, "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: Items, k: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    stored = vectors(docs, Vocabulary(items.words))
    documents, terms = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(items.words), np.int64)
    for term, count in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a block's terms at most
        having[term] = count
    weight = weights(documents, having)
    least = np.ones(len(items.ids), np.int64)
    files = stored.inputFiles()
    some = files[: -(-len(files) * seed // max(1, documents))]
    if len(some) < len(files):
        place = {i: n for n, i in enumerate(items.ids)}
        for item_id, score in _searched(spark.read.parquet(*some), items, weight, documents, terms, k, least).where(F.col("rank") == k).select("item_id", "score").collect():
            least[place[item_id]] = score
    return _searched(stored, items, weight, documents, terms, k, least)


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, seed: int = SEED) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores over 0 of each item."""
    spark = docs.sparkSession
    path = work_path(spark, "items")
    item_terms(benchmark).write.parquet(path)
    pairs = spark.read.parquet(path)
    blocks = max(1, -(-pairs.count() // block_terms))
    out = work_path(spark, "ranked")
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if mine:
            _block(docs, item_tree([tuple(r) for r in mine]), k, seed).write.mode("append").parquet(out)
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.mode("append").parquet(out)  # so there is a table
    return spark.read.parquet(out)


OP13_SQL = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '{TERM}')) AS term FROM documents),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '{TERM}')) AS term FROM benchmark),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), c AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {K}"""


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
