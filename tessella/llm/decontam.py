"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive word positions; only the marked positions enter the hash, so a substituted
word at an unmarked position does not hide a match. Masks of the benchmark's items are hashed and sorted; the words of
every training document are hashed with the same masks and joined by binary search. A hit fixes a document, an item
and a diagonal (document position minus item position). Along the diagonal, equal words are counted over the whole
part that overlaps the item; the best segment (+1 for an equal word, -2 for another) is the verified overlap.

The benchmark's hashes are broadcast in blocks of at most `block_words` words: a larger benchmark is dealt by item into
several blocks and the corpus is read once per block, so the broadcast stays bounded however large the benchmark is.

Words are runs of letters, digits and non-ASCII characters after lower-casing, so case and ASCII punctuation don't hide
a leak; other punctuation changes single words, which the masks tolerate.

Defined cases: null or empty texts and items match nothing; items with fewer words than the shortest mask are matched
by their whole word sequence; repeated rows and repeated items count each; empty tables give empty results; documents
with a null id keep it, and `remove_leaks` decides on each row by its text, so null and repeated ids make no difference
there; very long texts are scanned whole; extra columns are ignored, or kept by `remove_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHasher, lean, mix

#: Marked positions. The first two allow a substitution in any one place of seven words, the last is for short items.
MASKS = ("11101101", "1101011011", "111101")
#: ASCII bytes that are neither letters nor digits separate words.
BLANKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LEAKS = "doc_id long, item_id long, start_word long, end_word long, matched_words long, item_words long, identity double, coverage double"


def word_hashes(hasher: WordHasher, text: str | None) -> np.ndarray:
    return hasher((text or "").lower().encode("utf-8", "replace"))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash per position at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0]
    total = np.full(n, np.uint64(len(mask)), np.uint64)
    for i, kept in enumerate(mask):
        if kept == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


@dataclass
class Items:
    """A block of the benchmark: word hashes of items, and sorted seed hashes with item and position."""

    ids: list
    words: list[np.ndarray]
    seeds: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]
    present: np.ndarray  # by the low bits of a hash: whether any seed has them


def index_items(rows: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS) -> Items:
    hashes, ids, words = WordHasher(BLANKS), [], []
    for item_id, text in rows:
        found = word_hashes(hashes, text)
        if len(found):
            ids.append(item_id)
            words.append(found)
    seeds = []
    shortest = min(map(len, masks))
    for mask in [*masks, *sorted({"1" * len(w) for w in words if len(w) < shortest})]:
        own = [(seed_hashes(w, mask), i) for i, w in enumerate(words) if len(w) >= shortest or len(w) == len(mask)]
        if not (count := sum(len(h) for h, _ in own)):
            continue
        value = np.concatenate([h for h, _ in own])
        item = np.concatenate([np.full(len(h), i, np.int64) for h, i in own])
        place = np.concatenate([np.arange(len(h), dtype=np.int64) for h, _ in own])
        order = np.argsort(value, kind="stable")
        assert len(value) == count
        seeds.append((mask, value[order], item[order], place[order]))
    bits = max(16, sum(len(v) for _, v, _, _ in seeds).bit_length() + 5)
    present = np.zeros(1 << bits, bool)
    for _, value, _, _ in seeds:
        present[value & np.uint64(len(present) - 1)] = True
    return Items(ids, words, seeds, present)


def best_segment(equal: np.ndarray, penalty: int = 2) -> tuple[int, int, int]:
    """(start, end, equal words) of the segment with the largest sum of +1 and -penalty; the first of those."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.argmin(total[:end]))
    return start, end, int(equal[start:end].sum())


def _diagonals(at: np.ndarray, low: np.ndarray, value: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The different (item, diagonal) of seeds at places `at` of a document, whose entries in the sorted index begin at `low`.
    A repeated word makes pairs by the product of its places in document and item, but no more diagonals than by their
    sum: such pairs aren't listed, their diagonals are those at which both sets of places correlate."""
    out = []
    order = np.argsort(low, kind="stable")
    at, low = at[order], low[order]
    first = np.flatnonzero(np.diff(low, prepend=-1))
    for hits, begin in zip(np.split(at, first[1:]), low[first].tolist(), strict=True):
        end = begin + int(np.searchsorted(value[begin:], value[begin], "right"))
        held, split = np.unique(item[begin:end], return_index=True)
        for i, places in zip(held.tolist(), np.split(place[begin:end], split[1:]), strict=True):
            reach = int(hits[-1] - hits[0] + places[-1] - places[0]) + 1
            if len(hits) * len(places) <= 8 * reach:
                shift = np.unique(hits[:, None] - places[None, :])
            else:
                size = 1 << reach.bit_length()
                one, two = np.zeros(size), np.zeros(size)
                one[hits - hits[0]], two[places[-1] - places] = 1, 1
                shift = hits[0] - places[-1] + np.flatnonzero(np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size)[:reach] > 0.5)
            out.append(np.stack([np.full(len(shift), i), shift], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def scan(words: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, equal words, words of the item) of the best overlap of a document with each item it hits; of equal
    ones that of the lowest diagonal."""
    found, few = [], np.uint64(len(items.present) - 1)
    for mask, value, item, place in items.seeds:
        own = seed_hashes(words, mask)
        at = np.flatnonzero(items.present[own & few])
        if not len(at):
            continue
        low = np.searchsorted(value, own[at], "left")
        there = np.searchsorted(value, own[at], "right") > low
        if there.any():
            found.append(_diagonals(at[there], low[there], value, item, place))
    best: dict[int, tuple[int, int, int, int, int]] = {}
    if not found:
        return []
    pairs = np.unique(np.concatenate(found), axis=0)
    size = np.array([len(items.words[i]) for i in pairs[:, 0]])
    overlap = np.minimum(len(words), pairs[:, 1] + size) - np.maximum(0, pairs[:, 1])
    shifts: dict[int, int] = {}
    # the longest first: where no more words overlap than are equal elsewhere, nothing better is found
    for j in np.lexsort((pairs[:, 1], -overlap)).tolist():
        i, shift = pairs[j].tolist()
        if i in best and (overlap[j], -shift) < (best[i][3], -shifts[i]):
            continue
        own = items.words[i]
        a, b = max(0, shift), min(len(words), shift + len(own))
        start, end, equal = best_segment(words[a:b] == own[a - shift : b - shift])
        if i not in best or (equal, -shift) > (best[i][3], -shifts[i]):
            best[i], shifts[i] = (i, a + start, a + end, equal, len(own)), shift
    return [best[i] for i in sorted(best)]


@dataclass(frozen=True)
class Limits:
    """A verified overlap is a leak if it has at least `words` equal words (or all words of a shorter item), that share
    of equal words, and that share of the item's words."""

    words: int = 10
    identity: float = 0.75
    coverage: float = 0.5

    def leaks(self, words: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
        found = scan(words, items) if len(words) else []
        return [x for x in found if x[3] >= min(self.words, x[4]) and x[3] >= self.identity * (x[2] - x[1]) and x[3] >= self.coverage * x[4]]


def indexed(benchmark: DataFrame, block_words: int = 2_000_000, masks: tuple[str, ...] = MASKS) -> Iterator[Broadcast]:
    """The benchmark in blocks of at most about block_words words, each indexed and broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # an item of n characters has at most (n + 1) / 2 words
    total = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    blocks = int(total // block_words) + 1
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast(index_items([tuple(r) for r in mine.collect()], masks))


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), block_words: int = 2_000_000, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row per document and item whose verified overlap is a leak: LEAKS."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexed(benchmark, block_words, masks):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            hashes, held = WordHasher(BLANKS), index.value
            names = [x.split()[0] for x in LEAKS.split(", ")]
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                    for i, start, end, equal, size in limits.leaks(word_hashes(hashes, text if isinstance(text, str) else None), held):
                        rows.append((None if pd.isna(doc_id) else int(doc_id), held.ids[i], start, end, equal, size, equal / (end - start), equal / size))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = source.mapInPandas(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def _leaking(index: Broadcast, limits: Limits):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, held = WordHasher(BLANKS), index.value
        for texts in batches:
            yield pa.array([bool(limits.leaks(word_hashes(hashes, t.as_py()), held)) for t in texts], pa.bool_())

    return F.arrow_udf(lean(run), "boolean")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), block_words: int = 2_000_000, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """The rows of docs whose texts hold no benchmark item. Each row is decided where it is read: nothing is shuffled."""
    for index in indexed(benchmark, block_words, masks):
        docs = docs.where(~_leaking(index, limits)(F.col("text")))
    return docs


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
