"""Word self-similarity of texts: which pairs of places of a word also share neighbours.

For places i and j of a word and distances w of 1 and 2, the strength of (i, j) grows by 63 if j + w (and, except for
place 0, j - w) holds the same word as j, and by 63 if i + w and j + w (or i - w and j - w) hold the same word. Pairs
with any strength count; the diagonal always does, with strength 252.

Pairs lie within a text, so nothing is joined: texts are dealt out with ranges of their places i, long ones as several rows, and
each row finds its pairs by (word, neighbour), not by word alone, so frequent words meet only places with the same context; places
whose own neighbour repeats the word are met by word, and there are few. Totals need no pairs: group sizes give their numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessella.functions.lazy import lazy_pandas_udf

STEP = 63
#: Pairs by one neighbour that a row's places have, and that are put together at once, but for the last place; bytes of texts that are.
ROW_PAIRS, MOST_PAIRS, MOST_BYTES = 1 << 21, 1 << 18, 1 << 20


def _words(lowered: str) -> list[str]:
    """Words `[a-z']+`, empty ends included."""
    return re.split(r"[^a-z']+", lowered)


class _Places:
    """The places of some texts, one text after the other. `met` has the places, and for each the run of `others` that share
    its word and one neighbour (or its word, if theirs repeats it), itself included."""

    def __init__(self, texts: list[list[str]]):
        ids, here = [], 0
        for words in texts:  # a word has another number in each text
            known: dict[str, int] = {}
            ids += [here + known.setdefault(w, len(known)) for w in words]
            here += len(known)
        self.first = np.cumsum([0] + [len(words) for words in texts])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        word = np.array(ids, np.int64)
        self.at = np.arange(len(word)) - self.first[self.text]
        left = np.diff(self.first)[self.text] - self.at  # places from this one to the end
        self.own, self.met, self.pairs = np.zeros(len(word), np.int64), [], np.zeros(len(word), np.int64)
        # place 0 is nobody's neighbour to the left
        for step, there in ((1, left > 1), (2, left > 2), (-1, self.at > 1), (-2, self.at > 2)):
            here = np.flatnonzero(there)
            self.own[here] += word[here] == word[here + step]
            self._meet(here, here, word * len(word) + np.roll(word, -step), False)
        self._meet(np.arange(len(word)), np.flatnonzero(self.own), word, True)

    def _meet(self, places: np.ndarray, others: np.ndarray, group: np.ndarray, repeated: bool) -> None:
        """Each of the places meets the others of its group."""
        others = others[np.argsort(group[others], kind="stable")]
        low, high = (np.searchsorted(group[others], group[places], side) for side in ("left", "right"))
        some = high - low > (0 if repeated else 1)
        places, low, n = places[some], low[some], (high - low)[some]
        self.met.append((places, low, n, others, repeated))
        self.pairs[places] += n

    def keep(self, wanted: np.ndarray) -> None:
        """Only these places meet others from now on."""
        self.met = [(places[w := wanted[places]], low[w], n[w], *rest) for places, low, n, *rest in self.met]
        self.pairs[~wanted] = 0

    def between(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, strength) of the places from start to end, which may belong to several texts."""
        found = []
        for places, low, n, others, repeated in self.met:
            a, b = np.searchsorted(places, (start, end))
            i, n = np.repeat(places[a:b], n[a:b]), n[a:b]
            j = others[np.arange(len(i)) + np.repeat(low[a:b] - np.cumsum(n) + n, n)]
            times = self.own[j] if repeated else 1
            found.append((((i - start) * len(self.at) + j) * 8 + times)[i != j])
        pairs = np.sort(np.concatenate(found))
        new = np.flatnonzero(np.diff(pairs >> 3, prepend=-1))
        strength = STEP * np.add.reduceat(pairs & 7, new) if len(new) else new
        i, j = np.divmod(pairs[new] >> 3, len(self.at))
        return i + start, j, strength


def _ranges(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of places, or of texts, whose sizes are up to `most` together before the last one."""
    part = (np.cumsum(sizes) - sizes) // most
    ends = [*np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """The words of texts, as many as are held at once, and the number of the first."""
    for a, b in _ranges(pc.binary_length(column).to_numpy(zero_copy_only=False), MOST_BYTES):
        yield a, [_words(text) for text in column.slice(a, b - a).to_pylist()]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, text, low, high) for each range of a text's places."""
    for batch in batches:
        rows, ranges = [], []
        for first, texts in _texts(batch.column(1)):
            for row, words in enumerate(texts, first):
                found = [(0, len(words))] if 5 * len(words) ** 2 <= ROW_PAIRS else _ranges(_Places([words]).pairs, ROW_PAIRS)
                rows += [row] * len(found)
                ranges += found
        rows, ranges = np.array(rows, np.int64), np.array(ranges, np.int64).reshape(-1, 2)
        # long texts have many ranges
        for a, b in _ranges(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)[rows], MOST_BYTES):
            held = batch.take(pa.array(rows[a:b]))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(ranges[a:b, 0]), pa.array(ranges[a:b, 1])], [*batch.schema.names, "low", "high"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high = (c.to_numpy() for c in batch.columns[2:])
        for first, texts in _texts(batch.column(1)):
            held = _Places(texts)
            row = first + held.text
            held.keep((held.at >= low[row]) & (held.at < high[row]))
            for start, end in _ranges(held.pairs, MOST_PAIRS):
                i, j, strength = held.between(start, end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[i])), pa.array(held.at[i], pa.int32()), pa.array(held.at[j], pa.int32()), pa.array(strength, pa.int64())],
                    [batch.schema.names[0], "i", "j", "strength"],
                )


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, j, strength) of all pairs i <> j with any strength. Rows that share a key are texts of their own; those without
    a key have no pairs."""
    held = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.lower(text).alias("tsl_text"))
    ranged = StructType([*held.schema.fields, StructField("low", LongType()), StructField("high", LongType())])
    pairs = StructType([held.schema[0], StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("strength", LongType())])
    # a small file is one task, whatever its pairs
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.mapInArrow(_dealt, ranged).repartition(n, key, "low").mapInArrow(_paired, pairs)


def _total(words: list[str]) -> tuple[int, int]:
    """(number of words, summed strength): a group of n places with one word and neighbour has n (n - 1) pairs."""
    known, near, own = Counter(words), 0, 0
    # neighbours one and two to the right, then to the left, where place 0 is no neighbour
    for here, there in ((words, words[1:]), (words, words[2:]), (words[2:], words[1:]), (words[3:], words[1:])):
        for (word, other), n in Counter(zip(here, there)).items():
            near += n * (n - 1)
            if word == other:
                own += n * (known[word] - 1)
    return len(words), STEP * (near + own)


@lazy_pandas_udf("struct<n_words:bigint,strength:bigint>")
def _totals(lowered: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_total(_words(t)) for t in lowered], columns=["n_words", "strength"])


def similarity_totals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, strength) of each row with a text: the sum of similar_pairs' strengths within the text, in linear
    time, as group sizes give the numbers of pairs. Rows that share a key are texts of their own."""
    rows = docs.where(F.col(text).isNotNull()).select(key, _totals(F.lower(text)).alias("tsl_total"))
    return rows.select(key, "tsl_total.n_words", "tsl_total.strength")


def cell_size(n_words) -> Column:
    return F.ceil(F.lit(800) / n_words)


def opacity(strength) -> Column:
    """252 - strength; may be negative."""
    return F.lit(252) - strength


