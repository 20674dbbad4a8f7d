"""What several operators share: the shared work folder, checkpoints, words and 64-bit hashes."""

from __future__ import annotations

import ctypes
import functools
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import cut, work_root  # noqa: F401  the operators take cut from here

#: A-Z to a-z on bytes; other bytes stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


#: A table of keys up to so many rows (tens of MB) may be broadcast.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, already cut, marked for broadcast if it has at most so many rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns memory that this process has freed to the system: Arrow's, and on Linux that of malloc."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, with its memory given back at its end: Spark keeps the workers of a task for later
    tasks, and several idle ones would hold their largest size besides those at work."""

    @functools.wraps(run)
    def leanly(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return leanly


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def words(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes after lower-casing A-Z (bytes.split() has exactly these separators)."""
    return data.translate(LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (murmur3's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes that separate words: space and \\t to \\r. Another table may be given.
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15  # odd, and 1 minus it has few factors of two
_LONG = 64


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


class WordHasher:
    """64-bit hashes of all words of a text, computed over the whole byte array at once.

    A word's hash is a polynomial in its bytes, from differences of prefix sums; words over 64 bytes, for which
    such a hash is weak against crafted inputs, are hashed one by one."""

    def __init__(self, blanks: np.ndarray = BLANKS):
        self.blanks = blanks
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.powers = _powers(_BASE, n)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends) of the words."""
        raw = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~self.blanks[raw]
        edge = np.diff(inside)
        return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.powers):
            self.grow(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def pieces(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, data: bytes) -> np.ndarray:
        raw, starts, ends = self.bounds(data)
        if not len(starts):
            return np.zeros(0, np.uint64)
        out = self.pieces(self.sums(raw), starts, ends)
        for i in np.flatnonzero(ends - starts > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
        return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole sequence if it has fewer words; empty without words.

    A polynomial in the mixed words of a run, put together from those of runs of 1, 2, 4, ... words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    total = np.full(count, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    runs, size, done = mix(hashes), 1, 0
    while size <= n:
        power = np.uint64(pow(0x2545F4914F6CDD1D, size, 1 << 64))
        if n & size:
            total = total * power + runs[done : done + count]
            done += size
        if 2 * size <= n:
            runs = runs[:-size] * power + runs[size:]
        size *= 2
    return mix(total)
