"""Transforms of signals that no row holds: a signal is a matrix of about sqrt(n) lines, whose columns are transformed, turned and
transformed by lines. What is shuffled are pieces of a few kB, and a task holds one block of columns or of lines at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Columns, and lines, of a block; samples that are packed at once, and of a piece.
BLOCK, MOST_SAMPLES, PIECE = 16, 1 << 18, 512


def shape(n: int) -> tuple[int, int]:
    """(lines, columns) of a signal of n samples, a power of two."""
    lines = 1 << (n.bit_length() - 1) // 2
    return lines, n // lines


@lru_cache(maxsize=64)
def _turns(half: int) -> np.ndarray:
    return np.exp(np.arange(half) * (-1j * math.pi / half))[:, None]


def transform(z: np.ndarray) -> np.ndarray:
    """The discrete Fourier transform of each column, of a power of two numbers: log n stages of butterflies, which leave
    frequencies in order."""
    lines, half = z.shape[0], z.shape[0] // 2
    while half:
        a, b = z.reshape(2, half, -1)
        z = np.stack([a + b, (a - b) * _turns(half)], axis=1)
        half //= 2
    return z.reshape(lines, -1)


def _pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    signals = table.column("signal").combine_chunks()
    number, n, i, v = (table.column(c).to_numpy() for c in ("number", "n", "i", "v"))
    sizes, at = np.unique(n, return_inverse=True)
    block = (i % np.array([shape(int(x))[1] for x in sizes])[at]) // BLOCK
    order = np.lexsort((block, number))
    number, n, block, i, v = (x[order] for x in (number, n, block, i, v))
    ends = [*np.flatnonzero(np.diff(number) | np.diff(block)) + 1, len(i)]
    cuts = [(a, min(a + PIECE, end)) for start, end in zip([0, *ends[:-1]], ends, strict=True) for a in range(start, end, PIECE)]
    first = np.array([a for a, _ in cuts])
    columns = [pa.array(number[first]), signals.take(pa.array(order[first])), pa.array(n[first]), pa.array(block[first]), pa.array([i[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["number", "signal", "n", "block", "at", "z"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, signal, n, i, v) as pieces (number, signal, n, block, at, z): places and values of a block of columns."""
    held = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= MOST_SAMPLES:
            yield _pieces(held)
            held = []
    if held:
        yield _pieces(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, int, int, list, list]]:
    """(number, signal, n, block, at, z) of pieces in order of number and block: a block each, with all of its pieces."""
    known, at, z = None, [], []
    for batch in batches:
        for row, (number, n, block, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("number", "n", "block", "at", "z")), strict=True)):
            if known and (known[0], known[3]) != (number, block):
                yield *known, at, z
                known, at, z = None, [], []
            # a copy, as a slice would keep its batch
            known = known or (number, batch.column("signal").take(pa.array([row])), n, block)
            at.append(a)
            z.append(b)
    if known:
        yield *known, at, z


def by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of blocks of columns as pieces of blocks of lines, turned; `at` is the block of columns then."""
    for number, signal, n, block, at, v in _blocks(batches):
        lines, columns = shape(n)
        first, width = block * BLOCK, min(BLOCK, columns)
        i, v = np.frombuffer(b"".join(at), np.int64), np.frombuffer(b"".join(v))
        z, seen = np.zeros((lines, width), complex), np.zeros((lines, width), bool)
        place = i // columns, i % columns - first
        z[place], seen[place] = v, True
        if seen.sum() < len(i):
            raise ValueError(f"signal {signal[0]} has a place more than once")
        z = transform(z) * np.exp(np.outer(np.arange(lines), np.arange(first, first + width)) * (-2j * math.pi / n))
        cells = [z[k : k + BLOCK].tobytes() for k in range(0, lines, BLOCK)]
        m = len(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number] * m), signal.take(pa.array([0] * m)), pa.array([n] * m), pa.array(range(m), pa.int64()), pa.array([block] * m), pa.array(cells, pa.binary())],
            ["number", "signal", "n", "block", "at", "z"],
        )


def by_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signal, k, re, im) of pieces of blocks of lines; blocks of columns without samples are missing and count as 0."""
    for _, signal, n, block, at, cells in _blocks(batches):
        lines, columns = shape(n)
        first, height, width = block * BLOCK, min(BLOCK, lines), min(BLOCK, columns)
        z = np.zeros((columns, height), complex)
        for a, cell in zip(at, cells, strict=True):
            z[a * BLOCK : a * BLOCK + width] = np.frombuffer(cell, complex).reshape(height, width).T
        z = transform(z)
        k = np.arange(first, first + height) + lines * np.arange(columns)[:, None]
        yield pa.RecordBatch.from_arrays(
            [signal.take(pa.array(np.zeros(z.size, np.int64))), pa.array(k.ravel()), pa.array(z.real.ravel()), pa.array(z.imag.ravel())],
            ["signal", "k", "re", "im"],
        )
