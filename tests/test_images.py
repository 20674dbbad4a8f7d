"""Image operations against loops over pixels."""

import numpy as np
import pytest

from tessella.operators import images


def rows(spark, *arrays):
    return spark.createDataFrame([(k, x, y, int(a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])], "k int, x int, y int, v int")


def grids(df, *shapes):
    out = [np.zeros(s, int) for s in shapes]
    for r in df.collect():
        out[r.k][r.y, r.x] = r.v
    return out


def given(seed, *shapes):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, s) for s in shapes]


SHAPES = ((1, 1), (3, 9), (7, 4))


@pytest.mark.parametrize("size", [1, 3, 7, 21])
def test_boxes(spark, size):
    a, r = given(size, *SHAPES), size // 2
    for f, kind in ((np.mean, "blur"), (np.max, "dilate"), (np.min, "erode")):
        df = images.average_blur(rows(spark, *a), "k", size) if kind == "blur" else images.morph(rows(spark, *a), "k", kind, size)
        for g, m in zip(grids(df, *SHAPES), a, strict=True):
            for y, x in np.ndindex(m.shape):
                assert g[y, x] == int(f(m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]))
    with pytest.raises(ValueError):
        images.average_blur(rows(spark, *a), "k", 4)


def test_gaussian_threshold(spark):
    a = given(2, *SHAPES)
    w = np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.1**2))
    for g, m in zip(grids(images.adaptive_threshold(rows(spark, *a), "k", 5, kind="gaussian"), *SHAPES), a, strict=True):
        for y, x in np.ndindex(m.shape):
            near = [(m[y + j, x + i], w[i + 2] * w[j + 2]) for i in range(-2, 3) for j in range(-2, 3) if 0 <= y + j < m.shape[0] and 0 <= x + i < m.shape[1]]
            mean = sum(v * q for v, q in near) / sum(q for _, q in near)
            assert abs(m[y, x] - mean + 2) < 1e-9 or g[y, x] == (255 if m[y, x] > mean - 2 else 0)


def labelled(m, diagonal):
    """The least place of each pixel's area, by filling."""
    out, steps = {}, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    for y, x in np.ndindex(m.shape):
        if m[y, x] and (x, y) not in out:
            todo = [(x, y)]
            out[x, y] = (y, x)
            while todo:
                a, b = todo.pop()
                for i, j in steps:
                    if 0 <= a + i < m.shape[1] and 0 <= b + j < m.shape[0] and m[b + j, a + i] and (a + i, b + j) not in out:
                        out[a + i, b + j] = (y, x)
                        todo.append((a + i, b + j))
    return out


SPIRAL = np.array([[int(c) for c in row] for row in ("1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111")])


@pytest.mark.parametrize("diagonal", [False, True])
def test_areas(spark, diagonal):
    a = [np.where(m > 140, m, 0) for m in given(4, (9, 9), (5, 14))] + [SPIRAL, np.zeros((2, 2), int)]
    got = {(r.k, r.x, r.y): tuple(r.area) for r in images.areas(rows(spark, *a), "k", diagonal).collect()}
    assert got == {(k, *p): area for k, m in enumerate(a) for p, area in labelled(m, diagonal).items()}


def test_weak_edges_stay_with_strong_ones(spark):
    a = np.zeros((9, 12), int)
    a[:, 6:] = (90 - 7 * np.arange(9))[:, None]  # one line, strong above and weak below
    b = np.zeros((9, 12), int)
    b[:, 6:] = 30  # weak alone
    found = grids(images.canny(rows(spark, a, b), "k", 100, 300), a.shape, b.shape)
    assert found[0][7].sum() == 255 and found[0][1].sum() == 255 and not found[1].any()
    assert (grids(images.canny(rows(spark, a), "k", 100, 300), a.shape)[0] > 0).sum() < (grids(images.edges(rows(spark, a), "k", 100), a.shape)[0] > 0).sum()


def test_clahe(spark):
    flat, ramp = np.full((8, 8), 77), np.arange(64).reshape(8, 8) + 100
    one, two = grids(images.clahe(rows(spark, flat, ramp), "k", 40.0, 1), flat.shape, ramp.shape)
    assert len(set(one.ravel())) == 1
    assert (np.diff(two.ravel()) >= 0).all() and two.max() > 240 and two.max() - two.min() > 200  # the contrast is spread
    odd = grids(images.clahe(rows(spark, *given(5, (5, 7))), "k", 4.0, 3), (5, 7))[0]
    assert odd.min() >= 0 and odd.max() <= 255
