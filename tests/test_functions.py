"""Worked examples, round trips, and brute-force versions of the functions without SQL."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import arrays, numbers, strings
from tessella.operators import learning


def one(spark, **columns):
    return spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items()))


def test_rails_of_any_characters(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab", None] + ["".join(rng.choice("ab \n\té😀中'") for _ in range(n)) for n in (3, 7, 50, 401)]
    for rows, lead in ((1, 1), (2, 2), (3, 1), (5, 4)):
        found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strings.rail_fence(F.col("t"), rows, lead).alias("c")).collect()
        for i, c in found:
            clean = None if texts[i] is None else "".join(texts[i].split())
            assert c == (None if clean is None else "".join(clean[(lead - 1 + k) % rows :: rows] for k in range(rows)))


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_ciphers(spark):
    d = one(spark, m=("we the people", "string"), h=("hello", "string"))
    m = F.col("m")
    assert value(d, strings.rail_fence(m, 3, 1)).upper() == "WHELEEOETPP"
    assert value(d, strings.rail_fence_back(strings.rail_fence(m, 3, 2), 3, 2)) == "wethepeople"
    assert value(d, strings.caesar(F.col("h"), 1)) == "ifmmp"
    assert strings.key_alphabet("JULIUS CAESAR").upper() == "JULISCAERTVWXYZBDFGHKMNOPQ"
    assert value(d, strings.caesar(strings.caesar(m, 7), 7, encrypt=False)) == "we the people"
    assert value(d, strings.cipher("caesar", m, ["shift=1"])) == "xf uif qfpqmf" and value(d, strings.cipher("rail_fence", m, ["rows=3", "lead=1"])) == value(d, strings.rail_fence(m))
    with pytest.raises(ValueError):
        strings.key_alphabet("123")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
    return row[-1]


def test_subsequences(spark):
    rng = random.Random(1)
    pairs = [("kitten", "sitting"), ("", "abc"), ("", "")] + [tuple("".join(rng.choices("abcd", k=rng.randrange(9))) for _ in range(2)) for _ in range(40)]
    d = spark.createDataFrame(pairs, "a string, b string")
    for r in d.select("a", "b", strings.edit_distance(F.col("a"), F.col("b")).alias("d"), strings.common_subsequence(F.col("a"), F.col("b")).alias("n"), strings.common_subsequence_text(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.d == distance(r.a, r.b)
        assert len(r.s) == r.n
        for text in (r.a, r.b):
            it = iter(text)
            assert all(c in it for c in r.s)


def test_packets(spark):
    texts = ["", "x", "a" * 24, "b" * 25, "ä" * 100]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, m string").select("id", F.explode(strings.packets(F.col("m"))).alias("p"))
    assert all(len(r.p) <= 32 for r in d.collect())
    back = {r.id: r.message for r in strings.reassemble(d, "id", "p").collect()}
    assert back == dict(enumerate(texts))


def test_numbers(spark):
    rows = [(n,) for n in [*range(1, 300), 1 << 40, (1 << 40) + 1]]
    d = spark.createDataFrame(rows, "n long")
    n = F.col("n")
    for r in d.select("n", numbers.next_power_of_two(n).alias("p"), numbers.log2_of_power(numbers.next_power_of_two(n)).alias("e")).collect():
        assert r.p == 1 << (r.n - 1).bit_length() and r.e == (r.n - 1).bit_length()
    small = d.where("n < 300")
    for r in small.select("n", numbers.is_prime(n).alias("prime"), numbers.survivor(F.sequence(F.lit(1), n.cast("int"))).alias("last")).collect():
        assert r.prime == (r.n > 1 and all(r.n % k for k in range(2, r.n)))
        circle = list(range(1, r.n + 1))
        while len(circle) > 1:
            circle = circle[2:] + circle[:1] if len(circle) > 2 else circle[:1]
        assert r.last == circle[0]
    assert sorted(r.prime for r in numbers.primes(spark, 30).collect()) == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert value(d, numbers.integer_sum(F.lit(3), F.lit(7))) == 25
    assert value(d, numbers.put_bit_field(F.lit(0xFF).cast("long"), 0xF0, 4, F.lit(3).cast("long"))) == 0x3F


def test_subset_counts(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(0, 12) for _ in range(7)],) for _ in range(10)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", numbers.subset_counts(F.col("a"), 15).alias("n")).collect():
        items = set(r.a) - {0}
        assert r.n == sum(sum(c) == 15 for k in range(len(items) + 1) for c in itertools.combinations(items, k))


def test_cycles(spark):
    rng = random.Random(3)
    to = list(range(20))
    rng.shuffle(to)
    got = {r.node: (r.cycle, r.length) for r in numbers.cycles(spark.createDataFrame(list(enumerate(to)), "node long, next long")).collect()}
    for start in range(20):
        path, at = [start], to[start]
        while at != start:
            path.append(at)
            at = to[at]
        assert got[start] == (min(path), len(path))
    p = [x + 1 for x in to]
    d = one(spark, p=(p, "array<int>"))
    for start in (1, 5, 9):
        at, hit = start, False
        for _ in range(10):
            at = p[at - 1]
            hit |= at == start
        assert value(d, numbers.follows_to(F.col("p"), F.lit(start))) == hit


def test_descend(spark):
    d = one(spark, x=(5.0, "double"))
    assert abs(value(d, numbers.descend(F.col("x"), lambda x: 2 * (x - 3), 0.1, 1e-9)) - 3) < 1e-6


def test_arrays(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(5, 5))
    d = one(spark, m=(m.tolist(), "array<array<double>>"), s=(rng.normal(size=20).tolist(), "array<double>"))
    r = d.select(arrays.determinant_any(F.col("m")).alias("det"), arrays.inverse(F.col("m")).alias("inv"), arrays.fast_spectrum(F.col("s")).alias("f"), "s").first()
    assert abs(r.det - np.linalg.det(m)) < 1e-9
    assert np.allclose(np.array([list(x) for x in r.inv.inverse]) @ m, np.eye(5))
    assert np.allclose([complex(z.re, z.im) for z in r.f], np.fft.fft(r.s[:16]))
    singular = one(spark, m=([[1.0, 2.0], [2.0, 4.0]], "array<array<double>>")).select(arrays.inverse(F.col("m")).alias("inv")).first().inv
    assert singular.inverse is None and singular.error == "singular"
    assert value(d, arrays.is_identity(arrays.identity(3)))


def test_elimination(spark):
    rng = np.random.default_rng(4)
    matrices = [rng.normal(size=(n, n)) for n in (1, 2, 3, 5, 9)] + [np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([[0.0, 2.0, 1.0], [0.0, 0.0, 3.0], [4.0, 5.0, 6.0]])]
    rows = [(i, m.tolist()) for i, m in enumerate(matrices)]
    odd = [(90, [[1.0, 2.0], [2.0, 4.0]]), (91, [[1.0, 2.0]]), (92, None), (93, []), (94, [[0.0, 0.0], [0.0, 0.0]]), (95, [[1.0], [2.0]])]
    d = spark.createDataFrame(rows + odd, "i int, m array<array<double>>").select("i", arrays.determinant_any(F.col("m")).alias("det"), arrays.inverse(F.col("m")).alias("inv"))
    found = {r.i: r for r in d.collect()}
    for i, m in enumerate(matrices):
        assert abs(found[i].det - np.linalg.det(m)) < 1e-9
        assert np.allclose(np.array([list(x) for x in found[i].inv.inverse]) @ m, np.eye(len(m))) and found[i].inv.error is None
    assert {i: (found[i].det, found[i].inv.error) for i, _ in odd} == {90: (0.0, "singular"), 91: (None, "not square"), 92: (None, "not square"), 93: (1.0, "not square"), 94: (0.0, "singular"), 95: (None, "not square")}


def test_fast_transform(spark):
    rng = np.random.default_rng(5)
    signals = [rng.normal(size=n).tolist() for n in (1, 2, 3, 8, 100, 257)]
    d = spark.createDataFrame(list(enumerate(signals)) + [(90, []), (91, None)], "i int, s array<double>")
    found = {r.i: r.z for r in d.select("i", arrays.fast_spectrum(F.col("s")).alias("z")).collect()}
    for i, s in enumerate(signals):
        n = 1 << (len(s).bit_length() - 1)
        assert np.allclose([complex(z.re, z.im) for z in found[i]], np.fft.fft(s[:n]))
    assert found[90] == [] and found[91] is None


def test_long_spectrum(spark):
    rng = np.random.default_rng(6)
    signals = {"a": rng.normal(size=1000), "b": rng.normal(size=64), "c": rng.normal(size=1), "d": rng.normal(size=2), "e": rng.normal(size=37)}
    rows = [(k, i, float(v)) for k, s in signals.items() for i, v in enumerate(s) if (k, i) != ("b", 5)]
    signals["b"][5] = 0
    got = {}
    for r in arrays.long_spectrum(spark.createDataFrame(rows, "n string, i int, v double"), "n", "i", "v").collect():
        got.setdefault(r[0], {})[r.k] = complex(r.re, r.im)
    for k, s in signals.items():
        n = 1 << (len(s).bit_length() - 1)
        assert sorted(got[k]) == list(range(n)) and np.allclose([got[k][i] for i in range(n)], np.fft.fft(s[:n]))


def test_long_spectrum_by_blocks(spark):
    """Blocks of columns and lines go through pieces of bounded size; nothing gathers a line as an array of rows."""
    rng = np.random.default_rng(8)
    n = 1 << 13
    signal = rng.normal(size=n + 5)
    signal[(np.arange(n + 5) % 128) // 16 == 3] = 0
    rows = [(float("nan"), i, float(v)) for i, v in enumerate(signal) if v] + [(float("nan"), 3 * 16, None), (0.0, 0, 2.0), (0.0, 1, None), (0.0, -1, 7.0), (1.0, None, 1.0), (None, 0, 1.0)]
    found = arrays.long_spectrum(spark.createDataFrame(rows, "n double, i int, v double").repartition(3), "n", "i", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 3
    got = found.collect()
    assert sorted((r.k, r.re, r.im) for r in got if r.n == 0) == [(0, 2.0, 0.0), (1, 2.0, 0.0)]
    long = {r.k: complex(r.re, r.im) for r in got if r.n != r.n}
    assert len(got) == n + 2 and sorted(long) == list(range(n)) and np.allclose([long[k] for k in range(n)], np.fft.fft(signal[:n]))
    twice = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 1, 2.0)], "n int, i int, v double")
    with pytest.raises(Exception, match="more than once"):
        arrays.long_spectrum(twice, "n", "i", "v").collect()
    from tessella.functions import signals

    samples = pa.RecordBatch.from_pydict({"number": np.zeros(n, int), "signal": np.zeros(n, int), "n": np.full(n, n), "i": rng.permutation(n), "v": signal[:n]})
    pieces = list(signals.packed([samples, samples.slice(0, 0)]))
    assert sum(map(len, pieces)) == 16 and max(len(z) for b in pieces for z in b.column("z").to_pylist()) == 512 * 8


def test_perceptron(spark):
    rng = np.random.default_rng(7)
    plane = rng.normal(size=5)
    x = rng.normal(size=(400, 5))
    x = x[np.abs(x @ plane + 0.3) > 0.2]
    y = np.where(x @ plane + 0.3 > 0, 1, -1)
    d = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)] + [(None, 1), ([1.0, None, 1.0, 1.0, 1.0], 1), ([1.0] * 5, None)], "x array<double>, y int").repartition(5)
    model = learning.train_perceptron(d)
    assert model.wrong == 0 and model.rounds < 100
    assert d.where("y is not null and x is not null and x[1] is not null").where(model.predicted("x") != F.col("y")).count() == 0
    both = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, 2.0], -1)], "x array<double>, y int")
    model = learning.train_perceptron(both, most_rounds=4)
    assert model.rounds == 4 and model.wrong >= 1
    assert learning.train_perceptron(both.limit(0)) == learning.Perceptron([], 0.0, 0, 0)
