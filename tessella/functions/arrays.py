"""Vectors, matrices and spectra as Columns over arrays, and as joins over (i, j, v) rows where they are large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from tessella.functions import signals
from tessella.session import cut


def add_vectors(*vectors: Column) -> Column:
    """Elementwise sum; null if lengths differ."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.when(F.size(total) == F.size(v), F.zip_with(total, v, lambda a, b: a + b))
    return total


def scale(factor: float | Column, vector: Column, digits: int | None = None) -> Column:
    """factor * v, rounded half to even if digits are given."""
    return F.transform(vector, lambda x: x * factor if digits is None else F.bround(x * factor, digits))


def linear_combination(factors: list[float], vectors: list[Column]) -> Column:
    return add_vectors(*[scale(f, v) for f, v in zip(factors, vectors, strict=True)])


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def vector_span(v: Column, w: Column, limit: int = 5) -> Column:
    """Distinct i v + j w for i, j from -limit up to limit."""
    steps = F.sequence(F.lit(-limit), F.lit(limit - 1))
    return F.array_distinct(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.zip_with(v, w, lambda a, b: a * i + b * j)))))


def matrix_times_vector(columns: Column, x: Column) -> Column:
    """Sum of x_j times the j-th inner list: inner lists are columns."""
    size = F.size(F.element_at(columns, 1))
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.aggregate(F.zip_with(columns, x, lambda c, f: F.element_at(c, i) * f), F.lit(0.0), lambda s, t: s + t))


def transpose(rows: Column) -> Column:
    size = F.size(F.element_at(rows, 1))
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(rows, lambda r: F.element_at(r, i)))


def entries(df: DataFrame, key: str, rows: str) -> DataFrame:
    """(key, i, j, v) of a column of arrays of rows."""
    outer = df.select(key, F.posexplode(rows).alias("i", "row"))
    return outer.select(key, "i", F.posexplode("row").alias("j", "v"))


def multiply(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Products per key of matrices as (key, i, j, v) rows: a join on the inner index and a sum."""
    a = left.select(key, "i", F.col("j").alias("k"), F.col("v").alias("a"))
    b = right.select(key, F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return a.join(b, [key, "k"]).groupBy(key, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def is_identity(rows: Column) -> Column:
    return F.forall(F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda v, j: v == F.when(i == j, 1.0).otherwise(0.0)))), lambda x: x)


def determinant(rows: Column, n: int) -> Column:
    """By cofactors in closed form, for n of 1 to 3."""
    e = lambda i, j: F.element_at(F.element_at(rows, i + 1), j + 1)
    if n == 1:
        return e(0, 0)
    if n == 2:
        return e(0, 0) * e(1, 1) - e(0, 1) * e(1, 0)
    if n == 3:
        return sum((e(0, j) * (e(1, (j + 1) % 3) * e(2, (j + 2) % 3) - e(1, (j + 2) % 3) * e(2, (j + 1) % 3)) for j in range(1, 3)), e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)))
    raise ValueError("use determinant_any for larger matrices")


def let(value: Column, f) -> Column:
    """f of a value that is computed once, within lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: A pivot below this makes a matrix singular.
LEAST_PIVOT = 1e-12


def eliminated(rows: Column) -> Column:
    """struct<m, det>: the rows of a matrix, or of one with further columns on its right, after Gauss-Jordan elimination with the
    largest pivot of each column (the first such row), and the determinant of its square left part. A fold over columns within
    the row, of any size; where no pivot is left the determinant is 0."""
    n = F.size(rows)
    state = F.struct(F.transform(rows, lambda r: F.transform(r, lambda x: x.cast("double"))).alias("m"), F.lit(1.0).alias("det"))

    def step(s: Column, k: Column) -> Column:
        size = F.transform(s["m"], lambda r, i: F.when(i >= k, F.abs(F.get(r, k))).otherwise(-1.0))
        return let(size, lambda c: let(F.array_position(c, F.array_max(c)).cast("int") - 1, lambda p: apart(s, k, p)))

    def apart(s: Column, k: Column, p: Column) -> Column:
        pivot = F.get(F.get(s["m"], p), k)
        lead = let(pivot, lambda v: F.transform(F.get(s["m"], p), lambda x: x / v))
        swapped = F.transform(s["m"], lambda r, i: F.when(i == p, F.get(s["m"], k)).otherwise(r))
        cleared = lambda one: F.transform(swapped, lambda r, i: F.when(i == k, one).otherwise(F.zip_with(r, one, lambda x, y: x - F.get(r, k) * y)))
        done = F.struct(let(lead, cleared).alias("m"), (s["det"] * pivot * F.when(p == k, 1.0).otherwise(-1.0)).alias("det"))
        return F.when((s["det"] == 0) | (F.abs(pivot) < LEAST_PIVOT), F.struct(s["m"].alias("m"), F.lit(0.0).alias("det"))).otherwise(done)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), state, step)


def is_square(rows: Column) -> Column:
    return F.coalesce(F.forall(rows, lambda r: F.size(r) == F.size(rows)), F.lit(False))


def determinant_any(rows: Column) -> Column:
    """Of any size; null if not square."""
    return F.when(is_square(rows), eliminated(rows)["det"])


def inverse(rows: Column) -> Column:
    """struct<inverse, error>: the inverse, or null and the reason."""
    n = F.size(rows)
    unit = lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))
    beside = F.transform(rows, lambda r, i: F.concat(F.transform(r, lambda x: x.cast("double")), unit(i)))
    right = lambda e: F.transform(e["m"], lambda r: F.slice(r, n + 1, n))
    out = lambda m, error: F.struct(m.cast("array<array<double>>").alias("inverse"), F.lit(error).cast("string").alias("error"))
    none = F.lit(None)
    found = let(eliminated(beside), lambda e: F.when(e["det"] == 0, out(none, "singular")).otherwise(out(right(e), None)))
    return F.when(is_square(rows) & (n > 0), found).otherwise(out(none, "not square"))


def row_operation(row: Column, op) -> Column:
    return F.transform(row, op)


def spectrum(df: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, k, re, im): the discrete Fourier transform, one row per frequency, summed inside the row."""
    n = F.size(signal)
    sample = F.col(signal)

    def part(f, k: Column) -> Column:
        return F.aggregate(F.transform(sample, lambda x, i: x.cast("double") * f(k * i * (2 * math.pi) / n)), F.lit(0.0), lambda s, x: s + x)

    rows = df.where(n > 0).select(key, signal, F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select(key, "k", part(F.cos, F.col("k")).alias("re"), (-part(F.sin, F.col("k"))).alias("im"))


def magnitude(re: Column, im: Column, digits: int = 3) -> Column:
    return F.bround(F.sqrt(re * re + im * im), digits)


COMPLEX = "array<struct<re:double,im:double>>"


def fast_transform(signal: Column) -> Column:
    """The discrete Fourier transform of an array of complex numbers (re, im) whose length is a power of two: log n stages as a fold.

    After stage s the place k n / 2^s + p holds frequency k of the 2^s samples that are n / 2^s apart from p on: each stage
    puts two such transforms of half the length together, and the last one leaves frequencies in order."""
    n = F.size(signal)
    stages = F.when(n > 1, F.sequence(F.lit(1), F.round(F.log2(n.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def stage(z: Column, s: Column) -> Column:
        length = F.pow(F.lit(2), s).cast("int")  # of the transforms after the stage
        return let(F.struct(length.alias("length"), (n / length).cast("int").alias("apart")), lambda c: F.transform(z, lambda _, i: joined(z, i, c["length"], c["apart"])))

    def joined(z: Column, i: Column, length: Column, apart: Column) -> Column:
        k, p = ((i - i % apart) / apart).cast("int"), i % apart
        at = (k % (length / 2).cast("int")) * (2 * apart) + p
        angle = k * (-2 * math.pi) / length
        even, odd = F.get(z, at), F.get(z, at + apart)
        return let(F.struct(F.cos(angle).alias("c"), F.sin(angle).alias("s"), even.alias("a"), odd.alias("b")), lambda t: F.struct(
            (t["a"]["re"] + t["c"] * t["b"]["re"] - t["s"] * t["b"]["im"]).alias("re"), (t["a"]["im"] + t["c"] * t["b"]["im"] + t["s"] * t["b"]["re"]).alias("im")))

    return F.aggregate(stages, signal.cast(COMPLEX), stage)


def power_of_two(n: Column) -> Column:
    """The largest power of two up to n, 0 for 0."""
    return F.when(n > 0, F.pow(F.lit(2), F.length(F.bin(n.cast("long"))) - 1)).otherwise(0).cast("long")


def fast_spectrum(signal: Column) -> Column:
    """The transform of a real signal cut to its largest power of two, as complex numbers."""
    cut_off = F.slice(signal, 1, power_of_two(F.size(signal)).cast("int"))
    return fast_transform(F.transform(cut_off, lambda x: F.struct(x.cast("double").alias("re"), F.lit(0.0).alias("im"))))


#: Up to so many signals their sizes are broadcast.
MOST_SIGNALS = 1_000_000


def long_spectrum(samples: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(key, k, re, im): the transform of signals given as rows (key, place from 0, value), cut to their largest power of two, of any
    length. Missing samples and null values count as 0; a place that occurs twice is an error. See signals."""
    rows = samples.select(F.col(key).alias("signal"), F.col(place).cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).where("i >= 0")
    sizes = cut(rows.groupBy("signal").agg(power_of_two(F.max("i") + 1).alias("n")).withColumn("number", F.monotonically_increasing_id()))
    # one long signal is one key: unless there are very many signals, no row is shuffled by it
    sized = rows.join(F.broadcast(sizes) if sizes.count() <= MOST_SIGNALS else sizes, "signal").where("i < n").select("number", "signal", "n", "i", "v")
    kind = lambda at: StructType([sized.schema["number"], sized.schema["signal"], StructField("n", LongType()), StructField("block", LongType()), StructField("at", at), StructField("z", BinaryType())])
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda pieces: pieces.repartition(tasks, "number", "block").sortWithinPartitions("number", "block")
    columns = dealt(sized.mapInArrow(signals.packed, kind(BinaryType())))
    lines = dealt(columns.mapInArrow(signals.by_columns, kind(LongType())))
    found = lines.mapInArrow(signals.by_lines, StructType([sized.schema["signal"], StructField("k", LongType()), StructField("re", DoubleType()), StructField("im", DoubleType())]))
    return found.withColumnRenamed("signal", key)
