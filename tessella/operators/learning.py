"""A perceptron trained over partitions: each round starts from one set of weights, every partition goes through its points and
corrects the weights at each point that is wrong, and the results are averaged, weighted by the corrections they had.

That finds a separating plane in a bounded number of rounds if there is one. A round in which no partition corrects anything ends
it: all points are right then. Without a separating plane it ends after `most_rounds`, and `wrong` tells how many are wrong.

Defined cases: null points, and points with null components or without a class, are left out; all points must have as many components
as the first; an empty table has no weights and nothing wrong."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import cut


@dataclass
class Perceptron:
    """sum of weights and components, plus bias, is over 0 for class 1 and below 0 for class -1."""

    weights: list[float]
    bias: float
    rounds: int
    wrong: int

    def margin(self, x: str) -> Column:
        return F.aggregate(F.zip_with(F.col(x), F.lit(self.weights), lambda a, b: a.cast("double") * b), F.lit(self.bias), lambda s, v: s + v)

    def predicted(self, x: str) -> Column:
        """1 or -1; 0 on the plane."""
        return F.signum(self.margin(x)).cast("int")


def _epoch(weights: np.ndarray):
    """One pass over a partition's points (x, y): a row (corrections, weights with the bias last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, corrections = weights.copy(), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(own) - 1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.hstack([x, np.ones((len(x), 1))])
            at = 0
            while at < len(x):  # on to the next point that is wrong
                bad = np.flatnonzero(y[at : at + 256] * (x[at : at + 256] @ own) <= 0)
                if len(bad):
                    at += int(bad[0])
                    own, corrections = own + y[at] * x[at], corrections + 1
                    at += 1
                else:
                    at += 256
        yield pa.RecordBatch.from_pydict({"n": pa.array([corrections]), "w": pa.array([own.tolist()], pa.list_(pa.float64()))})

    return run


def train_perceptron(points: DataFrame, x: str = "x", y: str = "y", most_rounds: int = 100) -> Perceptron:
    """points: arrays of numbers and classes 1 and -1."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull()), F.lit(False)))
    held = cut(rows.select(F.transform(x, lambda v: v.cast("double")).alias("x"), F.col(y).cast("double").alias("y")))
    first = held.first()
    if first is None:
        return Perceptron([], 0.0, 0, 0)
    weights, rounds = np.zeros(len(first.x) + 1), 0
    while True:
        found = held.mapInArrow(_epoch(weights), "n long, w array<double>").where("n > 0")
        parts = found.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("v")).collect()  # a row a component
        if not parts:
            break
        if rounds == most_rounds:
            break
        for r in parts:
            weights[r.i] = r.v / r.n
        rounds += 1
    model = Perceptron(weights[:-1].tolist(), float(weights[-1]), rounds, 0)
    if parts:
        model.wrong = held.where(model.margin("x") * F.col("y") <= 0).count()
    return model
