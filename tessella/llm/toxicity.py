"""Toxicity by maximum-scoring segment search.

Model. Words, and their first five and four bytes, are counted by labelled documents that hold them. A feature's
log-odds come from its counts with a Dirichlet prior: the prior of a word is the share of its five-byte stem, that of
a stem the share of the four-byte one, and that of the latter the share of the labels. A word not seen in training is
scored as its longest known stem, which carries over to inflected forms.

Search. A word's score is its log-odds less a fixed drift, so neutral words score below zero. One linear scan finds all
maximal scoring segments of a text (every passage that no extension or cut improves), whatever the text's length.

Calibration. Best segments of clean labelled texts follow an extreme-value distribution P(S > x) = 1 - exp(-K n exp(-l x))
for n words; l and K are fitted to clean labelled documents that were not counted. A document's evidence is the sum,
over its segments with a chance count K n exp(-l x) below 1 / e, of -ln of that count; a logistic curve, fitted to the same
documents, turns it into a score between 0 and 1.

At most about `most_labelled` labelled documents are used, chosen by a hash of their id: the only bound. Everything else
covers all rows. Held-out rows (crc32 of the id as text, modulo 4, is 2) are never learned from.

Defined cases: null and empty texts have no evidence and get the score of such texts; null ids are not held out and never
used for learning; null labels are ignored, of repeated labels the largest counts; without labels of both kinds all
scores are 0; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHasher, cut, lean, mix

BLANKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
STEMS = (4, 5)
WHOLE = 6  # tag of whole words, beside the stem lengths
DRIFT, LOWEST, HIGHEST = 1.2, -1.2, 6.0
PRIOR = 10.0
THRESHOLD = 0.3
VERDICT = "struct<score:double,evidence:double,passages:array<struct<start_word:long,end_word:long,score:double>>>"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(hasher: WordHasher, text: str | None) -> np.ndarray:
    """Hashes [stem of 4 bytes, stem of 5 bytes, word] of each word, tagged by kind; one row per word."""
    data = (text or "").lower().encode("utf-8", "replace")
    raw, starts, ends = hasher.bounds(data)
    out = np.zeros((len(starts), 3), np.uint64)
    if len(starts):
        sums = hasher.sums(raw)
        for i, size in enumerate((*STEMS, 1 << 40)):
            out[:, i] = mix(hasher.pieces(sums, starts, np.minimum(starts + size, ends)) + np.uint64((*STEMS, WHOLE)[i]))
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in time linear in the number of scores."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, nearest earlier one with a smaller left sum
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                held.append((left, right, start, i + 1, j))
                break
            left, start = held[j][0], held[j][2]
            del held[j:]
    return [(start, end, right - left) for left, right, start, end, _ in held]


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    values: np.ndarray  # their scores
    present: np.ndarray  # by low bits of a hash
    decay: float = 1.0  # l of the extreme-value distribution
    log_k: float = 0.0
    intercept: float = 0.0
    slope: float = 1.0
    trained: bool = False

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Score per hash, NaN where unknown."""
        out = np.full(len(hashes), np.nan)
        at = np.flatnonzero(self.present[hashes & np.uint64(len(self.present) - 1)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            known = self.keys[place] == hashes[at]
            out[at[known]] = self.values[place[known]]
        return out

    def segments(self, hasher: WordHasher, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        found = features(hasher, text)
        if not len(found) or not len(self.keys):
            return len(found), []
        score = self.lookup(found[:, 2])
        for i in (1, 0):
            unknown = np.flatnonzero(np.isnan(score))
            score[unknown] = self.lookup(found[unknown, i])
        score = np.clip(np.nan_to_num(score, nan=0.0) - DRIFT, LOWEST, HIGHEST)
        return len(found), maximal_segments(score)

    def log_chance(self, score: float, n: int) -> float:
        """ln of the number of segments with such a score that chance puts into n clean words; at score 0 one at
        least, so that a rare but faint segment isn't evidence."""
        return max(self.log_k + float(np.log(max(n, 1))), 0.0) - self.decay * score

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(x for _, _, s in found if (x := -self.log_chance(s, n)) > 1)

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * min(evidence, 60.0))))) if self.trained else 0.0


def log_odds(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, parents: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features and their posterior toxic shares; parents: the prior toxic share of each."""
    share = (toxic + PRIOR * parents) / (toxic + clean + PRIOR)
    return np.log(share / (1 - share)) - np.log(n_toxic / n_clean), share


def _count(rows: DataFrame) -> pd.DataFrame:
    """Documents of either label by feature: kind, key, parent, toxic, clean; features of one document are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(BLANKS)
        for batch in batches:
            parts = []
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                found = np.unique(features(hasher, text), axis=0) if isinstance(text, str) else np.zeros((0, 3), np.uint64)
                for kind in range(3):
                    own, first = np.unique(found[:, kind], return_index=True)
                    parts.append(pd.DataFrame({"kind": kind, "key": own.view(np.int64), "parent": (found[first, kind - 1] if kind else np.zeros(len(own), np.uint64)).view(np.int64), "toxic": int(label == 1), "clean": int(label != 1)}))
            if parts:
                yield pd.concat(parts).groupby(["kind", "key", "parent"], as_index=False).sum().astype({"kind": "int32"})

    counted = rows.select("text", "toxic").mapInPandas(lean(run), "kind int, key long, parent long, toxic long, clean long")
    summed = counted.groupBy("kind", "key", "parent").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return summed.where("toxic + clean >= 2").toPandas()  # bounded: features of at most about most_labelled documents


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, counted_share: float = 0.7) -> Model:
    """Learn from rows of labels that are not held out, at most about most_labelled."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << 4, bool))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    usable = usable.withColumn("draw", F.pmod(F.xxhash64(F.lit("toxicity"), "label_id"), F.lit(1_000_000)) / 1e6)
    n = usable.count()
    chosen = F.broadcast(usable.where(F.col("draw") < most_labelled / max(n, 1)))  # bounded by most_labelled
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").where("text is not null").join(chosen, "label_id").select("text", "toxic", F.pmod(F.xxhash64(F.lit("part"), "label_id"), F.lit(1000)).alias("part")))
    edge = int(counted_share * 1000)
    sizes = dict(sample.where(F.col("part") < edge).groupBy((F.col("toxic") == 1).alias("t")).count().collect())
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return empty
    counts = _count(sample.where(F.col("part") < edge))
    shares: dict[int, float] = {}
    keys, values = [], []
    for kind in range(3):
        own = counts[counts["kind"] == kind]
        if kind:
            parents = own["parent"].map(shares).fillna(n_toxic / (n_toxic + n_clean)).to_numpy(float)
        else:
            parents = np.full(len(own), n_toxic / (n_toxic + n_clean))
        value, share = log_odds(own["key"].to_numpy(), own["toxic"].to_numpy(float), own["clean"].to_numpy(float), parents, n_toxic, n_clean)
        shares = dict(zip(own["key"].tolist(), share.tolist(), strict=True))
        keys.append(own["key"].to_numpy().view(np.uint64))
        values.append(value)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    bits = max(16, len(key).bit_length() + 4)
    present = np.zeros(1 << bits, bool)
    present[key & np.uint64((1 << bits) - 1)] = True
    model = Model(key[order], value[order], present, trained=True)
    _calibrate(model, sample.where(F.col("part") >= edge))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the extreme-value distribution to clean documents and the logistic curve to all of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(BLANKS)
        for batch in batches:
            found = [shared.value.segments(hasher, t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in found], "scores": [[s for _, _, s in x] for _, x in found]})

    held = rows.select("text", "toxic").mapInPandas(lean(run), "toxic int, n long, scores array<double>").toPandas()
    if not len(held):
        return
    n, label = held["n"].to_numpy(float), (held["toxic"] == 1).to_numpy(float)
    clean = (label == 0) & (n > 0)
    chance = np.concatenate([np.asarray(s, float) for s, c in zip(held["scores"], clean, strict=True) if c] or [np.zeros(0)])
    # chance segments are a Poisson process along the words with exponential scores; both rates by maximum likelihood,
    # with one segment of mean score 1 as prior
    model.decay = float(np.clip((len(chance) + 1) / (chance.sum() + 1), 0.3, 5.0))
    model.log_k = float(np.log((len(chance) + 1) / max(n[clean].sum(), 1)))
    evidence = np.array([min(60.0, model.evidence(int(a), [(0, 0, x) for x in s])) for a, s in zip(n, held["scores"], strict=True)])
    design, beta = np.stack([np.ones(len(evidence)), evidence], axis=1), np.zeros(2)
    for _ in range(50):  # Newton's method with a small ridge, so that separable labels have a finite fit
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hessian, design.T @ (label - p) - 1e-3 * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    model.intercept, model.slope = float(beta[0]), max(float(beta[1]), 0.0)


def verdict(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """VERDICT of a text column: score, evidence, and every significant passage (word positions, end exclusive)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher, own = WordHasher(BLANKS), shared.value
        for batch in texts:
            rows = []
            for t in batch:
                n, found = own.segments(hasher, t if isinstance(t, str) else None)
                weight = own.evidence(n, found)
                rows.append((own.score(weight), weight, [{"start_word": a, "end_word": b, "score": s} for a, b, s in found if own.log_chance(s, n) < -1]))
            yield pd.DataFrame(rows, columns=["score", "evidence", "passages"])

    return judge(F.col(text))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages."""
    rows = docs.select("doc_id", verdict(docs.sparkSession, model).alias("v"))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("v.score").alias("score"),
        (F.col("v.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("v.passages").cast("long").alias("n_passages"),
        F.col("v.passages").alias("passages"),
    )


def score_of(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text column alone; texts are taken from their Arrow batch one by one."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, own = WordHasher(BLANKS), shared.value
        for batch in texts:
            yield pa.array([own.score(own.evidence(*own.segments(hasher, t.as_py()))) for t in batch], pa.float64())

    return F.arrow_udf(lean(run), "double")(F.col(text))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns pass."""
    return docs.where(score_of(docs.sparkSession, model) < threshold)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("passages")
