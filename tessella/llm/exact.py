"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

Texts are equal if they are identical without blanks (space, \\t to \\r); their digest is the SHA-256 of what is left. Of
equal texts, the row with the most code points in the original text stays, then the least id.

Ids, digests and lengths, without texts, are written once. A Misra-Gries sketch (the frequent-items sketch behind
approx_top_k: a bounded table of counters, all lowered together when it is full) finds the digests that may hold a share
of the rows of `share` or more. They are counted exactly, which drops those that don't, and their winners, 1 / share rows
at most, are broadcast: the rows of a frequent digest are decided where they are read and never shuffled. The
remaining digests go through an ordinary shuffle, in which none has more than that share of the rows. Sketches of tasks
are merged in two steps, so no task meets all of them.

Defined cases: a null text is an empty one; all empty texts are one group; null ids come last in the order; rows that
agree in id and length are ordered by a hash of the original text, and of rows that agree in that too, which one stays is
open, but exactly one does; very long texts count whole; an empty table gives an empty result; other columns, of any
name, pass through `without_copies` and are ignored by `copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, small

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A digest with this share of the rows is frequent.
SHARE = 0.0001
#: Counters of a sketch; its counts are off by at most 3.5 / TRACKED of the rows, about half of SHARE.
TRACKED = 1 << 16
#: Groups of tasks whose sketches are merged first.
MERGERS = 64


def normalised(text: str | Column) -> Column:
    """The text without blanks, empty for null."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _keys() -> list[Column]:
    """Digest, id, length and a hash of the original text; of equal texts the one that comes first in the order of _first stays."""
    return [digest("text").alias("digest"), F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.xxhash64("text").alias("tie")]


def _first() -> list[Column]:
    return [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]


def frequent(keys: DataFrame, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """(digest, group_size, keep_id, length, tie, row): the winners of the digests that have at least that share of the
    rows of keys, and two rows; counted exactly."""
    if tracked * share < 4:
        raise ValueError("the sketch needs more than 4 / share counters")
    least = max(2, int(keys.count() * share))
    code = F.xxhash64("digest")
    sketches = keys.groupBy((F.spark_partition_id() % MERGERS).alias("part")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("sketch"))
    # grouped, as a sum without keys also makes a sketch of each empty partition, which can't be merged
    merged = sketches.groupBy((F.col("part") < 0).alias("one")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    # counts are too high by at most half a share, so twice as many digests cover all that have the share
    tops = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {min(tracked, int(2 / share))})")).alias("top"))
    candidates = tops.where(F.col("top.count") >= least).select(F.col("top.item").alias("code"))
    order = F.struct((-F.col("length")).alias("less"), F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row")
    mine = keys.join(F.broadcast(candidates), code == F.col("code"), "left_semi")
    counted = mine.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where(F.col("group_size") >= least)
    return counted.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("length"), F.col("best.tie").alias("tie"), F.col("best.row").alias("row"))


def _decided(docs: DataFrame, share: float, tracked: int) -> DataFrame:
    """digest, doc_id, length, tie, keep_id, group_size and kept of each row."""
    keys = cut(docs.select(*_keys()).withColumn("row", F.monotonically_increasing_id()))
    columns = ["digest", "doc_id", "length", "tie", "keep_id", "group_size", "kept"]
    whole = Window.partitionBy("digest").orderBy(*_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = {"keep_id": F.first("doc_id").over(whole), "group_size": F.count("*").over(whole), "kept": F.col("row") == F.first("row").over(whole)}
    if keys.isEmpty():
        return keys.withColumns(judged).select(*columns)
    heavy = F.broadcast(cut(frequent(keys, share, tracked)))  # 1 / share rows at most
    removed = keys.join(heavy.select("digest", "keep_id", "group_size", F.col("row").alias("best")), "digest").withColumn("kept", F.col("row") == F.col("best"))
    rest = keys.join(heavy.select("digest"), "digest", "left_anti").withColumns(judged)
    return removed.select(*columns).unionByName(rest.select(*columns))


def copies(docs: DataFrame, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs; of a group of equal texts one row is kept."""
    return _decided(docs, share, tracked).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that stay, whole. Only the winners of groups meet the texts: broadcast if few, otherwise shuffled."""
    same = ["digest", "length", "doc_id", "tie"]
    grouped = _decided(docs, share, tracked).where("group_size > 1")
    # the winner's own key, and whether several rows have it
    ties = grouped.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*same).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept")
    winners = cut(ties.select("digest", F.struct(*same).alias("winner"), (F.col("n") > 1).alias("tied")))
    rows = docs.select(F.struct("*").alias("whole"), *_keys())
    stay = rows.join(small(winners), "digest", "left").where(F.col("winner").isNull() | F.struct(*same).eqNullSafe(F.col("winner")))
    if not winners.where("tied").isEmpty():
        stay = stay.where("tied is null or not tied").select("whole").unionByName(stay.where("tied").dropDuplicates(["digest"]).select("whole"))
    return stay.select("whole.*")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256 FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)"""


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
