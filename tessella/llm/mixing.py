"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws an exponential key, -ln(u) / quality, with u from a hash of its id, so reruns agree and a document
of twice the quality is twice as likely to come next. Within a source, documents in order of their keys are taken
until the budget is met. A budget first pays complete epochs of the source; only its rest is a selection.

No source is ever sorted as a whole. Keys, sizes and sources, without texts, are written once. Sums by source and range of
keys give each source the one range in which its budget ends; that range is divided again by its own least and largest
key until it holds at most `bucket_rows` rows or one key only. Its rows, grouped by key, id and size, are
prefix-summed to the last group that is taken. A document is then in or out by comparing it with that one group, so
texts meet only a row per source, which is broadcast behind a check of its size.

Defined cases: a null text has size 0; null is a source of its own, last in order; null ids share one draw; rows that
repeat an id are separate rows, ordered among each other by size; rows that agree in id, source and size are
interchangeable, and if a budget ends among them, they are numbered as they come; sources without words get target 0;
very long texts count whole; an empty table gives an empty result; other columns pass through `mixed` and are ignored by
`plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that lower a text's quality by their share.
NOISE = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEAST_QUALITY = 0.05


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str) -> Column:
    """The share of characters that are neither digits nor punctuation, 0.05 at least."""
    clean = F.length(F.translate(F.col(text), NOISE, "")) / F.length(text)
    return F.greatest(F.coalesce(F.when(F.length(text) > 0, clean), F.lit(0.0)), F.lit(LEAST_QUALITY))


def exponential_key(doc_id: str, quality: Column, seed: int = 17) -> Column:
    """-ln(u) / quality, with u in (0, 1) from the first 52 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


#: Ranges that a range of keys is divided into.
RANGES = 1000


def _keyed(docs: DataFrame, seed: int, quality: Column | None) -> DataFrame:
    """docs with __size and __key."""
    key = exponential_key("doc_id", text_quality("text") if quality is None else quality, seed)
    return docs.withColumns({"__size": word_count("text"), "__key": key})


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat in order of code points, null last; a target over
    `most` times its source's size stops there and its excess goes to the others by weight.

    Sources are capped in order of size by weight: going through them, a source is capped if the level that the
    sources from it on could share is over its own cap, which gives the same fixed point as resharing by rounds.
    The windows run over one row per source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * most).alias("cap")
    rows = ranked.withColumn("weight", weight).select("*", cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(everything) * share
    rows = rows.withColumn("total", total).withColumn(
        "level",
        (F.col("total") - (F.sum("cap").over(order) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight"))),
    )
    rows = rows.withColumn("capped", F.col("weight") * F.col("level") > F.col("cap"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    shared = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left / shared)).select("source", "source_size", F.col("target").cast("double").alias("target"))


def _with(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of their source's row; its columns start with __ and none is in rows."""
    return rows.join(small(by_source), rows["source"].eqNullSafe(by_source["__source"])).drop("__source")


def _edges(keyed: DataFrame, budgets: DataFrame, bucket_rows: int) -> DataFrame:
    """Per source whose rest ends within it: the range of keys (__low, __high) where it ends, __before (words before that
    range) and __rest."""
    size, key = F.col("__size"), F.col("__key")
    edges = budgets.where("rest > 0").select(F.col("source").alias("__source"), F.lit(None).cast("double").alias("__low"), F.lit(None).cast("double").alias("__high"), F.lit(0).cast("long").alias("__before"), F.col("rest").alias("__rest"))
    while True:
        inside = _with(keyed, cut(edges)).where("__low is null or __key between __low and __high")
        # first by the keys' own distribution, as if all qualities were 1; then evenly between least and largest key
        even = (key - F.col("__low")) / F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low"))
        part = F.floor(F.coalesce(F.when(F.col("__low").isNull(), 1 - F.exp(-key)).otherwise(even), F.lit(0.0)) * RANGES)
        sums = inside.groupBy("source", "__rest", part.alias("part")).agg(F.first("__before").alias("start"), F.sum(size).alias("words"), F.count("*").alias("rows"), F.min(key).alias("__low"), F.max(key).alias("__high"))
        before = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")
        placed = sums.withColumn("__before", before).where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("words") > F.col("__rest")))
        last = placed.groupBy("source", "__rest").agg(F.min(F.struct("part", "__low", "__high", "__before", "rows")).alias("e"))
        edges = cut(last.select(F.col("source").alias("__source"), "e.__low", "e.__high", "e.__before", "__rest", F.col("e.rows").alias("__rows")))
        if not edges.where((F.col("__rows") > bucket_rows) & (F.col("__low") < F.col("__high"))).limit(1).count():
            return edges.drop("__rows")
        edges = edges.drop("__rows")


def _budgets(keyed: DataFrame, bucket_rows: int, **options) -> DataFrame:
    """One row per source: its size, target and complete epochs, and the last group of equal rows (key, id, size) of its
    selection with the numbers of rows that are there and that are taken; nulls where no rest is selected."""
    by_source = targets(keyed.groupBy("source").agg(F.sum("__size").alias("source_size")), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    by_source = cut(by_source.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    edges = _edges(keyed, by_source, bucket_rows)
    groups = _with(keyed, edges).where("__key between __low and __high").groupBy("source", "__key", "doc_id", "__size", "__before", "__rest").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("__key", "doc_id", "__size")
    words = F.col("n") * F.col("__size")
    # a row is taken if at least half of it is within the rest; of n equal rows a first part is
    room = 2 * (F.col("__rest") - F.col("__before") - (F.sum(words).over(order) - words)) - F.col("__size")
    taken = F.when(room < 0, 0).when(F.col("__size") == 0, F.col("n")).otherwise(F.least("n", F.floor(room / (2 * F.col("__size"))).cast("long") + 1))
    fit = groups.withColumn("taken", taken).where("taken > 0").groupBy("source").agg(F.max(F.struct("__key", "doc_id", "__size", "n", "taken")).alias("last"))
    # nothing of the range is taken: what lies before it is
    ends = edges.select(F.col("__source"), F.col("__low")).join(fit, F.col("__source").eqNullSafe(F.col("source")), "left").select("__source", "__low", "last")
    joined = by_source.join(ends, by_source["source"].eqNullSafe(ends["__source"]), "left")
    return cut(joined.select(F.col("source").alias("__source"), F.col("source_size").cast("long").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), "__low", F.col("last").alias("__last")))


def _copies(keyed: DataFrame, budgets: DataFrame) -> DataFrame:
    """keyed with the columns of budgets and __copies: how often the mix takes each row."""
    rows = _with(keyed, budgets)
    last, key = F.col("__last"), F.col("__key")
    mine, end = F.struct("doc_id", "__size"), F.struct(last["doc_id"], last["__size"])
    equal = F.coalesce((key == last["__key"]) & F.col("doc_id").eqNullSafe(last["doc_id"]) & (F.col("__size") == last["__size"]), F.lit(False))
    inside = F.when(last.isNull(), key < F.col("__low")).otherwise((key < last["__key"]) | ((key == last["__key"]) & (mine < end)) | equal)
    copies = F.col("__epochs") + F.coalesce(inside, F.lit(False)).cast("long")
    if not budgets.where("__last.taken < __last.n").limit(1).count():
        return rows.withColumn("__copies", copies)
    part = equal & (last["taken"] < last["n"])
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    some = rows.where(part).withColumn("__copies", F.col("__epochs") + (number <= F.col("__last")["taken"]).cast("long"))
    return rows.where(~part).withColumn("__copies", copies).unionByName(some)


def plan(docs: DataFrame, seed: int = 17, bucket_rows: int = 20_000, quality: Column | None = None, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    keyed = cut(_keyed(docs, seed, quality).select("doc_id", "source", "__size", "__key"))
    return _copies(keyed, _budgets(keyed, bucket_rows, **options)).select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 17, bucket_rows: int = 20_000, quality: Column | None = None, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    key = exponential_key("doc_id", text_quality("text") if quality is None else quality, seed)
    # the row is one column, so its names meet none of those here
    rows = docs.select("doc_id", "source", word_count("text").alias("__size"), key.alias("__key"), F.struct("*").alias("row"))
    budgets = _budgets(cut(rows.select("doc_id", "source", "__size", "__key")), bucket_rows, **options)
    taken = _copies(rows, budgets).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same draw and targets; sorted as a whole, which a single node can do.
MIX_CTES = r"""
d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / greatest(coalesce(CASE WHEN length(text) > 0 THEN length(translate(text, '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''))::DOUBLE / length(text) END, 0), 0.05::DOUBLE) AS k
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0
), s2 AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s1
), s3 AS (
  SELECT *, (total - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
  FROM s2 WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank)
), s4 AS (
  SELECT *, weight * level > cap AS capped FROM s3
), s5 AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s5
), m AS (
  SELECT d.doc_id, d.source, d.size, s6.source_size, s6.target,
         s6.epochs + CASE WHEN 2 * (sum(d.size) OVER w - d.size) + d.size <= 2 * (s6.target - s6.epochs * s6.source_size) AND s6.target > s6.epochs * s6.source_size THEN 1 ELSE 0 END AS copies
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
  WINDOW w AS (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
)
"""
OP8_SQL = f"WITH {MIX_CTES} SELECT doc_id, source, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM m"
