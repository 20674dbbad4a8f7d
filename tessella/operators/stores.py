"""Keyed stores as DataFrames: configuration (section, entry, value), documents to insert if absent, search trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tessella.session import cut



def normalised(config: DataFrame) -> DataFrame:
    """Sections in upper case, entries in lower case; of repeated keys the last by value order stays deterministic."""
    return config.select(F.upper("section").alias("section"), F.lower("entry").alias("entry"), "value")


def get_entry(config: DataFrame, section: str, entry: str | None = None) -> DataFrame:
    rows = normalised(config).where(F.col("section") == section.upper())
    return rows if entry is None else rows.where(F.col("entry") == entry.lower())


def upsert(config: DataFrame, changes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Insert what is absent; update what is there only with overwrite."""
    old, new = normalised(config).withColumnRenamed("value", "old"), normalised(changes).withColumnRenamed("value", "new")
    pick = ("new", "old") if overwrite else ("old", "new")
    return old.join(new, ["section", "entry"], "full_outer").select("section", "entry", F.coalesce(*pick).alias("value"))


def delete(config: DataFrame, section: str, entry: str | None = None) -> DataFrame:
    gone = (F.col("section") == section.upper()) & (F.lit(True) if entry is None else F.col("entry") == entry.lower())
    return normalised(config).where(~gone)


def delete_keys(config: DataFrame, keys: DataFrame) -> DataFrame:
    return normalised(config).join(keys.select(F.upper("section").alias("section"), F.lower("entry").alias("entry")), ["section", "entry"], "left_anti")


def merge(changes: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, skipped): the target wins, only absent keys are added, the others are reported."""
    target, changes = normalised(target), normalised(changes)
    keys = target.select("section", "entry")
    return target.unionByName(changes.join(keys, ["section", "entry"], "left_anti")), changes.join(keys, ["section", "entry"], "left_semi")


def from_json(df: DataFrame, column: str) -> DataFrame:
    """(section, entry, value) of JSON objects of objects; all values as text."""
    kind = MapType(StringType(), MapType(StringType(), StringType()))
    outer = df.select(F.explode(F.from_json(column, kind)).alias("section", "entries"))
    return outer.select(F.upper("section").alias("section"), F.explode("entries").alias("entry", "value")).select("section", F.lower("entry").alias("entry"), "value")


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """(section, entry, value) of INI files; whole files, as a section's name is lines above its entries."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    order = Window.partitionBy("file").orderBy("at")
    name = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1), F.lit(""))
    rows = lines.withColumn("section", F.last(name, ignorenulls=True).over(order))
    entry = r"^\s*([^#;\[\s=:][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    return rows.where(F.col("section").isNotNull() & F.col("line").rlike(entry)).select(F.upper("section").alias("section"), F.lower(F.regexp_extract("line", entry, 1)).alias("entry"), F.regexp_extract("line", entry, 2).alias("value"))


def write_ini(config: DataFrame, path: str) -> None:
    """One INI text file; a configuration is small by nature."""
    each = normalised(config).groupBy("section").agg(F.sort_array(F.collect_list(F.concat("entry", F.lit(" = "), F.coalesce("value", F.lit(""))))).alias("lines"))
    each.select(F.concat(F.lit("["), "section", F.lit("]\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def parse_ini(df: DataFrame, column: str) -> DataFrame:
    """(section, entry, value) of INI texts in a column."""
    name, entry = r"(?m)^\s*\[([^\]]+)\]\s*$", r"^\s*([^#;\[\s=:][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    names = F.regexp_extract_all(F.col(column), F.lit(name), F.lit(1))
    bodies = F.slice(F.split(F.col(column), name, -1), 2, 1 << 30)
    each = df.select(F.explode(F.arrays_zip(names.alias("section"), bodies.alias("body"))).alias("s")).select(F.upper("s.section").alias("section"), F.explode(F.split("s.body", r"\r?\n")).alias("line"))
    return each.where(F.col("line").rlike(entry)).select("section", F.lower(F.regexp_extract("line", entry, 1)).alias("entry"), F.regexp_extract("line", entry, 2).alias("value"))


def merge_files(spark: SparkSession, changes: str, target: str, output: str | None = None) -> DataFrame:
    """Merge two configurations, given as paths or as INI texts, and write the result to output, else over the target if
    that is a path; the skipped rows."""
    read = lambda c: parse_ini(spark.createDataFrame([(c,)], "text string"), "text") if "\n" in c or c.lstrip().startswith("[") else read_ini(spark, c)
    merged, skipped = merge(read(changes), read(target))
    merged, skipped = cut(merged), cut(skipped)  # read before the target is overwritten
    path = output or (target if "\n" not in target and not target.lstrip().startswith("[") else None)
    if path:
        write_ini(merged, path)
    return skipped


def insert_if_absent(batch: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """The rows of batch, each key once, that stored doesn't have."""
    return batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def tree_insert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """What a search tree holds: the first row of each key."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("tsl_rank", F.row_number().over(first)).where("tsl_rank = 1").drop("tsl_rank")


def tree_find(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(key)


def precedes(a: Column, b: Column) -> Column:
    """Strict order of nodes by key."""
    return a < b
