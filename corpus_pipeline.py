"""A training-corpus pipeline of five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir): docs is what its predecessor kept, sf_dir has the tables that stages learn from
or compare with (labels, benchmark). All but the last return the columns of docs; the last stores the corpus in shards
and returns one row per stored document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, jaccard, mixing, sharding, toxicity
from tessella.llm.common import work_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles, the least id stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, substitutions tolerated, go."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def store_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in compacted shards: doc_id, source, shard, words, text_sha256 of each stored row, read back."""
    store = sharding.shard(docs, work_path(spark, "corpus"))
    return store.read_placed().select("doc_id", "source", F.col("tsl_shard").alias("shard"), mixing.word_count("text").alias("words"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", store_shards),
]

#: Scores, hashes and shards have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = work_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
