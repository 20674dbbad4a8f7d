"""Session factory and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessella", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all
    tasks run in this process; on a cluster an unset folder is an error."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there; lost executors don't lose it."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)
