"""Message events: progress rows, dispatch, and at most one active event per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"reverse": "ReverseMessage", "compress": "CompressMessage", "yell": "YellMessage"}


def kind_of(name: Column) -> Column:
    """Case-insensitive; unknown kinds are reverse."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.isin(*KINDS), low).otherwise(F.lit("reverse"))


def applied(kind: Column, text: Column) -> Column:
    """What an event of a kind makes of a message, or of its first characters."""
    return F.when(kind == "yell", F.upper(text)).when(kind == "compress", F.regexp_replace(F.lower(text), "[^a-z]", "")).otherwise(F.reverse(text))


def percent(i: Column, n: Column) -> Column:
    """Whole percent, as floating point gives it: i / n first."""
    return F.floor(i / n * 100).cast("int")


def progress(requests: DataFrame, cancel_at: str | None = None) -> DataFrame:
    """(id, name, status, step, message, percent, complete): a row per character, then DONE with the whole result; with a
    column of cancel positions, CANCELED and DONE with the part that was reached."""
    rows = requests.select("id", kind_of(F.col("type")).alias("kind"), F.coalesce("message", F.lit("")).alias("message"), (F.col(cancel_at) if cancel_at else F.lit(None)).cast("int").alias("stop"))
    n = F.length("message")
    reached = F.least(F.coalesce("stop", n), n)
    steps = F.when(reached > 0, F.sequence(F.lit(1), reached)).otherwise(F.array().cast("array<int>"))
    done = lambda i: applied(F.col("kind"), F.substring(F.col("message"), F.lit(1), i))
    update = lambda status, step, text, p: F.struct(F.lit(status).alias("status"), step.cast("int").alias("step"), text.alias("message"), p.cast("int").alias("percent"))
    none = F.lit(None)
    running = F.transform(steps, lambda i: update("RUNNING", i, done(i), percent(i, n)))
    last = F.when(reached < n, F.array(update("CANCELED", reached + 1, F.lit("cancelling"), none), update("DONE", reached + 2, done(reached), none))).otherwise(F.array(update("DONE", reached + 1, done(reached), none)))
    name = F.lit(None).cast("string")
    for k, v in KINDS.items():
        name = F.when(F.col("kind") == k, v).otherwise(name)
    return rows.select("id", name.alias("name"), F.explode(F.concat(running, last)).alias("u")).select("id", "name", "u.*", (F.col("u.status") == "DONE").alias("complete"))


def started(requests: DataFrame, order: str) -> DataFrame:
    """The requests that start an event: the first of each id among those of one batch, in which nothing ends."""
    first = Window.partitionBy("id").orderBy(order)
    return requests.withColumn("tsl_rank", F.row_number().over(first)).where("tsl_rank = 1").drop("tsl_rank")


def results(requests: DataFrame) -> DataFrame:
    """(id, name, message): what each started event ends with."""
    kind = kind_of(F.col("type"))
    return requests.select("id", kind.alias("kind"), applied(kind, F.coalesce("message", F.lit(""))).alias("message"))
