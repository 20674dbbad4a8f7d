"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards, in a map-only job; each arrival is a version of its own. A
manifest is the list of live shards of one version; it is written aside and committed by one rename that fails if that
version exists, so of two writers one wins, and the other puts its change on top of the new version. Readers see the old
version or the new one, never a mixture. Compaction puts shards of similar size (tiers by powers of `fanout`) in order of
arrival into runs of about `target_bytes`, merges all runs of all tiers in one job, splits shards of over twice the
target, and commits a manifest without its inputs.

Nothing is removed on the way: readers of an old version and writers that have not committed yet keep their files.
`vacuum` removes versions that are old enough, and the shards that only such versions list.

The driver holds one name and size per shard, as Spark's own file listing does (100 TB in shards of 64 MB: 1.6 million
names); rows never pass through it.

Defined cases: an empty table is a manifest without shards; null ids and texts are stored as they are; repeated rows are
stored each; all columns are stored, whatever their names, but names that start with `tsl_` raise a ValueError.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import work_path


#: Up to so many shards, their names are broadcast; beyond it the join shuffles.
MOST_BROADCAST = 100_000


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Versioned shards below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4, least_bytes: int = 64 << 10):
        self.spark, self.root, self.target_bytes, self.fanout, self.least_bytes = spark, root.rstrip("/"), target_bytes, fanout, least_bytes
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"path", "bytes", "seq"}]} of a version, the latest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        name = f"{self.root}/manifest/v{(version if version is not None else known[-1]):09d}.json"
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Publish the version after base; Conflict if it exists already."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        folder = f"{self.root}/manifest"
        aside, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/v{new['version']:09d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        full = self._fs.makeQualified(final)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(aside), full, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} exists") from error
            raise
        return new

    def publish(self, change: Callable[[dict], list[dict]], schema: str, tries: int = 20) -> dict:
        """Commit the shards that change makes of the latest manifest; after a conflict, of the next one."""
        for _ in range(tries):
            base = self.manifest()
            try:
                return self.commit(base, change(base), schema)
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    def _written(self, folder: str) -> list[dict]:
        """The shards of a finished write, in order of their names; empty files are left out."""
        if not self._fs.exists(self._path(folder)):
            return []
        files, found = self._fs.listFiles(self._path(folder), True), []
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().startswith("part-"):
                found.append((status.getPath().toString(), status.getLen()))
        return [{"path": p, "bytes": n} for p, n in sorted(found)]

    @staticmethod
    def _after(shards: list[dict], new: list[dict]) -> list[dict]:
        first = max((s["seq"] for s in shards), default=-1) + 1
        return shards + [{**s, "seq": first + i} for i, s in enumerate(new)]

    def append(self, arrivals: DataFrame) -> dict:
        """Add rows as small shards: one version."""
        return self.append_each(arrivals)

    def append_each(self, arrivals: DataFrame, batch: str | None = None) -> dict:
        """Add the arrivals of each value of `batch`, a column that is not stored, as a version of its own, in order of
        the values; all are written in one job."""
        reserved = [c for c in arrivals.columns if c.lower().startswith("tsl_") and c != batch]
        if reserved:
            raise ValueError(f"reserved column names: {reserved}")
        folder = f"{self.root}/data/append-{uuid.uuid4().hex}"
        if batch is None:
            stored, folders = arrivals, [folder]
            arrivals.write.option("compression", "zstd").parquet(folder)
        else:
            stored = arrivals.drop(batch)
            arrivals.withColumnRenamed(batch, "tsl_batch").write.option("compression", "zstd").partitionBy("tsl_batch").parquet(folder)
            folders = sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        held = self.manifest()
        for one in folders or [folder]:
            new = self._written(one)
            held = self.publish(lambda base, new=new: self._after(base["shards"], new), stored.schema.json())
        return held

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.least_bytes, self.fanout))) if size > self.least_bytes else 0

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: consecutive shards of one tier, filled up to the target; a run that stays short of it needs
        `fanout` shards. Shards of three quarters of the target are done."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["seq"]):
            if s["bytes"] < 0.75 * self.target_bytes:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for _, own in sorted(tiers.items()):
            run, size = [], 0
            for s in own:
                if run and size + s["bytes"] > 1.25 * self.target_bytes:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= self.fanout or size >= 0.75 * self.target_bytes:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def plan(self, shards: list[dict]) -> list[tuple[list[dict], int]]:
        """(run, number of files it becomes): runs to merge, and single shards of over twice the target to split, once."""
        split = [([s], round(s["bytes"] / self.target_bytes)) for s in shards if s["bytes"] > 2 * self.target_bytes and not s.get("whole")]
        return [(run, 1) for run in self.runs(shards)] + split

    def compact_once(self) -> bool:
        """Merge all runs and split what is too large, in one job and one commit; whether there was anything to do."""
        base = self.manifest()
        runs = self.plan(base["shards"])
        if not runs:
            return False
        folder, names, tasks = f"{self.root}/data/merge-{uuid.uuid4().hex}", [], 0
        for run, pieces in runs:
            names += [(self._name(s["path"]), tasks, pieces) for s in run]
            tasks += pieces
        places = self._places(names, tsl_first=pa.int32(), tsl_pieces=pa.int32())
        rows = self._rows(base["schema"], [s["path"] for run, _ in runs for s in run])
        columns = [F.col(f"`{c}`") for c in rows.columns]
        piece = F.col("tsl_first") + F.pmod(F.col("tsl_index"), F.col("tsl_pieces")).cast("int")
        marked = rows.select("*", self._row_name(rows), rows.metadataColumn("_metadata")["row_index"].alias("tsl_index"))
        placed = marked.join(self._few(places, len(names)), "tsl_name").select(*columns, piece.alias("tsl_task"))
        # the task's number is given: each task writes one file, without sorting
        placed.repartitionById(tasks, "tsl_task").drop("tsl_task").write.option("compression", "zstd").parquet(folder)
        whole = tasks - sum(pieces for _, pieces in runs if pieces > 1)  # tasks from here on write pieces
        merged = [{**s, "whole": int(s["path"].rpartition("/")[2].split("-")[1]) >= whole} for s in self._written(folder)]
        gone = {s["path"] for run, _ in runs for s in run}
        # counts come from the footers
        taken, put = (self._rows(base["schema"], paths).count() for paths in (sorted(gone), [s["path"] for s in merged]))
        if taken != put:
            raise RuntimeError(f"{folder} has {put} rows of {taken}; its inputs stay")

        def change(held: dict) -> list[dict]:
            if not gone <= {s["path"] for s in held["shards"]}:
                raise RuntimeError("another compaction has taken these shards")
            return self._after([s for s in held["shards"] if s["path"] not in gone], merged)

        self.publish(change, base["schema"])
        return True

    def compact(self) -> dict:
        """Merge until no run is left."""
        while self.compact_once():
            pass
        return self.manifest()

    def _name(self, path: str) -> str:
        """A shard's path below the store's data folder, escaped as in _metadata.file_path; no folder in it is named data."""
        return self._path(path).toUri().getRawPath().rpartition("/data/")[2]

    @staticmethod
    def _row_name(rows: DataFrame) -> Column:
        return F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], r"^.*/data/(.*)$", 1).alias("tsl_name")

    def _places(self, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
        """Rows of tsl_name and the columns of kinds, as an Arrow table: of tuples, Python workers would make a DataFrame."""
        schema = pa.schema({"tsl_name": pa.string()} | kinds)
        return self.spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema))

    @staticmethod
    def _few(places: DataFrame, size: int) -> DataFrame:
        return F.broadcast(places) if size <= MOST_BROADCAST else places

    def _rows(self, schema: str, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        held = self.manifest(version)
        return self._rows(held["schema"], [s["path"] for s in held["shards"]])

    def read_placed(self, version: int | None = None) -> DataFrame:
        """The rows of a version with tsl_shard, their shard's number by order of arrival, and tsl_bytes, its size."""
        held = self.manifest(version)
        if not held["shards"]:
            return self.read(version).select("*", F.lit(0).cast("long").alias("tsl_shard"), F.lit(0).cast("long").alias("tsl_bytes"))
        order = sorted(held["shards"], key=lambda s: s["seq"])
        places = self._places([(self._name(s["path"]), i, s["bytes"]) for i, s in enumerate(order)], tsl_shard=pa.int64(), tsl_bytes=pa.int64())
        rows = self._rows(held["schema"], [s["path"] for s in order])
        placed = rows.select("*", self._row_name(rows)).join(self._few(places, len(order)), "tsl_name", "left")
        number = F.when(F.col("tsl_shard").isNull(), F.raise_error(F.concat(F.lit("no shard is named "), "tsl_name"))).otherwise(F.col("tsl_shard"))
        return placed.withColumn("tsl_shard", number).drop("tsl_name")

    def vacuum(self, keep: int = 1, least_age: float = 7 * 86_400, orphans: float | None = None) -> int:
        """Remove versions before the last `keep` that were followed by another one at least `least_age` seconds ago,
        and the shards that only such versions list; the number of removed shards. With `orphans`, files that no
        version lists go too once they are so many seconds old, which must be longer than any write takes."""
        known, now = self.versions(), time.time()
        age = lambda path: now - self._fs.getFileStatus(path).getModificationTime() / 1000
        name = lambda v: self._path(f"{self.root}/manifest/v{v:09d}.json")
        old = [v for v, after in zip(known[: -keep or None], known[1:], strict=False) if age(name(after)) >= least_age]
        listed = {v: {s["path"] for s in self.manifest(v)["shards"]} for v in known}
        live = set().union(*[listed[v] for v in known if v not in old])
        dead = set().union(*[listed[v] for v in old]) - live
        removed = sum(bool(self._fs.delete(self._path(p), False)) for p in sorted(dead))
        for v in old:
            self._fs.delete(name(v), False)
        folder = self._path(f"{self.root}/data")
        if orphans is not None and self._fs.exists(folder):
            live = {self._path(p).toUri().getPath() for p in live}
            for one in self._written(folder.toString()):
                path = self._path(one["path"])
                if path.toUri().getPath() not in live and age(path) >= orphans:
                    removed += bool(self._fs.delete(path, False))
        return removed


def shard(docs: DataFrame, root: str, arrivals: int = 4, **options) -> ShardStore:
    """Store docs below a new root as if they had come in `arrivals` batches (by a hash of the id), then compact. Nobody
    else knows the new store yet, so versions are removed as soon as the next one stands."""
    store = ShardStore(docs.sparkSession, root, **options)
    store.append_each(docs.withColumn("tsl_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), "tsl_arrival")
    while store.compact_once():
        store.vacuum(keep=1, least_age=0)
    return store


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), work_path(spark, "shards"))
    return store.read_placed().select("doc_id", F.col("tsl_shard").alias("shard"), F.col("tsl_bytes").alias("shard_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
