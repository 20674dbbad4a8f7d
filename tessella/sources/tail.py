"""Growing text files as a stream: a Python data source over byte ranges, for a file or a folder.

The driver only asks for names and sizes. A batch reaches from the sizes that the last one saw to those of now, and its
bytes are dealt to tasks in ranges. A line belongs to the range that holds its line feed; a task whose range begins within a line
looks back for its start. So a line in the making comes once, whole, with its end, however long it is, and no state but
the sizes is needed: a restart replays the same ranges. A file that is new, smaller than before, or another one under the same name
(a local file's inode tells) is read from its start. Files that go are forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from tessella.sources import ranges


class TailReader(DataSourceStreamReader):
    """An offset is {"files": JSON of {name: [identity, size]}}."""

    def __init__(self, options: dict):
        self.path, self.start, self.most = options["path"], options.get("start", "end"), int(options.get("rangebytes", 64 << 20))

    def latestOffset(self) -> dict:
        return {"files": json.dumps({name: [identity, size] for name, size, identity in ranges.files(self.path)}, sort_keys=True)}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "end" else {"files": "{}"}

    def partitions(self, start: dict, end: dict) -> list[ranges.ByteRange]:
        before, out = json.loads(start["files"]), []
        for name, (identity, size) in json.loads(end["files"]).items():
            known, at = before.get(name, (identity, 0))
            at = at if known == identity and at <= size else 0
            out += ranges.split(name, at, size, self.most)
        return out

    def read(self, part: ranges.ByteRange) -> Iterator[pa.RecordBatch]:
        for at, data in ranges.ended(part):
            lines = data.split(b"\n")[:-1]
            places = []
            for line in lines:
                places.append(at)
                at += len(line) + 1
            texts = [line.rstrip(b"\r").decode("utf-8", "replace") for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(lines)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["file", "offset", "value"])


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", ...).option("start", "end" or "begin").load(); option rangebytes
    (64 MB): what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def read_section(spark: SparkSession, path: str, start: int, end: int):
    """(line_num, line) of the bytes from start up to end of each file below path."""
    from pyspark.sql import functions as F

    text = F.decode(F.substring("content", start + 1, max(end - start, 0)), "UTF-8")
    return spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(text, "\n")).alias("line_num", "line"))
