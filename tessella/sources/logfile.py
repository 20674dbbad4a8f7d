"""Database server logs as a data source: files are read by ranges of bytes, and filters on the pieces of a line are pushed into
the pattern that finds lines, so a line that they reject is never taken apart.

    register(spark)
    spark.read.format("logfile").load(path).where("year = '2024' AND level IN ('E', 'F')")

Pushed are equality and IN on year to fraction, zone, level and component; Spark evaluates other filters. A line
belongs to the range in which it starts, so lines and ranges may be of any length. Lines that aren't records come with
`corrupt` only, unless a filter was pushed, which they can't meet."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, IsNotNull

from tessella.sources import ranges

NUMBER, WORD = "[0-9]+", "[A-Za-z]+"
#: The pieces of a line, in order; the text before each one, and what the piece may be.
PIECES = {
    "year": ("", NUMBER),
    "month": ("-", NUMBER),
    "day": ("-", NUMBER),
    "hour": ("T", NUMBER),
    "minute": (":", NUMBER),
    "second": (":", NUMBER),
    "fraction": (r"\.", NUMBER),
    "zone": ("", f"Z|[-+]{NUMBER}"),
    "level": (" +", WORD),
    "component": (" +", f"-|{WORD}"),
}
#: The same for lines with times like `Tue Jan 2 03:04:05.678`, where year holds the day of the week.
PIECES_CTIME = {
    "year": ("", WORD),
    "month": (" +", WORD),
    "day": (" +", NUMBER),
    "hour": (" +", NUMBER),
    "minute": (":", NUMBER),
    "second": (":", NUMBER),
    "fraction": ("", rf"(?:\.{NUMBER})?"),
    "zone": ("", ""),
    "level": (" +", WORD),
    "component": (" +", f"-|{WORD}"),
}
REST = r" +\[([^\]]*)\] ?(.*)"
COLUMNS = ("file", "at", *PIECES, "context", "message", "corrupt")
#: A component that a line gives as `-`.
UNKNOWN = "UNKNOWN"


def line_pattern(allowed: dict[str, set[str]], ctime: bool = False, rest: str = REST) -> str | None:
    """The pattern of the lines whose pieces are among those allowed, for Python and for Spark; None if there can't be one."""
    out = []
    for name, (before, piece) in (PIECES_CTIME if ctime else PIECES).items():
        if name in allowed:
            texts = {t for v in allowed[name] for t in ({"-", UNKNOWN} if name == "component" and v == UNKNOWN else {v})}
            if ctime and name == "fraction":
                texts = {f".{t}" if t else "" for t in texts}
            fitting = sorted(t for t in texts if re.fullmatch(piece, t))
            if not fitting:
                return None
            piece = "|".join(map(re.escape, fitting))
        out.append(f"{before}({piece})")
    return "".join(out) + rest


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rangebytes", 64 << 20))
        self.timestamp = options.get("timestamp", "iso8601-local")
        self.allowed: dict[str, set[str]] = {}
        if self.timestamp == "iso8601-utc":
            self.allowed["zone"] = {"Z"}
        self.pushed = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        there = []
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PIECES and isinstance(f, (EqualTo, In)):
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.allowed[name] = self.allowed[name] & values if name in self.allowed else values
                self.pushed = True
            elif name in PIECES and isinstance(f, IsNotNull):
                there.append((name, f))
            else:
                yield f
        yield from (f for name, f in there if not self.pushed)

    def partitions(self) -> list[ranges.ByteRange]:
        return [part for name, size, _ in ranges.files(self.path) for part in ranges.split(name, 0, size, self.most)]

    def read(self, part: ranges.ByteRange) -> Iterator[pa.RecordBatch]:
        ctime = self.timestamp == "ctime"
        pattern = line_pattern(self.allowed, ctime)
        if part is None or pattern is None and self.pushed:
            return
        # without a pushed filter each line counts, with one only those that the pattern finds
        find = re.compile(f"^(?:{pattern or '(?!)'})\r?$".encode(), re.MULTILINE)
        for at, data in ranges.started(part):
            rows = self._found(find, data, at) if self.pushed else self._lines(find, data, at)
            columns = list(zip(*rows, strict=True)) or [[]] * (len(COLUMNS) - 1)
            if columns[0]:
                kinds = [pa.int64()] + [pa.string()] * (len(COLUMNS) - 2)
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(columns[0])), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], list(COLUMNS))

    def _record(self, m: re.Match) -> list[str | None] | None:
        pieces = [g.decode("utf-8", "replace") for g in m.groups(b"")]
        if self.timestamp == "iso8601-local" and pieces[7] == "Z":
            return None
        pieces[6] = pieces[6].lstrip(".")
        pieces[9] = UNKNOWN if pieces[9] == "-" else pieces[9]
        pieces[11] = pieces[11].rstrip("\r")
        return [*pieces, None]

    def _found(self, find: re.Pattern, data: bytes, at: int) -> list[tuple]:
        return [(at + m.start(), *r) for m in find.finditer(data) if (r := self._record(m))]

    def _lines(self, find: re.Pattern, data: bytes, at: int) -> list[tuple]:
        out, none = [], [None] * (len(PIECES) + 2)
        for line in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
            m = find.match(line)
            out.append((at, *(m and self._record(m) or [*none, line.rstrip(b"\r").decode("utf-8", "replace")])))
            at += len(line) + 1
        return out


class LogFiles(DataSource):
    """Options: path, rangebytes (64 MB), timestamp (iso8601-local, iso8601-utc or ctime)."""

    @classmethod
    def name(cls) -> str:
        return "logfile"

    def schema(self) -> str:
        return ", ".join(f"{c} {'long' if c == 'at' else 'string'}" for c in COLUMNS)

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters into sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogFiles)
