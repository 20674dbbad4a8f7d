"""Log search: lines to typed fields to filtered records, as regular expressions over a text column.

Two formats: database server lines, one record a line; and application entries that may span lines (an entry starts at a
line that starts with a date). Differences to a strict parser, on purpose: offsets of either sign, empty messages stay
empty, entries without an error are records too, and a filter's missing key is no constraint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import cut
from tessella.sources import logfile

# Token kinds in order of precedence, and severities.
TOKEN_KINDS = (
    ("NUMBER", r"[0-9]+"),
    ("DOT", r"\."),
    ("HYPHEN", r"-"),
    ("STAR", r"\*"),
    ("PLUS", r"\+"),
    ("FSLASH", r"/"),
    ("COLON", r":"),
    ("EQUALS", r"="),
    ("PIPE", r"\|"),
    ("QUOTE", r"['\"]"),
    ("PAREN", r"[()]"),
    ("CBRACKET", r"[{}]"),
    ("SBRACKET", r"[\[\]]"),
    ("COMMA", r","),
    ("WORD", r"[A-Za-z]+"),
)
SEVERITIES = {"D": ("Debug", 1), "I": ("Informational", 2), "W": ("Warning", 3), "E": ("Error", 4), "F": ("Fatal", 5)}
ANY_TOKEN = r"[0-9]+|[A-Za-z]+|[^ \t\n]"
MONGO = r"^([0-9]+)-([0-9]+)-([0-9]+)T([0-9]+):([0-9]+):([0-9]+)\.([0-9]+)(Z|[-+][0-9]+) +([A-Za-z]+) +(-|[A-Za-z]+) +\[([^\]]*)\] ?(.*)$"
CTIME = r"^([A-Za-z]+) +([A-Za-z]+) +([0-9]+) +([0-9]+):([0-9]+):([0-9]+)(?:\.([0-9]+))?() +([A-Za-z]+) +(-|[A-Za-z]+) +\[([^\]]*)\] ?(.*)$"
NODE = r"^([0-9]+)-([0-9]+)-([0-9]+) +([0-9]+):([0-9]+):([0-9]+) +([A-Za-z]+) ?(?:\[ ?([0-9]+) ?\])? ?:? *([^\n]*)"


def tokens(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, pos, typ, value): the tokens of a text, blanks left out."""
    each = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(ANY_TOKEN), F.lit(0))).alias("pos", "value"))
    kind = F.lit("MISMATCH")
    for name, pattern in reversed(TOKEN_KINDS):
        kind = F.when(F.col("value").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return each.select(*keys, "pos", kind.alias("typ"), "value")


def joined_tokens(text: Column, separator: str = " ") -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(ANY_TOKEN), F.lit(0)), separator)


def severity(level: Column) -> Column:
    """struct<level, name, value>; other levels are Unknown, 0."""
    # maps, as a pushed filter would evaluate the level in each branch of a CASE
    names, values = (F.create_map(*[F.lit(x) for k, v in SEVERITIES.items() for x in (k, v[i])]) for i in (0, 1))
    found = lambda m, other: F.coalesce(F.try_element_at(m, level), F.lit(other))
    return F.struct(level.alias("level"), found(names, "Unknown").alias("name"), found(values, 0).alias("value"))


def parse_mongo(lines: DataFrame, column: str = "value", timestamp: str = "iso8601-local", fail_fast: bool = False) -> DataFrame:
    """The lines with date, time, offset, severity, component, context, message and `corrupt` (the line, if it isn't a
    record). fail_fast raises at the first such line."""
    pattern = CTIME if timestamp == "ctime" else MONGO
    # one replacement captures all groups: of the first ten none holds a line break, the context holds no bracket
    captured = F.regexp_replace(column, pattern, "\n".join(f"${i}" for i in range(1, 12)) + "]$12")
    split = lines.select("*", F.col(column).rlike(pattern).alias("tsl_good"), F.split(captured, "\n", 11).alias("tsl_parts"))
    good, part = F.col("tsl_good"), lambda i: F.get("tsl_parts", i - 1)
    context = F.substring_index(part(11), "]", 1)
    if timestamp == "iso8601-utc":
        good &= part(8) == "Z"
    elif timestamp == "iso8601-local":
        good &= part(8) != "Z"
    if fail_fast:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not a log record: "), F.col(column))).cast("boolean"))
    keep = lambda c: F.when(good, c)
    return split.select(
        *[F.col(f"`{c}`") for c in lines.columns],
        keep(F.array(part(1), part(2), part(3))).alias("date"),
        keep(F.array(part(4), part(5), part(6), part(7))).alias("time"),
        keep(part(8)).alias("offset"),
        keep(severity(part(9))).alias("severity"),
        keep(F.when(part(10) == "-", "UNKNOWN").otherwise(part(10))).alias("component"),
        keep(joined_tokens(context, "")).alias("context"),
        keep(joined_tokens(F.substring(part(11), F.length(context) + 2, F.length(part(11))))).alias("message"),
        F.when(~good, F.col(column)).alias("corrupt"),
    )


def event_time(record_date: Column, record_time: Column) -> Column:
    """A real timestamp from the parsed pieces; null where they are none."""
    return F.try_to_timestamp(F.concat(F.array_join(record_date, "-"), F.lit(" "), F.array_join(F.slice(record_time, 1, 3), ":")), F.lit("yyyy-M-d H:m:s"))


def _prefix(pieces: Column, wanted) -> Column:
    return F.slice(pieces, 1, len(wanted)) == F.array(*[F.lit(str(x)) for x in wanted])


def severity_filter(level: Column, wanted: dict) -> Column:
    """By level, else name, else value; none of them matches nothing."""
    for key in ("level", "name", "value"):
        if wanted.get(key) is not None:
            return level[key] == wanted[key]
    return F.lit(False)


def mongo_filter(wanted: dict) -> Column:
    """A search filter as one Column: date and time match by prefix, other fields exactly; missing or empty: any. What
    needs few pieces of a line comes first, as a pushed filter captures the line anew for each piece."""
    out = F.lit(True)
    if wanted.get("severity"):
        out &= severity_filter(F.col("severity"), wanted["severity"])
    for key in ("line_num", "component", "context"):
        if wanted.get(key):
            out &= F.col(key) == wanted[key]
    for key in ("date", "time"):
        if wanted.get(key) and wanted[key][0]:
            out &= _prefix(F.col(key), wanted[key])
    return out


def wanted_pieces(wanted: dict) -> dict[str, set[str]]:
    """What a filter asks of the pieces of a line, as they are written: all records that it lets through have them."""
    out: dict[str, set[str]] = {}
    for key, names in (("date", ("year", "month", "day")), ("time", ("hour", "minute", "second", "fraction"))):
        if wanted.get(key) and wanted[key][0]:
            out |= {name: {str(x)} for name, x in zip(names, wanted[key], strict=False)}
    if severity := wanted.get("severity"):
        key = next((k for k in ("level", "name", "value") if severity.get(k) is not None), None)
        if key == "level":
            out["level"] = {severity[key]}
        elif found := {level for level, (name, value) in SEVERITIES.items() if severity.get(key) in (name, value)}:
            out["level"] = found  # other names and values are those of unknown levels
    if wanted.get("component"):
        out["component"] = {wanted["component"]}
    return out


def search(lines: DataFrame, wanted: dict | None, column: str = "value", timestamp: str = "iso8601-local") -> DataFrame:
    """The records of lines that a filter lets through. A line is tested by one anchored pattern, made from the filter, before
    it is taken apart, so lines that the filter rejects cost no captures."""
    if pieces := wanted_pieces(wanted or {}):
        pattern = logfile.line_pattern(pieces, timestamp == "ctime", "")
        lines = lines.where(F.col(column).rlike(f"^{pattern}") if pattern else F.lit(False))
    records = parse_mongo(lines, column, timestamp)
    return records.where(mongo_filter(wanted)) if wanted else records


def scan_logs(spark: SparkSession, path: str, wanted: dict | None = None, timestamp: str = "iso8601-local", range_bytes: int = 64 << 20) -> DataFrame:
    """The records of files read by the logfile source, with file and `at` (the place of their lines): date and time, severity
    and component of the filter are pushed into it."""
    logfile.register(spark)
    rows = spark.read.format("logfile").option("timestamp", timestamp).option("rangebytes", range_bytes).load(path)
    for name, values in wanted_pieces(wanted or {}).items():
        rows = rows.where(F.col(name).isin(*sorted(values)))
    there = F.col("corrupt").isNull()
    keep = lambda c: F.when(there, c)
    records = rows.select(
        "file",
        "at",
        keep(F.array("year", "month", "day")).alias("date"),
        keep(F.array("hour", "minute", "second", "fraction")).alias("time"),
        F.col("zone").alias("offset"),
        keep(severity(F.col("level"))).alias("severity"),
        "component",
        keep(joined_tokens(F.col("context"), "")).alias("context"),
        keep(joined_tokens(F.col("message"))).alias("message"),
        "corrupt",
    )
    return records.where(mongo_filter(wanted)) if wanted else records


def as_json(records: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per record; severities as `(I, 2, Informational)`."""
    shown = [F.format_string("(%s, %d, %s)", F.col(f"{c}.level"), F.col(f"{c}.value"), F.col(f"{c}.name")).alias(c) if c == "severity" else F.col(c) for c in columns]
    return records.select(F.to_json(F.struct(*shown)).alias("json"))


def parse_node(df: DataFrame, column: str = "entry") -> DataFrame:
    """Entries with date, time, level, status, message and error.

    An error entry with a status is an interface error: trace (a map; empty values are 'null') and stack name. Without
    one it is a code error: name, code, message, frames; if lines stand before the `Name: message` line they are
    compile_time; lines between message and frames of a SyntaxError are its block."""
    e = F.col(column)
    part = lambda i: F.regexp_extract(e, NODE, i)
    level, status = part(7), F.nullif(part(8), F.lit(""))
    body = F.regexp_extract(e, r"(?s)^[^\n]*\n(.*)$", 1)
    is_error = level == "error"
    api, code = is_error & status.isNotNull(), is_error & status.isNull()
    raw = F.regexp_extract(body, r"Trace *: *\{([^}]*)\}", 1)
    pairs = F.filter(F.split(raw, ","), lambda p: p.contains(":"))
    clean = lambda s: F.regexp_replace(s, r"\s", "")
    trace = F.map_from_arrays(
        F.transform(pairs, lambda p: clean(F.substring_index(p, ":", 1))),
        F.transform(pairs, lambda p: F.coalesce(F.nullif(clean(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)), F.lit("")), F.lit("null"))),
    )
    before = F.regexp_extract(body, r"(?s)^(.*?)\n?(?:Trace|$)", 1)
    named = r"(?m)^([A-Za-z]+) ?(?:\[([^\]]*)\])? ?: ?([^\n]*)"
    name, err_code, message = (F.regexp_extract(before, named, i) for i in (1, 2, 3))
    leading = F.regexp_extract(before, r"(?s)^(.*?)(?:^|\n)[A-Za-z]+ ?(?:\[[^\]]*\])? ?:", 1)
    frames = F.regexp_extract_all(before, F.lit(r"(?m)^ *(?:at|From) +([^\n]*)"), F.lit(1))
    frame = F.transform(
        frames,
        lambda f: F.struct(
            clean(F.regexp_replace(f, r"\(?[^\s()]*\.js:[0-9]+:[0-9]+\)?", "")).alias("name"),
            F.nullif(F.regexp_extract(f, r"([^\s()]*\.js):[0-9]+:[0-9]+", 1), F.lit("")).alias("file"),
            F.regexp_extract(f, r"\.js:([0-9]+):[0-9]+", 1).try_cast("int").alias("line"),
            F.regexp_extract(f, r"\.js:[0-9]+:([0-9]+)", 1).try_cast("int").alias("col"),
        ),
    )
    after = F.regexp_extract(before, r"(?s)SyntaxError[^\n]*\n(.*?)(?:\n *(?:at|From) |$)", 1)
    block = F.transform(F.filter(F.split(after, "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.trim(F.substring_index(x, "|", 1)), F.lit(" | "), clean(F.regexp_extract(x, r"\|(.*)$", 1))))
    stack_name = F.regexp_extract(body, r"Stack *: *([A-Za-z]+) *:", 1)
    error = F.when(
        is_error,
        F.struct(
            F.when(api, stack_name).otherwise(name).alias("name"),
            F.when(code, F.nullif(err_code, F.lit(""))).alias("code"),
            F.when(api, F.regexp_extract(body, r"Stack *: *[A-Za-z]+ *: *([^\n]*)", 1)).otherwise(message).alias("message"),
            F.when(code, F.nullif(F.trim(leading), F.lit(""))).alias("compile_time"),
            F.when(api, trace).alias("trace"),
            F.when(code, frame).alias("frames"),
            F.when(code & (name == "SyntaxError"), F.array_join(block, "\n")).alias("block"),
        ),
    )
    return df.select(
        "*",
        F.array(part(1), part(2), part(3)).alias("date"),
        F.array(part(4), part(5), part(6)).alias("time"),
        level.alias("level"),
        F.coalesce(status, F.lit("UNKOWN")).alias("status"),
        joined_tokens(part(9)).alias("message"),
        error.alias("error"),
    )


def shown_frames(error: Column) -> Column:
    """At most five frames as `name (file:line:col)`."""
    return F.transform(F.slice(error["frames"], 1, 5), lambda f: F.concat(f["name"], F.coalesce(F.concat(F.lit(" ("), f["file"], F.lit(":"), f["line"].cast("string"), F.lit(":"), f["col"].cast("string"), F.lit(")")), F.lit(""))))


def node_filter(wanted: dict) -> Column:
    """As mongo_filter, with entry_num, level, status, error {name, is_api_error, is_compile_time} and trace keys."""
    out = F.lit(True)
    for key in ("date", "time"):
        if wanted.get(key) and wanted[key][0]:
            out &= _prefix(F.col(key), wanted[key])
    for key in ("entry_num", "line_num", "level", "status"):
        if wanted.get(key):
            out &= F.col(key) == wanted[key]
    if error := wanted.get("error"):
        out &= F.col("error").isNotNull()
        if error.get("name"):
            out &= F.col("error.name") == error["name"]
        if "is_api_error" in error:
            out &= F.col("error.trace").isNotNull() == bool(error["is_api_error"])
        if "is_compile_time" in error:
            out &= F.col("error.compile_time").isNotNull() == bool(error["is_compile_time"])
    for key, value in (wanted.get("trace") or {}).items():
        out &= F.coalesce(F.try_element_at(F.col("error.trace"), F.lit(key)) == str(value), F.lit(False))
    return out


#: Up to so many blocks (a row of three numbers and a path each) the lines before each block are broadcast.
MOST_BLOCKS = 500_000


BLOCK = ("file", "start", "task")


def _block_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the block they are read in, and `at`: consecutive numbers within a block, whose order is that of lines."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _few(blocks: DataFrame) -> DataFrame:
    return F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks


def _place() -> Column:
    """A line's place within its block, from 0; an error if the block isn't the one that was counted."""
    place = F.col("at") - F.col("first")
    return F.when((place >= 0) & (place < F.col("n")), place).otherwise(F.raise_error(F.lit("files were split anew while their lines were numbered")).cast("long"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_num, value) of text files, lines numbered from 1. A file is read in blocks by many tasks: each
    block's lines are counted, the counts summed in the blocks' order, and only these sums meet the lines. If the files or
    the way they are split change between both reads, the query fails."""
    lines = _block_lines(spark, path)
    counts = lines.groupBy(*BLOCK).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut(counts.select(*BLOCK, "first", "n", before.alias("before")))
    return lines.join(_few(sums), list(BLOCK), "left").select("file", (F.col("before") + _place() + 1).alias("line_num"), "value")


#: A line with which an entry starts.
ENTRY_START = r"^[0-9]+-[0-9]+-[0-9]+ "


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start, task, at, value) to the entries that start in them: file, start, task, at, nth of its block, entry,
    last (of its block). Lines before a block's first entry are left out."""
    held: tuple | None = None  # block, at, nth, pieces: the entry that lines are added to
    block, nth = None, 0

    def whole(last: bool) -> pa.RecordBatch:
        own, at, n, pieces = held
        lines = pa.concat_arrays(pieces)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")
        return batch_of([own[0]], [own[1]], [own[2]], [at], [n], text, [last])

    def batch_of(*columns) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "task", "at", "nth", "entry", "last"])

    for batch in batches:
        file, start, task, at, value = batch.columns
        begins = pc.match_substring_regex(value, ENTRY_START)
        first = [0] + [i + 1 for i in pc.indices_nonzero(pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))).to_pylist()] if len(batch) else []
        for a, b in zip(first, [*first[1:], len(batch)], strict=True):  # a block's lines
            own = (file[a].as_py(), start[a].as_py(), task[a].as_py())
            if own != block:
                if held:
                    yield whole(True)
                held, block, nth = None, own, 0
            starts = [a + i for i in pc.indices_nonzero(begins.slice(a, b - a)).to_pylist()]
            if held and (n := (starts[0] if starts else b) - a):
                held[3].append(value.slice(a, n))
            if not starts:
                continue
            if held:
                yield whole(False)
            if len(starts) > 1:
                ends = pa.array([s - starts[0] for s in starts], pa.int32())
                texts = pc.binary_join(pa.ListArray.from_arrays(ends, value.slice(starts[0], starts[-1] - starts[0])), "\n")
                n = len(texts)
                yield batch_of([own[0]] * n, [own[1]] * n, [own[2]] * n, at.take(pa.array(starts[:-1])), range(nth + 1, nth + 1 + n), texts, [False] * n)
            nth += len(starts)
            held = (own, at[starts[-1]].as_py(), nth, [value.slice(starts[-1], b - starts[-1])])
    if held:
        yield whole(True)


@contextmanager
def _blocks_of(spark: SparkSession, size: int):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_entries(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """(file, entry_num, line_num, entry): the lines of text files put together; an entry starts at a line with a date, what
    stands before a file's first one is dropped.

    A file is read in blocks by many tasks, and no block waits for another one: a block's task puts together the entries
    that start in it. What stands before its first entry belongs to the last entry of the nearest earlier block that has
    one; only these lines are shuffled, to where that entry is. Numbers come from sums over blocks. With block_bytes blocks are
    of that size and the result is stored."""
    if block_bytes:
        with _blocks_of(spark, block_bytes):
            return cut(file_entries(spark, path))
    lines = _block_lines(spark, path)
    starts = F.col("value").rlike(ENTRY_START)
    counts = lines.groupBy(*BLOCK).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.count_if(starts).alias("entries"), F.min(F.when(starts, F.col("at"))).alias("head_end"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    owner = F.last(F.when(F.col("entries") > 0, F.col("start")), ignorenulls=True).over(before)
    blocks = cut(counts.select("*", summed("n").alias("lines_before"), summed("entries").alias("entries_before"), owner.alias("owner")))
    mine = _few(blocks)
    found = lines.mapInArrow(_gathered, "file string, start long, task int, at long, nth long, entry string, last boolean").join(mine, list(BLOCK), "left")
    rows = found.select("file", "start", "last", (F.col("entries_before") + F.col("nth")).alias("entry_num"), (F.col("lines_before") + _place() + 1).alias("line_num"), "entry")
    heads = blocks.where("owner is not null and (head_end is null or head_end > first)")
    if heads.isEmpty():
        return rows.select("file", "entry_num", "line_num", "entry")
    loose = lines.join(_few(heads.select(*BLOCK, "head_end", "owner")), list(BLOCK)).where("head_end is null or at < head_end")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "value"))), lambda x: x["value"]), "\n")
    rests = cut(loose.groupBy("file", F.col("owner").alias("start")).agg(joined.alias("rest")).withColumn("last", F.lit(True)))
    small = rests.agg(F.coalesce(F.sum(F.length("rest")), F.lit(0))).first()[0] <= MOST_BLOCKS * 40
    whole = F.when(F.col("rest").isNull(), F.col("entry")).otherwise(F.concat_ws("\n", "entry", "rest"))
    return rows.join(F.broadcast(rests) if small else rests, ["file", "start", "last"], "left").select("file", "entry_num", "line_num", whole.alias("entry"))


def find_logs(spark: SparkSession, path: str, wanted: dict | None = None, parser: str = "mongo", middle_start: bool = False, numbered: bool = False, block_bytes: int | None = None) -> DataFrame:
    """Scan, parse and filter a log file or folder. middle_start drops each file's first line, which may be a part.
    Node entries always carry file and line_num (from 1), records of the other format with numbered, or if one of both
    arguments needs it: lines are then read twice."""
    if parser.lower() == "node":
        rows = parse_node(file_entries(spark, path, block_bytes))
        return rows.where(node_filter(wanted)) if wanted else rows
    if not (numbered or middle_start or (wanted or {}).get("line_num")):
        return search(spark.read.text(path), wanted)
    lines = numbered_lines(spark, path)
    return search(lines.where("line_num > 1 AND value <> ''") if middle_start else lines, wanted)
