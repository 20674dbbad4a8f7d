"""Queries over the driver's tables and the SQL that gives the same rows. All of them read whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arrays, numbers, strings
from tessella.operators import events, html, images, learning, logs, similarity, stores, trees, web
from tessella.plans import image_pipeline, predicate
from tessella.session import load, work_path
from tessella.streaming import bus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query(
    "dyn1_word_similarity",
    """
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z'']+') AS ws FROM documents)
), n AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS n1, lead(word, 2) OVER o AS n2,
         CASE WHEN i > 1 THEN lag(word, 1) OVER o END AS p1, CASE WHEN i > 2 THEN lag(word, 2) OVER o END AS p2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), own AS (
  SELECT doc_id, word, count(*) AS c, sum((n1 IS NOT DISTINCT FROM word)::INT + (n2 IS NOT DISTINCT FROM word)::INT + (p1 IS NOT DISTINCT FROM word)::INT + (p2 IS NOT DISTINCT FROM word)::INT) AS a FROM n GROUP BY ALL
), near AS (
  SELECT doc_id, sum(c * (c - 1)) AS s FROM (
    SELECT doc_id, count(*) AS c FROM n WHERE n1 IS NOT NULL GROUP BY doc_id, word, n1 UNION ALL SELECT doc_id, count(*) FROM n WHERE n2 IS NOT NULL GROUP BY doc_id, word, n2
    UNION ALL SELECT doc_id, count(*) FROM n WHERE p1 IS NOT NULL GROUP BY doc_id, word, p1 UNION ALL SELECT doc_id, count(*) FROM n WHERE p2 IS NOT NULL GROUP BY doc_id, word, p2)
  GROUP BY doc_id
)
SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_words, CAST(63 * (sum(a * (c - 1)) + coalesce(any_value(s), 0)) AS BIGINT) AS strength FROM own LEFT JOIN near USING (doc_id) GROUP BY doc_id
""",
)
def dyn1(spark: SparkSession, sf: str) -> DataFrame:
    t = similarity.similarity_totals(load(spark, sf, "documents"))
    return t.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("strength").cast("long").alias("strength"))


@query(
    "dyn2_edit_distance",
    """WITH RECURSIVE r(k, a, b, i, best) AS (
  SELECT p_partkey, p_name, p_type, 0, list_transform(range(0, length(p_type) + 1), lambda x: 0::BIGINT) FROM part
  UNION ALL SELECT k, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda m: greatest(best[m + 1], CASE WHEN m > 0 AND a[i + 1] = b[m] THEN best[m] + 1 ELSE 0 END))))
  FROM r WHERE i < length(a))
SELECT k AS p_partkey, best[-1] AS lcs, length(a) + length(b) - 2 * best[-1] AS distance FROM r WHERE i = length(a)""",
)
def dyn2(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return load(spark, sf, "part").select("p_partkey", strings.common_subsequence(a, b).cast("long").alias("lcs"), strings.edit_distance(a, b).cast("long").alias("distance"))


@query(
    "dyn4_common_subsequence",
    """WITH RECURSIVE c AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part),
s(p_partkey, i, above, line) AS (
  SELECT p_partkey, 1, list_transform(range(0, length(b) + 1), lambda x: ''), [''] FROM c
  UNION ALL SELECT s.p_partkey, CASE WHEN len(line) > length(b) THEN i + 1 ELSE i END, CASE WHEN len(line) > length(b) THEN line ELSE above END,
    CASE WHEN len(line) > length(b) THEN [''] ELSE list_append(line, CASE WHEN a[i] = b[len(line)] THEN above[len(line)] || a[i] WHEN length(above[len(line) + 1]) > length(line[len(line)]) THEN above[len(line) + 1] ELSE line[len(line)] END) END
  FROM s JOIN c USING (p_partkey) WHERE i <= length(a))
SELECT p_partkey, above[length(b) + 1] AS lcs FROM s JOIN c USING (p_partkey) WHERE i = length(a) + 1 AND len(line) = 1""",
)
def dyn4(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", strings.common_subsequence_text(F.col("p_name"), F.col("p_type")).alias("lcs"))


@query(
    "dyn5_subset_counts",
    """WITH RECURSIVE i AS (SELECT DISTINCT l_orderkey AS k, CAST(l_quantity AS INT) AS q FROM lineitem), s(k, top, total) AS (
  SELECT DISTINCT l_orderkey, 0, 0 FROM lineitem UNION ALL SELECT s.k, q, total + q FROM s JOIN i ON s.k = i.k AND q > top WHERE total + q <= 50)
SELECT k AS l_orderkey, any_value(n) AS n_items, count(*) FILTER (total = 50) AS ways FROM s JOIN (SELECT k, count(*) AS n FROM i GROUP BY k) USING (k) GROUP BY k""",
)
def dyn5(spark: SparkSession, sf: str) -> DataFrame:
    sizes = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("int"))).alias("items"))
    return sizes.select("l_orderkey", F.size("items").cast("long").alias("n_items"), numbers.subset_counts(F.col("items"), 50).alias("ways"))


@query("dyn6_fibonacci", "WITH RECURSIVE f(n, fib, nxt) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, nxt, fib + nxt FROM f WHERE n < 60) SELECT p_partkey, fib FROM part JOIN f ON n = p_size")
def dyn6(spark: SparkSession, sf: str) -> DataFrame:
    """The number of each part's size."""
    return load(spark, sf, "part").join(F.broadcast(numbers.fibonacci(spark, 60)), F.col("p_size") == F.col("n")).select("p_partkey", "fib")


@query(
    "dyn1_similar_pairs",
    """
WITH w AS (SELECT turn_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT conv_id * 1000 + turn AS turn_id, regexp_split_to_array(lower(text), '[^a-z'']+') AS ws FROM conversations)),
n AS MATERIALIZED (SELECT turn_id, i, word, lead(word, 1) OVER o AS n1, lead(word, 2) OVER o AS n2, CASE WHEN i > 1 THEN lag(word, 1) OVER o END AS p1, CASE WHEN i > 2 THEN lag(word, 2) OVER o END AS p2 FROM w WINDOW o AS (PARTITION BY turn_id ORDER BY i)),
p AS (SELECT a.turn_id, a.i::INT AS i, b.i::INT AS j, 63 * ((b.n1 IS NOT DISTINCT FROM b.word)::INT + (b.n2 IS NOT DISTINCT FROM b.word)::INT + (b.p1 IS NOT DISTINCT FROM b.word)::INT + (b.p2 IS NOT DISTINCT FROM b.word)::INT
  + coalesce((b.n1 = a.n1)::INT, 0) + coalesce((b.n2 = a.n2)::INT, 0) + coalesce((b.p1 = a.p1)::INT, 0) + coalesce((b.p2 = a.p2)::INT, 0)) AS strength FROM n a JOIN n b ON a.turn_id = b.turn_id AND a.word = b.word AND a.i <> b.i)
SELECT turn_id, i, j, strength::BIGINT AS strength FROM p WHERE strength > 0""",
)
def dyn1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the similarity picture of each turn of a conversation."""
    turns = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return similarity.similar_pairs(turns, "turn_id", "text")


_LINES = """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), '-0000 ', CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'W' ELSE 'I' END, ' ', CASE WHEN event_type = 'view' THEN '-' ELSE upper(event_type) END, ' [conn', user_id, '] event:', event_id, ' k.', get_json_object(props, '$.k'))"""


def mongo_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The events as database server log lines."""
    return load(spark, sf, "events").select("event_id", F.expr(_LINES).alias("value"))


@query(
    "log5_parse",
    """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S:%g') AS clock, '-0000' AS zone, CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' ELSE 'Informational' END AS severity,
       CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE upper(event_type) END AS component, 'conn' || user_id AS context, 'event : ' || event_id || ' k . ' || (props->>'$.k') AS message
FROM events""",
)
def log5(spark: SparkSession, sf: str) -> DataFrame:
    r = logs.parse_mongo(mongo_lines(spark, sf))
    return r.select("event_id", F.array_join("date", "-").alias("day"), F.array_join("time", ":").alias("clock"), F.col("offset").alias("zone"), F.col("severity.name").alias("severity"), "component", "context", "message")


@query(
    "log11_find",
    """
SELECT '{"line_num":' || event_id || ',"severity":"(E, 4, Error)","component":"ERROR","context":"conn' || user_id || '","message":"event : ' || event_id || ' k . ' || (props->>'$.k') || '"}' AS json
FROM events WHERE event_type = 'error' AND strftime(ts, '%Y-%m') = '2024-01' AND hour(ts) = 12""",
)
def log11(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"date": ("2024", "01"), "time": ("12",), "severity": {"name": "Error"}}
    records = logs.search(mongo_lines(spark, sf), wanted).withColumnRenamed("event_id", "line_num")
    return logs.as_json(records, "line_num", "severity", "component", "context", "message")


def written_lines(rows: DataFrame) -> str:
    """The path of text files, with the values of rows, in the shared folder."""
    path = work_path(rows.sparkSession, "lines")
    rows.select("value").write.text(path)
    return path


_FOUND = """SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S:%g') AS clock, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Warning' END AS severity, upper(event_type) AS component, 'conn' || user_id AS context,
       'event : ' || event_id || ' k . ' || (props->>'$.k') AS message FROM events WHERE event_type = {} AND strftime(ts, '%Y-%m') = '2024-01'"""


def _found(records: DataFrame) -> DataFrame:
    return records.select(F.array_join("date", "-").alias("day"), F.array_join("time", ":").alias("clock"), F.col("severity.name").alias("severity"), "component", "context", "message")


@query("log11_find_in_files", _FOUND.format("'error'"))
def log11_files(spark: SparkSession, sf: str) -> DataFrame:
    return _found(logs.find_logs(spark, written_lines(mongo_lines(spark, sf)), {"date": ("2024", "01"), "severity": {"value": 4}}))


@query("log11_pushed_scan", _FOUND.format("'signup'"))
def log11_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _found(logs.scan_logs(spark, written_lines(mongo_lines(spark, sf)), {"date": ("2024", "01"), "severity": {"level": "W"}, "component": "SIGNUP"}))


@query(
    "log1_tokens",
    r"""
WITH l AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '-0000 ' || CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'W' ELSE 'I' END || ' ' || CASE WHEN event_type = 'view' THEN '-' ELSE upper(event_type) END
         || ' [conn' || user_id || '] event:' || event_id || ' k.' || (props->>'$.k') AS v FROM events
), t AS (SELECT unnest(regexp_extract_all(v, '[0-9]+|[A-Za-z]+|[^ \t\n]')) AS x FROM l)
SELECT CASE WHEN x SIMILAR TO '[0-9]+' THEN 'NUMBER' WHEN x SIMILAR TO '[A-Za-z]+' THEN 'WORD' WHEN x = '.' THEN 'DOT' WHEN x = '-' THEN 'HYPHEN' WHEN x = ':' THEN 'COLON' WHEN x IN ('[', ']') THEN 'SBRACKET' ELSE 'MISMATCH' END AS typ, count(*) AS n
FROM t GROUP BY 1""",
)
def log1(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tokens(mongo_lines(spark, sf), "value", "event_id").groupBy("typ").agg(F.count("*").alias("n"))


@query(
    "log7_severity",
    """SELECT CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 ELSE 2 END AS severity, count(*) AS n, count(*) FILTER (event_type = 'signup') AS matched FROM events GROUP BY 1""",
)
def log7(spark: SparkSession, sf: str) -> DataFrame:
    r = logs.parse_mongo(mongo_lines(spark, sf))
    hit = logs.severity_filter(F.col("severity"), {"level": "W", "value": 5})  # the level decides
    return r.groupBy(F.col("severity.value").alias("severity")).agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"))


@query(
    "log12_node_entries",
    """SELECT event_id, strftime(ts, '%H') AS hour, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN '404' ELSE 'UNKOWN' END AS status,
       CASE WHEN event_type = 'error' THEN 'TypeError' END AS error, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS trace_user, CASE WHEN event_type = 'error' AND user_id % 2 = 1 THEN 2 END AS frames FROM events""",
)
def log12(spark: SparkSession, sf: str) -> DataFrame:
    text = """concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), CASE WHEN event_type <> 'error' THEN concat(' info: event ', event_id)
      WHEN user_id % 2 = 0 THEN concat(' error[404] failed\nTrace: {user: ', user_id, ', url: }\nStack: TypeError: no such page\n    at f (/a/b.js:1:2)')
      ELSE ' error: failed\nTypeError [CODE]: x is null\n    at f (/a/b.js:10:2)\n    at g (/a/c.js:3:4)\nTrace: x\nStack: y' END)"""
    r = logs.parse_node(load(spark, sf, "events").select("event_id", F.expr(text).alias("entry")))
    return r.select("event_id", F.element_at("time", 1).alias("hour"), "level", "status", F.col("error.name").alias("error"), F.try_element_at("error.trace", F.lit("user")).alias("trace_user"), F.size("error.frames").alias("frames")).withColumn("frames", F.when(F.col("frames") >= 0, F.col("frames")))


_NODE = r"""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), CASE WHEN event_type <> 'error' THEN concat(' info: event ', event_id)
  WHEN user_id % 4 = 0 THEN concat(' error[404] failed ', event_id, '\nTrace: {user: ', user_id, ', url: }\nStack: TypeError: no such page\n    at f (/a/b.js:1:2)')
  WHEN user_id % 4 = 1 THEN concat(' error: failed ', event_id, '\nTypeError [CODE]: x is null\n    at f (/a/b.js:10:2)\n    at g (/a/c.js:', event_id, ':4)\nTrace: x\nStack: y')
  WHEN user_id % 4 = 2 THEN concat(' error: failed ', event_id, '\n/x/c.js line\nReferenceError: y is gone\n    at h (/x/c.js:7:8)\nTrace: t\nStack: s')
  ELSE concat(' error: failed ', event_id, '\nSyntaxError: unexpected\n  3 | let x\n    at k (/x/d.js:9:8)\nTrace: t\nStack: s') END)"""


def node_files(spark: SparkSession, sf: str) -> str:
    """The events as files of application entries of one to six lines."""
    return written_lines(load(spark, sf, "events").select(F.expr(_NODE).alias("value")))


#: Blocks so small that many entries go on in the next one.
_NODE_BLOCK = 64 << 10


def _of_message() -> Column:
    return F.element_at(F.split("message", " "), -1).cast("long").alias("event_id")


@query(
    "log12_file_entries",
    """SELECT event_id, strftime(ts, '%H') AS hour, CASE WHEN e THEN 'error' ELSE 'info' END AS level, CASE WHEN e AND u = 0 THEN '404' ELSE 'UNKOWN' END AS status, CASE WHEN e THEN ['TypeError', 'TypeError', 'ReferenceError', 'SyntaxError'][u + 1] END AS error,
       CASE WHEN e AND u = 1 THEN 'CODE' END AS code, CASE WHEN e AND u = 2 THEN '/x/c.js line' END AS compile_time, CASE WHEN e AND u = 3 THEN '3 | letx' END AS block, CASE WHEN e THEN [NULL, 2, 1, 1][u + 1] END AS frames
FROM (SELECT *, event_type = 'error' AS e, user_id % 4 AS u FROM events)""",
)
def log12_files(spark: SparkSession, sf: str) -> DataFrame:
    r = logs.find_logs(spark, node_files(spark, sf), parser="node", block_bytes=_NODE_BLOCK)
    frames = F.size("error.frames")
    return r.select(_of_message(), F.element_at("time", 1).alias("hour"), "level", "status", F.col("error.name").alias("error"), "error.code", "error.compile_time", "error.block", F.when(frames >= 0, frames).alias("frames"))


@query(
    "log17_frames",
    """SELECT event_id, unnest(range(len(f))) ::INT AS pos, unnest(f).name AS name, unnest(f).file AS file, unnest(f).line::INT AS line, unnest(f).col::INT AS col
FROM (SELECT event_id, CASE user_id % 4 WHEN 1 THEN [{'name': 'f', 'file': '/a/b.js', 'line': 10, 'col': 2}, {'name': 'g', 'file': '/a/c.js', 'line': event_id, 'col': 4}] WHEN 2 THEN [{'name': 'h', 'file': '/x/c.js', 'line': 7, 'col': 8}] WHEN 3 THEN [{'name': 'k', 'file': '/x/d.js', 'line': 9, 'col': 8}] END AS f
  FROM events WHERE event_type = 'error' AND user_id % 4 > 0)""",
)
def log17(spark: SparkSession, sf: str) -> DataFrame:
    r = logs.find_logs(spark, node_files(spark, sf), {"level": "error", "error": {"is_api_error": False}}, "node", block_bytes=_NODE_BLOCK)
    return r.select(_of_message(), F.posexplode("error.frames").alias("pos", "f")).select("event_id", "pos", "f.name", "f.file", "f.line", "f.col")


@query("log20_search_by_trace", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id::VARCHAR AS trace_user, 'no such page' AS error_message FROM events WHERE event_type = 'error' AND user_id % 4 = 0 AND strftime(ts, '%Y-%m') = '2024-01'")
def log20(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"date": ("2024", "01"), "status": "404", "error": {"name": "TypeError", "is_api_error": True}, "trace": {"url": "null"}}
    r = logs.find_logs(spark, node_files(spark, sf), wanted, "node", block_bytes=_NODE_BLOCK)
    return r.select(_of_message(), F.array_join("date", "-").alias("day"), F.try_element_at("error.trace", F.lit("user")).alias("trace_user"), F.col("error.message").alias("error_message"))


@query("log16_compile_time_errors", "SELECT count(*) FILTER (user_id % 4 = 2) AS compile_time, count(*) FILTER (user_id % 4 = 3) AS syntax, count(*) AS errors FROM events WHERE event_type = 'error'")
def log16(spark: SparkSession, sf: str) -> DataFrame:
    r = logs.find_logs(spark, node_files(spark, sf), {"level": "error"}, "node", block_bytes=_NODE_BLOCK)
    return r.agg(F.count_if(logs.node_filter({"error": {"is_compile_time": True}})).alias("compile_time"), F.count_if(F.col("error.block").isNotNull()).alias("syntax"), F.count("*").alias("errors"))


_EVT = "CASE c_custkey % 3 WHEN 0 THEN 'Reverse' WHEN 1 THEN 'COMPRESS' ELSE 'yell' END"


@query(
    "evt1_progress",
    f"""
WITH c AS (SELECT c_custkey AS id, lower({_EVT}) AS k, c_name AS m FROM customer), s AS (SELECT *, unnest(range(1, length(m) + 1)) AS step FROM c)
SELECT id, 'RUNNING' AS status, CAST(step AS INT) AS step, CASE k WHEN 'yell' THEN upper(m[:step]) WHEN 'compress' THEN regexp_replace(lower(m[:step]), '[^a-z]', '', 'g') ELSE reverse(m[:step]) END AS message,
       CAST(floor(step::DOUBLE / length(m) * 100) AS INT) AS percent, false AS complete FROM s
UNION ALL SELECT id, 'DONE', CAST(length(m) + 1 AS INT), CASE k WHEN 'yell' THEN upper(m) WHEN 'compress' THEN regexp_replace(lower(m), '[^a-z]', '', 'g') ELSE reverse(m) END, NULL, true FROM c""",
)
def evt1(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_EVT).alias("type"), F.col("c_name").alias("message"))
    return events.progress(r).drop("name")


#: ts as an instant, whatever the session's time zone is.
_UTC = "CAST(concat(CAST(ts AS STRING), '+00:00') AS TIMESTAMP)"
#: Seconds that a bus event takes for a character.
_PACE = 3600
_BUS_KIND = "CASE event_type WHEN 'view' THEN 'yell' WHEN 'click' THEN 'compress' ELSE 'reverse' END"


@query(
    "evt7_bus",
    f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT user_id AS id, epoch_us(ts) AS t, event_type = 'error' AS cancel, {_BUS_KIND} AS k, event_type || ' ' || event_id AS m FROM events),
u AS (SELECT max(epoch_ms(ts)) * 1000 AS w FROM events), s AS MATERIALIZED (SELECT id, t, k, m, t + length(m) * {_PACE}000000 AS full_end FROM r WHERE NOT cancel),
e AS MATERIALIZED (SELECT s.*, CASE WHEN c.t < full_end THEN c.t END AS cut FROM s ASOF LEFT JOIN (SELECT id, t FROM r WHERE cancel) c ON s.id = c.id AND s.t < c.t),
n AS MATERIALIZED (SELECT e.*, f.t AS next FROM e ASOF LEFT JOIN (SELECT id, t FROM s) f ON e.id = f.id AND coalesce(e.cut, e.full_end) <= f.t),
a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY t) = 1 UNION ALL SELECT n.* FROM a JOIN n ON n.id = a.id AND n.t = a.next),
d AS (SELECT *, CASE WHEN cut IS NULL THEN length(m) ELSE (cut - t) // {_PACE}000000 END AS reached FROM a),
x AS (
  SELECT id, k, m[:i] AS part, 'RUNNING' AS status, i AS step, CAST(floor(i::DOUBLE / length(m) * 100) AS INT) AS percent, t + i * {_PACE}000000 AS at_us FROM d, LATERAL (SELECT unnest(range(1, reached + 1)) AS i)
  UNION ALL SELECT id, 'cancel', '', 'CANCELED', reached + 1, NULL, cut FROM d WHERE cut IS NOT NULL
  UNION ALL SELECT id, k, m[:reached], 'DONE', CASE WHEN cut IS NULL THEN reached + 1 ELSE reached + 2 END, NULL, coalesce(cut, full_end) FROM d)
SELECT id, status, step::INT AS step, CASE k WHEN 'cancel' THEN 'cancelling' WHEN 'yell' THEN upper(part) WHEN 'compress' THEN regexp_replace(lower(part), '[^a-z]', '', 'g') ELSE reverse(part) END AS message, percent, status = 'DONE' AS complete, at_us FROM x, u WHERE at_us < w""",
)
def evt7(spark: SparkSession, sf: str) -> DataFrame:
    requests = load(spark, sf, "events").select(F.col("user_id").alias("id"), F.expr(_BUS_KIND).alias("type"), F.concat_ws(" ", "event_type", "event_id").alias("message"), (F.col("event_type") == "error").alias("cancel"), F.expr(_UTC).alias("at"))
    path = work_path(spark, "bus")
    requests.write.parquet(f"{path}/requests")  # a stream reads folders
    stream = spark.readStream.schema(requests.schema).parquet(f"{path}/requests")
    return bus.replayed(spark, bus.bus(stream, _PACE), path).drop("name")


@query("evt6_started", "SELECT user_id AS id, min(event_id) AS event_id FROM events GROUP BY user_id")
def evt6(spark: SparkSession, sf: str) -> DataFrame:
    return events.started(load(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id"), "event_id").select("id", "event_id")


@query("dsl5_predicate", "SELECT event_id FROM events WHERE (event_type = 'purchase' AND value > 50) OR NOT (user_id % 2 = 0)")
def dsl5(spark: SparkSession, sf: str) -> DataFrame:
    bind = {"bought": F.col("event_type") == "purchase", "high": F.col("value") > 50, "even": F.col("user_id") % 2 == 0}
    return predicate.where(load(spark, sf, "events"), "run<50, high>: bought && high || !even stop", bind).select("event_id")


@query("str1_caesar", "SELECT c_custkey, translate(lower(c_name), 'abcdefghijklmnopqrstuvwxyz', 'defghijklmnopqrstuvwxyzabc') AS shifted, translate(lower(c_name), 'abcdefghijklmnopqrstuvwxyz', 'juliscaertvwxyzbdfghkmnopq') AS keyed, lower(c_name) AS back FROM customer")
def str1(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    keyed = strings.caesar(name, phrase="Julius Caesar")
    return load(spark, sf, "customer").select("c_custkey", strings.caesar(name).alias("shifted"), keyed.alias("keyed"), strings.caesar(keyed, phrase="Julius Caesar", encrypt=False).alias("back"))


@query(
    "str3_rail_fence",
    r"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g'), '') AS c FROM documents)
SELECT doc_id, md5(array_to_string(c[1:len(c):3], '') || array_to_string(c[2:len(c):3], '') || array_to_string(c[3:len(c):3], '')) AS cipher FROM c""",
)
def str3(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(strings.rail_fence(F.col("text"), 3, 1).cast("binary")).alias("cipher"))


@query(
    "str6_packets",
    """WITH c AS (SELECT conv_id, turn, text, greatest(CAST(ceil(length(text) / 24.0) AS INT), 1) AS n FROM conversations), p AS (SELECT *, unnest(range(0, n)) AS i FROM c)
SELECT conv_id, turn, CAST(i AS INT) AS pos, lpad(CAST(length(substr(text, i * 24 + 1, 24)) AS VARCHAR), 4, '0') || lpad(CAST(n - 1 - i AS VARCHAR), 4, '0') || substr(text, i * 24 + 1, 24) AS packet FROM p""",
)
def str6(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(strings.packets(F.col("text"))).alias("pos", "packet"))


@query("str7_reassemble", "SELECT conv_id || ':' || turn AS message_key, text AS message, replace(text, ' ', '_') AS reply FROM conversations")
def str7(spark: SparkSession, sf: str) -> DataFrame:
    sent = load(spark, sf, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("message_key"), F.explode(strings.packets(F.col("text"))).alias("packet"))
    return strings.reassemble(sent, "message_key", "packet").select("message_key", "message", strings.reply(F.col("message")).alias("reply"))


@query("str9_author_slug", "SELECT s_suppkey, replace(lower(rtrim(s_name)), ' ', '-') AS slug FROM supplier")
def str9(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select("s_suppkey", strings.author_slug(F.col("s_name")).alias("slug"))


@query(
    "bit_functions",
    """SELECT o_orderkey, o_orderkey | 8 AS set3, o_orderkey & ~8::BIGINT AS clear3, xor(o_orderkey, 8::BIGINT) AS toggle3, (o_orderkey & 240) >> 4 AS field, least(o_orderkey, o_custkey) AS low, greatest(o_orderkey, o_custkey) AS high,
       (o_orderkey % 97 + o_custkey % 97) % 97 AS modsum, CAST(pow(2, ceil(log2(o_orderkey))) AS BIGINT) AS power, CAST(ceil(log2(o_orderkey)) AS INT) AS exponent, CAST(bit_count(o_orderkey) AS INT) AS ones FROM orders WHERE o_orderkey > 0""",
)
def bits(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    return load(spark, sf, "orders").where("o_orderkey > 0").select(
        "o_orderkey",
        numbers.kth_bit(n, 3).alias("set3"),
        numbers.kth_bit(n, 3, "clear").alias("clear3"),
        numbers.kth_bit(n, 3, "toggle").alias("toggle3"),
        numbers.bit_field(n, 240, 4).alias("field"),
        F.least("o_orderkey", "o_custkey").alias("low"),
        F.greatest("o_orderkey", "o_custkey").alias("high"),
        numbers.add_modulo(n % 97, F.col("o_custkey") % 97, F.lit(97)).cast("long").alias("modsum"),
        numbers.next_power_of_two(n).alias("power"),
        numbers.log2_of_power(numbers.next_power_of_two(n)).alias("exponent"),
        F.bit_count(n).alias("ones"),
    )


@query(
    "num_functions",
    """SELECT p_partkey, CAST(2 * (p_size - pow(2, floor(log2(p_size)))) + 1 AS INT) AS survivor, CASE WHEN p_size > 1 THEN CAST(p_size * (p_size + 1) / 2 AS BIGINT) END AS total,
       p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 60) r(d) WHERE d < p_size AND p_size % d = 0) AS prime FROM part""",
)
def nums(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return load(spark, sf, "part").select("p_partkey", numbers.survivor(F.sequence(F.lit(1), size)).alias("survivor"), numbers.integer_sum(F.lit(1).cast("long"), size.cast("long")).alias("total"), numbers.is_prime(size.cast("long")).alias("prime"))


@query("num1_magic_triangle", "WITH s AS (SELECT l_orderkey, list_sort(list(CAST(l_quantity AS BIGINT))) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, 60 * 3 - list_sum(a) BETWEEN list_sum(a[1:3]) AND list_sum(a[-3:]) AS possible FROM s WHERE len(a) >= 6")
def num1(spark: SparkSession, sf: str) -> DataFrame:
    lists = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("a")).where(F.size("a") >= 6)
    return lists.select("l_orderkey", numbers.magic_triangle(F.col("a"), F.lit(60)).alias("possible"))


@query(
    "num4_cycles",
    """WITH RECURSIVE c AS (SELECT count(*) AS n, CASE WHEN count(*) % 7 <> 0 THEN 7 ELSE 11 END AS f FROM part), w(node, here, steps) AS (
  SELECT p_partkey, (p_partkey * f + 3) % n, 1::BIGINT FROM part, c UNION ALL SELECT node, (here * f + 3) % n, steps + 1 FROM w, c WHERE here <> node)
SELECT node, min(here) AS cycle, max(steps) AS length FROM w GROUP BY node""",
)
def num4(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part")
    n = parts.count()
    step = 7 if n % 7 else 11  # keys run from 0 to n - 1; a factor without a common divisor permutes them
    return numbers.cycles(parts.select(F.col("p_partkey").alias("node"), F.pmod(F.col("p_partkey") * step + 3, F.lit(n)).alias("next")))


@query("num7_primes", "SELECT o_orderkey FROM orders, (SELECT sqrt(max(o_orderkey))::BIGINT + 1 AS r FROM orders) WHERE o_orderkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 2000) d(d) WHERE d < o_orderkey AND d <= r AND o_orderkey % d = 0)")
def num7(spark: SparkSession, sf: str) -> DataFrame:
    """The orders with prime keys, by a sieve as long as the table."""
    orders = load(spark, sf, "orders")
    most = orders.agg(F.coalesce(F.max("o_orderkey"), F.lit(0))).first()[0]
    return orders.join(numbers.primes(spark, most + 1), F.col("o_orderkey") == F.col("prime"), "left_semi").select("o_orderkey")


@query(
    "num12_pendulum",
    """WITH RECURSIVE s(n, a, v) AS (SELECT 0, 3.141592653589793::DOUBLE / 3, 0.0::DOUBLE UNION ALL SELECT n + 1, a + v * 0.01::DOUBLE, v + (-0.1::DOUBLE * v - 4.9::DOUBLE * sin(a)) * 0.01::DOUBLE FROM s WHERE n < 600)
SELECT p_partkey, round(a, 6) AS angle FROM part JOIN s ON s.n = p_size * 10""",
)
def num12(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "part")
    # one integration per distinct size; the sizes are joined back
    by_size = parts.select("p_size").distinct().select("p_size", F.round(numbers.pendulum(F.col("p_size") / 10.0), 6).alias("angle"))
    return parts.join(by_size, "p_size").select("p_partkey", "angle")


@query("num10_better_guess", "SELECT c_custkey, CAST([4, 4, 1, 1, 6, 6, 3, 3][c_custkey % 8 + 1] AS INT) AS answer FROM customer")
def num10(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", numbers.better_guess(F.col("c_custkey") % 8).alias("answer"))


_E = "embedding"


def _doubles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "label", F.transform(_E, lambda x: x.cast("double")).alias("e"))


@query(
    "vec_functions",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: e[i] * e[i + 32])), 6) AS dot, round(list_sum(list_transform(range(1, 33), lambda i: 2 * e[i] - 3 * e[i + 32])), 6) AS combined FROM e""",
)
def vec(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.slice("e", 1, 32), F.slice("e", 33, 32)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return _doubles(spark, sf).select("vec_id", F.round(arrays.dot(a, b), 6).alias("dot"), F.round(add(arrays.linear_combination([2.0, -3.0], [a, b])), 6).alias("combined"))


@query("vec2_span", "SELECT DISTINCT n_nationkey, i * n_nationkey + j AS x, i * n_regionkey + j * 2 AS y FROM nation, range(-5, 5) a(i), range(-5, 5) b(j)")
def vec2(spark: SparkSession, sf: str) -> DataFrame:
    """The span of two vectors of each nation."""
    v, w = F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    each = load(spark, sf, "nation").select("n_nationkey", F.explode(arrays.vector_span(v, w)).alias("v"))
    return each.select("n_nationkey", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"))


def _rows(n: int, size: int = 8):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("e", i * size + 1, n))


@query(
    "vec3_matrix_times_vector",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), y AS (SELECT vec_id, e, unnest(range(0, 8)) AS i FROM e)
SELECT vec_id, CAST(i AS INT) AS i, round(list_sum(list_transform(range(0, 8), lambda j: e[j * 8 + i + 1] * e[j + 1])), 6) AS y FROM y""",
)
def vec3(spark: SparkSession, sf: str) -> DataFrame:
    y = arrays.matrix_times_vector(_rows(8), F.slice("e", 1, 8))
    return _doubles(spark, sf).select("vec_id", F.posexplode(y).alias("i", "y")).withColumn("y", F.round("y", 6))


@query(
    "mat2_multiply",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), ij AS (SELECT vec_id, e, i, j FROM e, range(0, 8) a(i), range(0, 8) b(j))
SELECT vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(list_sum(list_transform(range(0, 8), lambda k: e[i * 8 + k + 1] * e[j * 8 + k + 1])), 6) AS v FROM ij""",
)
def mat2(spark: SparkSession, sf: str) -> DataFrame:
    m = _doubles(spark, sf).select("vec_id", _rows(8).alias("m"))
    t = m.select("vec_id", arrays.transpose(F.col("m")).alias("m"))
    return arrays.multiply(arrays.entries(m, "vec_id", "m"), arrays.entries(t, "vec_id", "m"), "vec_id").withColumn("v", F.round("v", 6))


@query(
    "mat3_determinant",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(e[1] * e[10] - e[2] * e[9], 6) AS det2, round(e[1] * (e[10] * e[19] - e[11] * e[18]) - e[2] * (e[9] * e[19] - e[11] * e[17]) + e[3] * (e[9] * e[18] - e[10] * e[17]), 6) AS det3, false AS is_identity FROM e""",
)
def mat3(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(spark, sf).select("vec_id", F.round(arrays.determinant(_rows(2), 2), 6).alias("det2"), F.round(arrays.determinant(_rows(3), 3), 6).alias("det3"), arrays.is_identity(_rows(3)).alias("is_identity"))


#: Determinants of 8 x 8 by sums over sets of columns, one row of the matrix a level.
_DET8 = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d(vec_id, i, cols, v) AS (
  SELECT vec_id, 0, 0, 1.0::DOUBLE FROM e
  UNION ALL SELECT d.vec_id, any_value(d.i) + 1, d.cols | (1 << j)::INT, sum(CASE WHEN bit_count(d.cols >> j) % 2 = 0 THEN 1 ELSE -1 END * e[d.i * 8 + j + 1] * d.v)
  FROM d JOIN e USING (vec_id), range(0, 8) r(j) WHERE d.i < 8 AND (d.cols >> j) & 1 = 0 GROUP BY d.vec_id, d.cols | (1 << j)::INT
)"""


@query("mat3_determinant_8", f"{_DET8} SELECT vec_id, round(v * 1e6, 3) + 0.0 AS det_millionths FROM d WHERE i = 8")
def mat3_8(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(spark, sf).select("vec_id", (F.round(arrays.determinant_any(_rows(8)) * 1e6, 3) + 0.0).alias("det_millionths"))


@query("mat5_inverse", "SELECT vec_id, i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS product FROM embeddings, range(0, 8) a(i), range(0, 8) b(j)")
def mat5(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a matrix of 8 x 8 times its inverse."""
    m = _doubles(spark, sf).select("vec_id", _rows(8).alias("m"))
    inverses = m.select("vec_id", arrays.inverse(F.col("m"))["inverse"].alias("m"))
    product = arrays.multiply(arrays.entries(m, "vec_id", "m"), arrays.entries(inverses, "vec_id", "m"), "vec_id")
    return product.select("vec_id", "i", "j", (F.round("v", 4) + 0.0).alias("product"))


_SPECTRUM = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), k AS (SELECT vec_id, e, unnest(range(0, len(e))) AS k FROM e),
s AS (SELECT vec_id, k, list_sum(list_transform(range(0, len(e)), lambda n: e[n + 1] * cos(k * n * 2 * pi() / len(e)))) AS re, list_sum(list_transform(range(0, len(e)), lambda n: e[n + 1] * sin(k * n * 2 * pi() / len(e)))) AS im FROM k)
SELECT vec_id, CAST(k AS INT) AS k, round(sqrt(re * re + im * im), 3) AS magnitude FROM s"""


@query("sig1_spectrum", _SPECTRUM)
def sig1(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.spectrum(_doubles(spark, sf), "vec_id", "e").select("vec_id", "k", arrays.magnitude(F.col("re"), F.col("im")).alias("magnitude"))


@query("sig2_fast_spectrum", _SPECTRUM)  # 64 numbers, a power of two: both transforms agree
def sig2(spark: SparkSession, sf: str) -> DataFrame:
    r = _doubles(spark, sf).select("vec_id", F.posexplode(arrays.fast_spectrum(F.col("e"))).alias("k", "z"))
    return r.select("vec_id", "k", arrays.magnitude(F.col("z.re"), F.col("z.im")).alias("magnitude"))


@query(
    "sig3_long_spectrum",
    """WITH o AS (SELECT o_orderkey AS i, o_totalprice / 1e6 AS v FROM orders), n AS (SELECT pow(2, floor(log2(count(*))))::BIGINT AS n FROM o), c AS (SELECT list(v ORDER BY i) AS x, n FROM o, n WHERE i < n GROUP BY n)
SELECT k, round(sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * ((k * (i - 1)) % n) / n))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * ((k * (i - 1)) % n) / n))), 2)), 3) AS magnitude FROM c, range(0, n) r(k)""",
)
def sig3(spark: SparkSession, sf: str) -> DataFrame:
    """The prices of all orders as one signal."""
    samples = load(spark, sf, "orders").select(F.lit(0).alias("signal"), "o_orderkey", (F.col("o_totalprice") / 1e6).alias("v"))
    return arrays.long_spectrum(samples, "signal", "o_orderkey", "v").select("k", arrays.magnitude(F.col("re"), F.col("im")).alias("magnitude"))


_CLASS = "CASE WHEN vec_id % 3 = 0 THEN 1 ELSE -1 END"


@query("ml1_perceptron", f"SELECT vec_id, {_CLASS} AS predicted, 0::BIGINT AS wrong FROM embeddings")
def ml1(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors moved apart by their class, so that a plane separates them: the trained one puts all on their side."""
    points = _doubles(spark, sf).withColumn("y", F.expr(_CLASS)).select("vec_id", "y", F.transform("e", lambda v: v + F.col("y") * 0.1).alias("x"))
    model = learning.train_perceptron(points)
    return points.select("vec_id", model.predicted("x").alias("predicted"), F.lit(model.wrong).cast("long").alias("wrong"))


@query("ml1_end_without_plane", "SELECT 5 AS rounds, count(*) AS points, true AS some_wrong FROM embeddings")
def ml1_end(spark: SparkSession, sf: str) -> DataFrame:
    """No plane separates a vector from itself, so the training ends after the stated rounds."""
    points = _doubles(spark, sf).select(F.col("e").alias("x"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("y"))
    model = learning.train_perceptron(points, most_rounds=5)
    return _doubles(spark, sf).agg(F.lit(model.rounds).alias("rounds"), F.count("*").alias("points"), F.lit(model.wrong > 0).alias("some_wrong"))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    return images.pixels(_doubles(spark, sf), "vec_id", "e")


_PX = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), r AS (SELECT vec_id, list_min(e) AS lo, list_max(e) AS hi, unnest(e) AS raw, unnest(range(0, len(e))) AS p FROM e),
px AS (SELECT vec_id, p % 8 AS x, p // 8 AS y, CASE WHEN hi > lo THEN CAST(floor((raw - lo) / (hi - lo) * 255) AS INT) ELSE 0 END AS v FROM r)"""


@query("img4_histogram", f"{_PX} SELECT CAST(b AS INT) AS bin, count(v) AS n FROM range(0, 256) r(b) LEFT JOIN px ON px.v = b GROUP BY b")
def img4(spark: SparkSession, sf: str) -> DataFrame:
    return images.histogram(_pixels(spark, sf))


@query("img5_threshold", f"{_PX} SELECT vec_id, CAST(sum(CASE WHEN v > 127 THEN 255 ELSE 0 END) AS BIGINT) AS bin, CAST(sum(CASE WHEN v > 127 THEN 127 ELSE v END) AS BIGINT) AS trunc, CAST(sum(CASE WHEN v > 127 THEN v ELSE 0 END) AS BIGINT) AS tozero, CAST(sum(255 - v) AS BIGINT) AS inverted FROM px GROUP BY vec_id")
def img5(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return _pixels(spark, sf).groupBy("vec_id").agg(*[F.sum(images.threshold(v, k)).alias(a) for k, a in (("binary", "bin"), ("trunc", "trunc"), ("tozero", "tozero"))], F.sum(images.bitwise("not", v)).alias("inverted"))


@query(
    "img6_otsu",
    f"""{_PX}, h AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT vec_id, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER w AS n, sum(n * v) OVER w AS s FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY v), w AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, v, CASE WHEN n > n0 THEN pow((s0 * (n - n0) - (s - s0) * n0)::DOUBLE, 2) / (n0 * (n - n0)) ELSE 0 END AS b FROM c)
SELECT vec_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, v) = 1""",
)
def img6(spark: SparkSession, sf: str) -> DataFrame:
    return images.otsu(_pixels(spark, sf), "vec_id")


_NEAR = f"{_PX}, nb AS (SELECT a.vec_id, a.x, a.y, a.v AS own, b.v FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"


@query("img8_average_blur", f"{_NEAR} SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(floor(sum(v) / count(*)) AS INT) AS v FROM nb GROUP BY vec_id, x, y")
def img8(spark: SparkSession, sf: str) -> DataFrame:
    return images.average_blur(_pixels(spark, sf), "vec_id", 3)


@query("img9_gradient", f"{_NEAR} SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, max(v) - min(v) AS v FROM nb GROUP BY vec_id, x, y")
def img9(spark: SparkSession, sf: str) -> DataFrame:
    return images.morph(_pixels(spark, sf), "vec_id", "gradient", 3)


@query("img2_pipeline", f"{_PX} SELECT vec_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND 255 - v > 100 THEN 255 ELSE 0 END AS v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
def img2(spark: SparkSession, sf: str) -> DataFrame:
    return image_pipeline.run(_pixels(spark, sf), "vec_id", ["bitwise(op=not)", "mask(x=2, y=2, w=4, h=4)", "decimate()", "threshold(kind=binary, at=100)"]).select("vec_id", "x", "y", "v")


@query(
    "img15_contours",
    f"""WITH RECURSIVE base AS ({_PX} SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM px WHERE v > 127), r(vec_id, x, y, p) AS (
  SELECT vec_id, x, y, y * 8 + x FROM base
  UNION SELECT b.vec_id, b.x, b.y, r.p FROM r JOIN base b ON b.vec_id = r.vec_id AND abs(b.x - r.x) + abs(b.y - r.y) = 1
), a AS (SELECT vec_id, x, y, min(p) AS area FROM r GROUP BY ALL), boxes AS (SELECT vec_id, area, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM a GROUP BY ALL)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, x0, y0, x1, y1) - 1 AS INT) AS label, n, x0, y0, x1, y1 FROM boxes""",
)
def img15(spark: SparkSession, sf: str) -> DataFrame:
    return images.contours(_pixels(spark, sf).withColumn("v", images.threshold(F.col("v"))), "vec_id")


@query("img15_canny", f"""
WITH RECURSIVE px AS MATERIALIZED ({_PX} SELECT vec_id, x::INT AS x, y::INT AS y, v FROM px),
w(i, j, a, b) AS (VALUES (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
g AS MATERIALIZED (SELECT p.vec_id, p.x, p.y, coalesce(sum(a * (q.v - p.v)), 0)::DOUBLE AS gx, coalesce(sum(b * (q.v - p.v)), 0)::DOUBLE AS gy FROM px p, w LEFT JOIN px q ON q.vec_id = p.vec_id AND q.x = p.x + i AND q.y = p.y + j GROUP BY ALL),
m AS MATERIALIZED (SELECT vec_id, x, y, sqrt(gx * gx + gy * gy) AS m, CASE WHEN abs(gy) <= abs(gx) * 0.41421356 THEN 'h' WHEN abs(gy) >= abs(gx) * 2.41421356 THEN 'v' WHEN gx * gy > 0 THEN 'd' ELSE 'u' END AS way FROM g),
n AS (SELECT m.*, CASE way WHEN 'v' THEN 0 ELSE 1 END AS dx, CASE way WHEN 'h' THEN 0 WHEN 'u' THEN -1 ELSE 1 END AS dy FROM m),
c AS MATERIALIZED (SELECT n.vec_id, n.x, n.y, n.m > 300 AS strong FROM n LEFT JOIN m f ON f.vec_id = n.vec_id AND f.x = n.x - dx AND f.y = n.y - dy LEFT JOIN m t ON t.vec_id = n.vec_id AND t.x = n.x + dx AND t.y = n.y + dy
  WHERE n.m > 120 AND n.m >= coalesce(f.m, 0) AND n.m > coalesce(t.m, 0)),
e AS (SELECT vec_id, x, y FROM c WHERE strong UNION SELECT c.vec_id, c.x, c.y FROM e JOIN c ON c.vec_id = e.vec_id AND abs(c.x - e.x) <= 1 AND abs(c.y - e.y) <= 1)
SELECT px.vec_id, px.x, px.y, CASE WHEN e.x IS NULL THEN 0 ELSE 255 END AS v FROM px LEFT JOIN e ON e.vec_id = px.vec_id AND e.x = px.x AND e.y = px.y""")
def img15_canny(spark: SparkSession, sf: str) -> DataFrame:
    return images.canny(_pixels(spark, sf), "vec_id", 120, 300)


@query("img17_clahe", f"""
{_PX}, b AS (SELECT vec_id, x, y, v, (x // 4)::INT AS tx, (y // 4)::INT AS ty FROM px), h AS (SELECT vec_id, tx, ty, v, count(*) AS c FROM b GROUP BY ALL),
t AS MATERIALIZED (SELECT vec_id, tx, ty, sum(c) AS area, sum(least(c, 1)) AS kept FROM h GROUP BY ALL),
o AS MATERIALIZED (SELECT *, (area - kept) // 256 AS each, (area - kept) % 256 AS rest, greatest(256 // greatest((area - kept) % 256, 1), 1) AS step FROM t),
l AS MATERIALIZED (SELECT o.vec_id, o.tx, o.ty, u, round((coalesce(sum(least(h.c, 1)) FILTER (h.v <= u), 0) + any_value(each) * (u + 1) + least(any_value(rest), u // any_value(step) + 1)) * 255 / any_value(area)) AS new FROM o JOIN h ON h.vec_id = o.vec_id AND h.tx = o.tx AND h.ty = o.ty, range(256) r(u) GROUP BY o.vec_id, o.tx, o.ty, u),
f AS (SELECT vec_id, x, y, v, x / 4.0::DOUBLE - 0.5 AS fx, y / 4.0::DOUBLE - 0.5 AS fy FROM b),
q AS (SELECT vec_id, x, y, v, least(greatest(floor(fx) + i, 0), 1)::INT AS tx, least(greatest(floor(fy) + j, 0), 1)::INT AS ty, (CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS weight FROM f, range(2) a(i), range(2) c(j))
SELECT vec_id, x::INT AS x, y::INT AS y, round(sum(weight * new))::INT AS v FROM q JOIN l ON l.vec_id = q.vec_id AND l.tx = q.tx AND l.ty = q.ty AND l.u = q.v GROUP BY q.vec_id, x, y""".replace("SELECT vec_id, x::INT", "SELECT q.vec_id, x::INT"))
def img17_clahe(spark: SparkSession, sf: str) -> DataFrame:
    return images.clahe(_pixels(spark, sf), "vec_id", 4.0, 2)


@query("img7_adaptive_threshold", f"{_PX}, nb AS (SELECT a.vec_id, a.x, a.y, a.v AS own, b.v FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) SELECT vec_id, x::INT AS x, y::INT AS y, CASE WHEN own > sum(v) / count(*) - 2 THEN 255 ELSE 0 END AS v FROM nb GROUP BY vec_id, x, y, own")
def img7(spark: SparkSession, sf: str) -> DataFrame:
    return images.adaptive_threshold(_pixels(spark, sf), "vec_id", 7)


@query(
    "img8_gaussian_blur",
    f"""{_PX}, nb AS (SELECT a.vec_id, a.x, a.y, b.v, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * 1.1 * 1.1)) AS w FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2)
SELECT vec_id, x::INT AS x, y::INT AS y, round(sum(v * w) / sum(w))::INT AS v FROM nb GROUP BY vec_id, x, y""",
)
def img8_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return images.gaussian_blur(_pixels(spark, sf), "vec_id", 5)


@query("img17_unsharp", f"{_NEAR} SELECT vec_id, x::INT AS x, y::INT AS y, greatest(0, least(255, round(2.0 * own + 0.5 * floor(sum(v) / count(*)))))::INT AS v FROM nb GROUP BY vec_id, x, y, own")
def img17_unsharp(spark: SparkSession, sf: str) -> DataFrame:
    return images.unsharp(_pixels(spark, sf), "vec_id")


def _config(spark: SparkSession, sf: str, half: int) -> DataFrame:
    e = load(spark, sf, "events").where(F.col("event_id") % 2 == half)
    return e.groupBy(F.col("event_type").alias("section"), F.concat(F.lit("U"), "user_id").alias("entry")).agg(F.max_by("event_id", "event_id").cast("string").alias("value"))


_HALF = "SELECT upper(event_type) AS section, 'u' || user_id AS entry, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE event_id % 2 = {} GROUP BY 1, 2"


@query("cfg6_merge", f"WITH t AS ({_HALF.format(0)}), c AS ({_HALF.format(1)}) SELECT *, 'merged' AS part FROM t UNION ALL SELECT *, 'merged' FROM c ANTI JOIN t USING (section, entry) UNION ALL SELECT *, 'skipped' FROM c SEMI JOIN t USING (section, entry)")
def cfg6(spark: SparkSession, sf: str) -> DataFrame:
    merged, skipped = stores.merge(_config(spark, sf, 1), _config(spark, sf, 0))
    return merged.withColumn("part", F.lit("merged")).unionByName(skipped.withColumn("part", F.lit("skipped")))


@query("cfg7_merge_files", f"WITH t AS ({_HALF.format(0)}), c AS ({_HALF.format(1)}) SELECT *, 'merged' AS part FROM t UNION ALL SELECT *, 'merged' FROM c ANTI JOIN t USING (section, entry) UNION ALL SELECT *, 'skipped' FROM c SEMI JOIN t USING (section, entry)")
def cfg7(spark: SparkSession, sf: str) -> DataFrame:
    """Two configurations written as files, merged into a third, which is read back."""
    path = work_path(spark, "config")
    for half in (0, 1):
        stores.write_ini(_config(spark, sf, half), f"{path}/{half}")
    skipped = stores.merge_files(spark, f"{path}/1", f"{path}/0", f"{path}/merged")
    return stores.read_ini(spark, f"{path}/merged").withColumn("part", F.lit("merged")).unionByName(skipped.withColumn("part", F.lit("skipped")))


@query("cfg2_upsert", f"WITH t AS ({_HALF.format(0)}), c AS ({_HALF.format(1)}) SELECT section, entry, coalesce(c.value, t.value) AS value FROM t FULL JOIN c USING (section, entry) WHERE NOT (section = 'ERROR')")
def cfg2(spark: SparkSession, sf: str) -> DataFrame:
    return stores.delete(stores.upsert(_config(spark, sf, 0), _config(spark, sf, 1), overwrite=True), "error")


@query("cfg9_json", "SELECT upper(event_type) AS section, 'k' AS entry, (props->>'$.k') AS value, count(*) AS n FROM events GROUP BY ALL")
def cfg9(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.concat(F.lit('{"'), "event_type", F.lit('":'), "props", F.lit("}")).alias("json"))
    return stores.from_json(rows, "json").groupBy("section", "entry", "value").agg(F.count("*").alias("n"))


@query("tree1_insert", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def tree1(spark: SparkSession, sf: str) -> DataFrame:
    return stores.tree_insert(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


#: Keys of orders in an order of insertion that looks like chance: a multiplication modulo a prime.
_INSERTED = "o_orderkey * 48271 % 2147483647"
#: Parents by comparing all nodes, then paths of L and R from the root, whose orders are the traversals.
_TREE = f"""n AS MATERIALIZED (SELECT o_orderkey AS k, {_INSERTED} AS p FROM orders),
l AS MATERIALIZED (SELECT v.k, max(u.k) AS l FROM n v JOIN n u ON u.k < v.k AND u.p < v.p GROUP BY 1), r AS MATERIALIZED (SELECT v.k, min(u.k) AS r FROM n v JOIN n u ON u.k > v.k AND u.p < v.p GROUP BY 1),
e AS MATERIALIZED (SELECT n.k, CASE WHEN r.r IS NULL OR a.p > b.p THEN l.l ELSE r.r END AS up FROM n LEFT JOIN l USING (k) LEFT JOIN r USING (k) LEFT JOIN n a ON a.k = l.l LEFT JOIN n b ON b.k = r.r),
t AS (SELECT k, up, '' AS path FROM e WHERE up IS NULL UNION ALL SELECT e.k, e.up, path || CASE WHEN e.k < e.up THEN 'a' ELSE 'c' END FROM t JOIN e ON e.up = t.k)"""


def _order_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", F.expr(_INSERTED).alias("p"))
    return trees.tree_nodes(rows, "o_orderkey", "p")


@query(
    "tree3_traversals",
    f"""WITH RECURSIVE {_TREE}
SELECT k AS o_orderkey, up AS parent, length(path) AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY path || 'b') - 1 AS in_order, row_number() OVER (ORDER BY path || 'd') - 1 AS post FROM t""",
)
def tree3_traversals(spark: SparkSession, sf: str) -> DataFrame:
    return _order_tree(spark, sf).select(F.col("key").alias("o_orderkey"), "parent", "depth", "pre", "in_order", "post")


@query("tree4_metrics", f"WITH RECURSIVE {_TREE} SELECT max(length(path)) AS height, count(*) AS nodes, count(*) - 1 AS edges, max(k) FILTER (path = '') AS root FROM t")
def tree4_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_metrics(_order_tree(spark, sf)).drop("group")


@query(
    "tree3_shape",
    """WITH RECURSIVE n AS MATERIALIZED (SELECT o_orderpriority AS g, o_custkey AS k, min(o_orderkey) AS p FROM orders GROUP BY ALL),
l AS MATERIALIZED (SELECT v.g, v.k, max(u.k) AS l FROM n v JOIN n u ON u.g = v.g AND u.k < v.k AND u.p < v.p GROUP BY ALL), r AS MATERIALIZED (SELECT v.g, v.k, min(u.k) AS r FROM n v JOIN n u ON u.g = v.g AND u.k > v.k AND u.p < v.p GROUP BY ALL),
e AS MATERIALIZED (SELECT n.g, n.k, CASE WHEN r.r IS NULL OR a.p > b.p THEN l.l ELSE r.r END AS up FROM n LEFT JOIN l USING (g, k) LEFT JOIN r USING (g, k) LEFT JOIN n a ON a.g = n.g AND a.k = l.l LEFT JOIN n b ON b.g = n.g AND b.k = r.r),
t AS (SELECT g, k, 0 AS d FROM e WHERE up IS NULL UNION ALL SELECT e.g, e.k, d + 1 FROM t JOIN e ON e.g = t.g AND e.up = t.k)
SELECT g AS o_orderpriority, max(d)::BIGINT AS height, count(*) AS nodes, count(*) - 1 AS edges, max(k) FILTER (d = 0) AS root FROM t GROUP BY g""",
)
def tree3(spark: SparkSession, sf: str) -> DataFrame:
    nodes = trees.tree_nodes(load(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")
    return trees.tree_metrics(nodes).withColumnRenamed("group", "o_orderpriority")


@query(
    "web2_anchors",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a FROM pages), h AS (SELECT page_id, regexp_extract(a, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM a)
SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://example.com' || href END AS link, count(*) AS n FROM h GROUP BY ALL""",
)
def web2(spark: SparkSession, sf: str) -> DataFrame:
    links = web.anchors(load(spark, sf, "pages"), "html", "page_id")
    return links.select("page_id", web.absolute(F.col("href"), "https://example.com").alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


_BLOCKS = "|".join(html.BLOCKS)
#: Paragraphs by cutting texts: from a start tag to the next tag that ends it.
_PARAGRAPHS = rf"""c AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'g') AS h FROM pages),
p AS (SELECT page_id, unnest(ps[2:]) AS x, unnest(range(1, len(ps)))::INT AS n FROM (SELECT page_id, string_split_regex(h, '(?i)<p(?:\s[^>]*)?>') AS ps FROM c)),
k AS (SELECT page_id, n, regexp_replace(x, '(?is)</?(?:p|{_BLOCKS})\b[^>]*>.*$', '') AS x FROM p)"""


def _plain_sql(x: str) -> str:
    """SQL for the text of a piece of HTML."""
    out = rf"regexp_replace({x}, '</?[A-Za-z][^>]*>', '', 'g')"
    for name, character in html.CHARACTERS.items():
        out = "replace({}, '{}', '{}')".format(out, name, character.replace("'", "''"))
    return f"trim({out})"


@query("web4_paragraphs", rf"""WITH {_PARAGRAPHS} SELECT page_id, n, {_plain_sql("x")} AS text, len(regexp_extract_all(x, '(?i)<a\s[^>]*href')) ::INT AS links FROM k""")
def web4_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return web.paragraphs(load(spark, sf, "pages"), "html", "page_id").select("page_id", "n", "text", F.size("links").alias("links"))


@query(
    "web4_feature",
    rf"""WITH {_PARAGRAPHS}, t AS (SELECT page_id, {_plain_sql("regexp_extract(h, '(?is)<h1[^>]*>(.*?)(?:</h1>|$)', 1)")} AS title FROM c)
SELECT page_id, title, count(n)::INT AS paragraphs, coalesce(sum(len(regexp_extract_all(x, '(?i)<a\s[^>]*href'))), 0)::INT AS links FROM t LEFT JOIN k USING (page_id) GROUP BY ALL""",
)
def web4(spark: SparkSession, sf: str) -> DataFrame:
    f = web.features(load(spark, sf, "pages"), "html", "page_id")
    number = F.aggregate(F.transform("body", lambda b: F.size(b["links"])), F.lit(0), lambda a, x: a + x)
    return f.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.size("body"), F.lit(0)).alias("paragraphs"), F.coalesce(number, F.lit(0)).alias("links"))


@query(
    "web2_articles",
    rf"""WITH {_PARAGRAPHS}, a AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)', 1)) AS x FROM c)
SELECT page_id, {_plain_sql("regexp_extract(x, '(?is)<h1[^>]*>(.*?)(?:</h1>|$)', 1)")} AS heading, len(regexp_extract_all(x, '(?i)<p[\s>]')) AS paragraphs, {_plain_sql("x")} AS text FROM a""",
)
def web2_articles(spark: SparkSession, sf: str) -> DataFrame:
    return web.articles(load(spark, sf, "pages"), "html", "page_id").select("page_id", "heading", "paragraphs", "text")


@query(
    "web2_events",
    """SELECT c_custkey, n, CASE n WHEN 1 THEN c_name || ' of note' ELSE 'inner' END AS title, CASE n WHEN 1 THEN '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') ELSE '' END AS year, CASE n WHEN 1 THEN c_mktsegment ELSE '' END AS topic, CASE n WHEN 1 THEN '/c/' || c_custkey ELSE '/inner' END AS link
FROM customer, (VALUES (1), (2)) v(n)""",
)
def web2_events(spark: SparkSession, sf: str) -> DataFrame:
    page = """concat('<div class="grid"><article><span class="p__year">19', lpad(c_custkey % 100, 2, '0'), '</span> <article><p>x<a href="/inner">inner</a></article><a class="p__link" href="/c/', c_custkey, '">', c_name, ' <b>of</b> note</a>, <a class="p__topic" href="/t">', c_mktsegment, '</a></article></div>')"""
    pages = load(spark, sf, "customer").select("c_custkey", F.expr(page).alias("html"))
    return web.articles(pages, "html", "c_custkey").select("c_custkey", "n", "title", "year", "topic", "link")


@query("web4_definitions", "SELECT s_suppkey, 1 AS n, 'Name' AS term, s_name AS text, NULL AS link FROM supplier UNION ALL SELECT s_suppkey, 2, 'Nation', 'nation ' || s_nationkey, '/n/' || s_nationkey FROM supplier")
def web4_definitions(spark: SparkSession, sf: str) -> DataFrame:
    page = """concat('<aside><dl><dt>Name<dd>', s_name, '<dt>Nation</dt><dd><a href="/n/', s_nationkey, '">nation</a> ', s_nationkey, '</dl>after</aside>')"""
    return web.definitions(load(spark, sf, "supplier").select("s_suppkey", F.expr(page).alias("html")), "html", "s_suppkey")


@query("web5_followed_links", "SELECT '/c/' || c_custkey AS url, '/n/' || c_nationkey AS link, n_name AS title, 'Region' AS term, r_name AS region, 2 AS paragraphs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def web5(spark: SparkSession, sf: str) -> DataFrame:
    nations = load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    linked = nations.select(F.concat(F.lit("/n/"), "n_nationkey").alias("url"), F.expr("concat('<h1>', n_name, '</h1><p>one<p>two<dl><dt>Region<dd>', r_name, '</dl>')").alias("html"))
    linking = load(spark, sf, "customer").select(F.concat(F.lit("/c/"), "c_custkey").alias("url"), F.expr("""concat('<article><h2>', c_name, '</h2><a href="n/', c_nationkey, '">nation</a></article>')""").alias("html"))
    found = web.features_of_first_articles(linking.unionByName(linked), base="/")
    return found.select("url", "link", "title", F.explode("citation").alias("term", "v"), F.size("body").alias("paragraphs")).select("url", "link", "title", "term", F.col("v.text").alias("region"), "paragraphs")


@query("web8_quotes_by_author", "SELECT s_nationkey, 'Author ' || (s_suppkey % 3) AS author, max_by(s_name, s_suppkey) AS quote FROM supplier GROUP BY 1, 2")
def web8(spark: SparkSession, sf: str) -> DataFrame:
    one = """concat('<a class="b-qt qt_', s_suppkey, ' oncl_q" href="#">', s_name, '</a> <a class="bq-aut qa_', s_suppkey, ' oncl_a" href="#">Author ', s_suppkey % 3, '</a>')"""
    each = F.struct("s_suppkey", F.expr(one).alias("a"))
    pages = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["a"]), "\n").alias("html"))
    return web.quotes_by_author(web.anchors(pages, "html", "s_nationkey"), "s_nationkey")


@query("web7_author", "SELECT c_custkey, c_mktsegment AS quote, c_name AS author FROM customer")
def web7(spark: SparkSession, sf: str) -> DataFrame:
    quote, author = web.split_author(F.concat("c_mktsegment", F.lit(" - "), "c_name"))
    return load(spark, sf, "customer").select("c_custkey", quote.alias("quote"), author.alias("author"))


@query("web11_insert_if_absent", "SELECT source AS author, md5(text) AS quote FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT source, md5(text) FROM documents WHERE doc_id % 2 = 0")
def web11(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", F.col("source").alias("author"), F.md5(F.col("text").cast("binary")).alias("quote"))
    return stores.insert_if_absent(d.where("doc_id % 2 = 1").drop("doc_id"), d.where("doc_id % 2 = 0"), "author", "quote")


@query("pdf4_address_table", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS start, lead(CAST(o_custkey AS BIGINT), 1, 1000000) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS stop FROM orders")
def pdf4(spark: SparkSession, sf: str) -> DataFrame:
    from tessella.sources.pdf import address_table

    rows = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("doc"), F.col("o_orderkey").alias("obj"), F.col("o_custkey").alias("start"))
    return address_table(rows, F.lit(1_000_000)).select(F.col("obj").alias("o_orderkey"), "start", "stop")
