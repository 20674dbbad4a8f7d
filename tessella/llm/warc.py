"""WARC archives with revisit resolution.

Only headers (digest, id, length) are shuffled by payload digest; payloads move once, to meet their record type, in parts
of about `archive_bytes`, each an archive file. Archives are written by Spark's own text writer, whose line separator is
the two line ends that close a WARC record, so the commit protocol, retries and any file system that Spark knows come for
free. Reading back parses archive files by Content-Length, so payloads may hold anything.

A record is named by page_id and payload digest: pages that repeat a page_id with other payloads stay apart, also where
revisits are resolved.

Defined cases: null html is an empty payload; null url gets the URI `urn:page:<id>`; rows without page_id are always
responses and are read back with a null page_id; rows that repeat the smallest page_id of a payload with that payload are
all responses; a revisit whose response is missing resolves to null; an empty table gives an empty archive; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, default_parallelism, work_path

CRLF = "\r\n"
RECORDS = "page_id long, target_uri string, record_id string, record_type string, refers_to long, declared_digest string, declared_bytes long, payload binary"


def payload_of(html: str = "html") -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def headers(pages: DataFrame) -> DataFrame:
    """One small row per page: page_id, url, payload_bytes, payload_digest."""
    return pages.select("page_id", "url", F.octet_length(payload_of()).cast("long").alias("payload_bytes"), F.sha2(payload_of(), 256).alias("payload_digest"))


def resolve_revisits(heads: DataFrame, least_bytes: int = 100) -> DataFrame:
    """The revisits among the pages, a row per page_id and payload: page_id, payload_digest, refers_to, refers_uri.

    Digests are counted with map-side combine; only digests that occur more than once are joined back, and a hot
    digest is then one small row on the other side of a join that adaptive execution can split."""
    able = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = (
        able.groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri"))
    )
    again = able.select("page_id", "payload_digest", "payload_bytes").distinct().join(first, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to")
    return again.select("page_id", "payload_digest", "refers_to", "refers_uri")


def archive_records(pages: DataFrame, revisits: DataFrame, date: str = "2024-01-01T00:00:00Z", parts: int | None = None) -> DataFrame:
    """One row `value` per page: the full text of its WARC record without the closing line ends."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha2(payload_of(), 256).alias("payload_digest"))
    if parts:
        rows = rows.repartition(parts, "page_id", "payload_digest")
    rows = rows.join(revisits, ["page_id", "payload_digest"], "left")
    clean = lambda uri, key: F.coalesce(F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("none"))))
    urn = lambda key: F.concat(F.lit("<urn:tessella:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(":"), "payload_digest", F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    key = F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit(""))
    refers = F.when(
        again,
        F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("refers_to"))),
            line("WARC-Refers-To-Target-URI", clean(F.col("refers_uri"), F.col("refers_to"))),
            line("WARC-Refers-To-Date", F.lit(date)),
        ),
    ).otherwise(F.lit(""))
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn(F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", clean(F.col("url"), F.col("page_id"))),
            key,
            refers,
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 128 << 20) -> str:
    """Write the pages as deduplicated WARC files of about archive_bytes (before compression) below path."""
    heads = cut(headers(pages))
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(default_parallelism(pages.sparkSession), -(-total // archive_bytes))
    records = archive_records(pages, resolve_revisits(heads, least_bytes), date, parts)
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


def _inflated(content: bytes) -> bytes:
    out, rest = [], content
    while rest:  # members follow each other
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest))
        rest = member.unused_data
    return b"".join(out)


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive; lengths are believed, so a payload may hold line ends or record starts."""
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, length = end + 4, int(named["content-length"])
        block = data[start : start + length]
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        refers = named.get("warc-refers-to", "")
        yield {
            "page_id": int(named["x-page-id"]) if "x-page-id" in named else None,
            "target_uri": named.get("warc-target-uri"),
            "record_id": named.get("warc-record-id"),
            "record_type": named.get("warc-type"),
            "refers_to": int(refers.strip("<>").split(":")[3]) if refers else None,
            "declared_digest": named.get("warc-payload-digest", "").removeprefix("sha256:"),
            "declared_bytes": declared,
            "payload": None if named.get("warc-type") == "revisit" else payload,
        }
        at = start + length + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in RECORDS.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.strip().split()[0], kinds[x.strip().split()[1]]) for x in RECORDS.split(",")])
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for row in parse_archive(content.as_py()):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in names], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in names], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, payloads of responses included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse, RECORDS)


def resolved_payloads(records: DataFrame) -> DataFrame:
    """Every record with the payload it stands for: a revisit gets that of the response it refers to, by page_id and
    the digest of what is stored there."""
    stored = records.where("record_type = 'response' and page_id is not null")
    originals = stored.select(F.col("page_id").alias("refers_to"), F.sha2("payload", 256).alias("declared_digest"), F.col("payload").alias("original")).dropDuplicates(["refers_to", "declared_digest"])
    return records.join(originals, ["refers_to", "declared_digest"], "left").withColumn("payload", F.coalesce("payload", "original")).drop("original")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive read back. Digests and lengths are those of stored payloads; a revisit has those of the response that
    it is resolved to, so only they move."""
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_path(spark, "warc"))
    records = cut(read_archives(spark, path).select("page_id", "record_type", "refers_to", "declared_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")))
    originals = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")).agg(F.first("payload_bytes").alias("original_bytes"))
    again = F.col("record_type") == "revisit"
    return records.join(originals, ["refers_to", "declared_digest"], "left").select(
        "page_id",
        F.when(again, F.col("original_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.when(F.col("original_bytes").isNotNull(), F.col("declared_digest"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS r FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.r IS NULL OR f.r = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.r <> p.page_id THEN f.r END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
