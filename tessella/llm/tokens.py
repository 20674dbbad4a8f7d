"""Token counts by offset-mapped attribution.

A document is rendered from its fields once and encoded once as a whole. The byte lengths of its tokens, prefix-summed,
are the offset map; fields and the lines of the last field are half-open byte intervals; both lists are sorted, so the
interval join is one binary search per document. A token that crosses a boundary goes to one interval by an explicit rule:

* `start`: the interval that holds the token's first byte (default);
* `end`: that of its last byte;
* `largest`: that with most of its bytes, the earlier one on ties.

Defined cases: null fields are empty; a null or empty text has one empty section with no tokens of its own; null ids
stay null; repeated rows are counted each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "largest")
#: Longer runs without white space are encoded in pieces of so many characters at white space or field ends only.
SEPARATOR = b"\n"

_ENCODERS: dict = {}


def encoder(vocabulary: str, pattern: str):
    """The byte-level encoding of a rank file and the byte length of each token; loaded once per process."""
    if (vocabulary, pattern) not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[vocabulary, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[vocabulary, pattern]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens per interval and the number of tokens that cross a boundary.

    starts, ends: of tokens, in order. bounds: the starts of the intervals, in order, the first 0; each ends where the
    next one starts, the last at infinity. Empty intervals get no tokens."""
    first, last = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends - 1, "right") - 1
    owner = first if rule == "start" else last
    if rule == "largest":
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            cuts = np.concatenate([[starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
            owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(bounds)).astype(np.int64), int((first != last).sum())


def count_document(fields: list[bytes], vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "start") -> tuple[int, np.ndarray, np.ndarray, int]:
    """(tokens, tokens by field, tokens by line of the last field, tokens that cross fields or lines)."""
    coder, sizes = encoder(vocabulary, pattern)
    whole = SEPARATOR.join(fields).decode("utf-8", "replace")
    data = whole.encode()
    if len(data) != sum(map(len, fields)) + len(fields) - 1:  # bytes that aren't UTF-8 were replaced
        fields = [x.decode("utf-8", "replace").encode() for x in fields]
    ids = np.asarray(coder.encode_to_numpy(whole, disallowed_special=()) if whole else [], np.int64)
    ends = np.cumsum(sizes[ids]) if len(ids) else ids
    starts = ends - sizes[ids] if len(ids) else ids
    edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in fields[:-1]], dtype=np.int64)]).astype(np.int64)
    breaks = np.flatnonzero(np.frombuffer(fields[-1], np.uint8) == 10) + 1 + edges[-1]
    lines = np.concatenate([edges, breaks])
    by_line, crossing = attribute(starts, ends, lines, rule)
    by_field, _ = attribute(starts, ends, edges, rule)
    return len(ids), by_field, by_line[len(edges) - 1 :], crossing


def attribute_tokens(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"), vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "start") -> DataFrame:
    """Per row: the key, n_tokens, n_crossing, field_tokens (in order of fields), line_tokens (of the last field).

    Fields are joined by line feeds; a separator counts to the field before it. A line includes its line feed."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(start, 1000), []
                for parts in zip(*(part.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                    n, by_field, by_line, crossing = count_document(list(parts), vocabulary, pattern, rule)
                    rows.append((n, crossing, by_field, by_line))
                n, crossing, by_field, by_line = zip(*rows, strict=True)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(by_field, longs), pa.array(by_line, longs)], names=[key, "n_tokens", "n_crossing", "field_tokens", "line_tokens"])

    columns = [utf8(f).alias(f"field{i}") for i, f in enumerate(fields)]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), *columns).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_crossing long, field_tokens array<long>, line_tokens array<long>")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
