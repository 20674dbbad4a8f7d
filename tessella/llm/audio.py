"""MPEG audio as a media column: a lossless carrier of 8-bit payloads, and a reader that resynchronises.

Payloads travel as MPEG-1 Layer III frames of 48 kHz, 224 kbit/s, mono: 672 bytes each, of which 4 are the header, 2 the
checksum, 17 the side information (all granules empty, so decoders play silence and skip the ancillary bytes), 576
the payload and the rest stuffing. A file starts with an ID3v2 tag and a variable-bitrate table (frame count, byte
count, seek table) in a frame of its own and ends with an ID3v1 tag.

The reader trusts none of that: it skips tags, searches a sync word whose frame is followed by another sync word or
by the end, steps from header to header, resynchronises after damage, checks the CRC-16 of every protected frame and
keeps exact durations (in samples) and the byte offset of each frame.

Defined cases: a null text is an empty payload; every payload is padded with bytes 255 to a positive multiple of 576;
null doc_id stays null; empty tables give empty results; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import utf8, work_path

UNIT, RATE, KBPS, SAMPLES = 576, 48_000, 224, 1152
FRAME = 144 * KBPS * 1000 // RATE
HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC4])  # MPEG-1, Layer III, protected; 224 kbit/s, 48 kHz; mono
SIDE = 17  # bytes of side information of a mono frame
DATA_AT = 4 + 2 + SIDE
ID3 = b"ID3\x04\x00\x00\x00\x00\x00\x00"

# Fixed values of the format: kbit/s by (layer III of MPEG-1, layer III of MPEG-2) and Hz by version.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 8005, start FFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) ^ CRC[((crc >> 8) ^ column) & 0xFF]) & 0xFFFF
    return crc


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _frames(chunks: np.ndarray) -> np.ndarray:
    frames = np.zeros((len(chunks), FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, DATA_AT : DATA_AT + chunks.shape[1]] = chunks
    crc = checksums(np.concatenate([frames[:, 2:4], frames[:, 6 : 6 + SIDE]], axis=1))
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 0xFF
    return frames


def encode(payload: bytes) -> bytes:
    """The payload, a multiple of 576 bytes, as an MPEG audio file."""
    audio = _frames(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
    n, size = len(audio) + 1, FRAME * (len(audio) + 1)
    seeks = bytes(min(255, i * 256 // 100) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + (n - 1).to_bytes(4, "big") + size.to_bytes(4, "big") + seeks
    first = np.zeros((1, UNIT), np.uint8)
    first[0, : len(table)] = np.frombuffer(table, np.uint8)
    tag = b"TAG" + b"tessella payload".ljust(30, b"\0") + b"\0" * 95
    return b"".join((ID3, _frames(first).tobytes(), audio.tobytes(), tag))


@dataclass
class Stream:
    """What the reader finds in a file."""

    offsets: list[int] = field(default_factory=list)  # of audio frames, the table's frame left out
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    skipped: int = 0  # bytes outside frames and tags
    tags: int = 0
    declared: int | None = None  # frames by the variable-bitrate table
    data: list[bytes] = field(default_factory=list)


def header(data: bytes, at: int) -> tuple[int, int, int, bool, int] | None:
    """(length, samples, Hz, protected, side bytes) of the Layer III frame header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, rate, hz = b1 >> 3 & 3, b1 >> 1 & 3, b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer != 1 or rate in (0, 15) or hz == 3 or b3 & 3 == 2:
        return None
    one, hertz = version == 3, HERTZ[version][hz]
    length = (144 if one else 72) * (RATES_1 if one else RATES_2)[rate] * 1000 // hertz + (b2 >> 1 & 1)
    mono = b3 >> 6 == 3
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return length, 1152 if one else 576, hertz, not b1 & 1, side


def _chained(data: bytes, at: int, end: int) -> bool:
    """Whether the frame at a place is followed by another or by the end: a sync word alone proves nothing."""
    found = header(data, at)
    return bool(found) and (at + found[0] == end or at + found[0] < end and header(data, at + found[0]) is not None)


def decode(data: bytes) -> Stream:
    """Read a file: tags, table, frames; resynchronise where bytes make no frame."""
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        a, b, c, d = (x & 0x7F for x in data[at + 6 : at + 10])
        at += 10 + (a << 21 | b << 14 | c << 7 | d)
        out.tags += 1
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags += 1
    checked: dict[tuple[int, int], list[int]] = {}
    synced = False
    while at + 4 <= end:
        found = header(data, at)
        if found is None or at + found[0] > end or not synced and not _chained(data, at, end):
            later = data.find(b"\xff", at + 1, end)
            out.skipped += (later if later >= 0 else end) - at
            at, synced = later if later >= 0 else end, False
            continue
        length, samples, hertz, protected, side = found
        body = at + 4 + 2 * protected + side
        if protected:
            checked.setdefault((length, side), []).append(at)
        if not out.offsets and out.declared is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(data[body + 4 : body + 8], "big")
            out.declared = int.from_bytes(data[body + 8 : body + 12], "big") if flags & 1 else -1
        else:
            out.offsets.append(at)
            out.lengths.append(length)
            out.samples += samples
            out.rate = hertz
            out.data.append(data[body : body + UNIT])
        at, synced = at + length, True
    out.skipped += end - at
    view = np.frombuffer(data, np.uint8)
    for (_, side), places in checked.items():
        index = np.array(places)[:, None] + np.array([2, 3, *range(6, 6 + side)])
        stored = view[np.array(places) + 4].astype(np.uint32) << 8 | view[np.array(places) + 5]
        out.bad_crc += int((checksums(view[index]) != stored).sum())
    return out


STORED = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, frames long, bad_crc long, seek_offsets array<long>"
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            ids, texts = batch.column(0).slice(start, 500), batch.column(1).slice(start, 500).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split() for x in FEATURES.split(","))])
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part, rows = batch.slice(start, 1000), []
            for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s = decode(media)
                payload = b"".join(s.data)
                text = f"mpeg1-l3;hz={s.rate};frames={len(s.offsets)};samples={s.samples};table={s.declared};tags={s.tags};bad_crc={s.bad_crc};skipped={s.skipped}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), text, s.samples, s.rate, len(s.offsets), s.bad_crc, s.offsets))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def store_media(docs: DataFrame, path: str) -> str:
    """Write each text of docs (doc_id, text) as an MPEG audio file into a table below path."""
    docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(_store, STORED).write.option("compression", "zstd").parquet(path)
    return path


def describe_media(media: DataFrame) -> DataFrame:
    """Read stored files (doc_id, n_bytes, media) back: payload digests, checks, exact duration, seek offsets."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, FEATURES)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), work_path(spark, "audio"))
    return describe_media(spark.read.parquet(path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
