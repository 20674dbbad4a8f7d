"""Binary documents (PDF) as tables: objects, pages and text, parsed from Spark's own binary-file scan.

A document is one row of that scan; documents are read in parallel. Newer cross-reference sections win over older
ones, an object ends where the next one starts, stream filters may be lists, and predictor sums are taken modulo 256."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Ref(tuple):
    """(object, generation)"""


class Name(str):
    """A name without its slash."""


class Operator(bytes):
    """A word of a content stream that isn't a value."""


class Stream(dict):
    """A dictionary with raw bytes in `.raw`."""

    raw: bytes = b""


def address_table(rows: DataFrame, end: Column) -> DataFrame:
    """(doc, obj, start, stop) of (doc, obj, start): an object stops where the next one of its document starts, the last
    one at end."""
    order = Window.partitionBy("doc").orderBy("start", "obj")
    return rows.select("doc", "obj", "start", F.coalesce(F.lead("start").over(order), end).alias("stop"))


class Reader:
    """Values from bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data) and (m := re.compile(rb"[\x00\s]+|%[^\r\n]*").match(self.data, self.at)):
            self.at = m.end()

    def value(self):
        """The next value; an operator comes as Operator; None at the end."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        two = d[at : at + 2]
        if two == b"<<":
            self.at += 2
            return self._dictionary()
        c = d[at : at + 1]
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] in (b"]", b""):
                    self.at += 1
                    return out
                out.append(self.value())
        if c == b"(":
            return self._string()
        if c == b"<":
            stop = d.index(b">", at)
            self.at = stop + 1
            text = re.sub(rb"\s", b"", d[at + 1 : stop])
            return bytes.fromhex((text + b"0" * (len(text) % 2)).decode())
        if c == b"/":
            m = re.compile(rb"/([^\s\x00<>\[\](){}/%]*)").match(d, at)
            self.at = m.end()
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[1].decode("latin-1")))
        if m := re.compile(rb"([0-9]+)\s+([0-9]+)\s+R(?![A-Za-z])").match(d, at):
            self.at = m.end()
            return Ref((int(m[1]), int(m[2])))
        if m := re.compile(rb"[-+]?[0-9]*\.?[0-9]+\.?").match(d, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        m = re.compile(rb"[^\s\x00<>\[\](){}/%]+|.", re.S).match(d, at)
        self.at = m.end()
        return {b"true": True, b"false": False}.get(m[0], None if m[0] == b"null" else Operator(m[0]))

    def _dictionary(self) -> dict:
        out = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>" or self.at >= len(self.data):
                self.at += 2
                return out
            key = self.value()
            out[str(key)] = self.value()

    def _string(self) -> bytes:
        out, depth, at, d = bytearray(), 1, self.at + 1, self.data
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        while depth and at < len(d):
            c = d[at : at + 1]
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(d, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                nxt = d[at + 1 : at + 2]
                out += b"" if nxt in (b"\n", b"\r") else plain.get(nxt, nxt)
                at += 2
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
            at += 1
        self.at = at
        return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, n, last = bytearray(), 0, 9, 0, None
    for byte in data:
        held, n = held << 8 | byte, n + 8
        while n >= bits:
            n -= bits
            code, held = held >> n, held & ((1 << n) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                bits, last = 9, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            bits = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def undo_predictor(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """PNG row filters 0 to 4 (predictor 10 and over) and the 8-bit TIFF predictor (2)."""
    if predictor < 2:
        return data
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        out = bytearray(data)
        for start in range(0, len(out), width):
            for i in range(start + step, min(start + width, len(out))):
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out, above = bytearray(), bytearray(width)
    for start in range(0, len(data), width + 1):
        kind, row = data[start], bytearray(data[start + 1 : start + 1 + width])
        for i in range(len(row)):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if kind == 4:
                guess = a + b - c
                near = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + near) & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


#: Samples per pixel by family of colour space; others depend on their parameters.
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1, "Separation": 1, "Pattern": 1}


def components(space, n: int | None = None) -> int | None:
    """Of a colour space by name, or of an array of its family and parameters."""
    family, rest = (space[0], space[1:]) if isinstance(space, list) else (space, [])
    if family == "ICCBased":
        return n
    if family == "DeviceN":
        return len(rest[0]) if rest else n
    return COMPONENTS.get(family)


def zigzag(n: int = 8) -> list[int]:
    """Positions of an n by n block in zigzag order."""
    return [y * n + x for x, y in sorted(((x, y) for x in range(n) for y in range(n)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 else p[0]))]


def canonical_codes(counts: list[int], symbols: list[int]) -> dict[str, int]:
    """Bit strings of a canonical prefix code: counts of codes by length from 1 on; leading zeros are kept."""
    out, code, at = {}, 0, 0
    for size, count in enumerate(counts, 1):
        for _ in range(count):
            out[format(code, f"0{size}b")] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def cmap(data: bytes) -> dict[int, str]:
    """Character codes to text of a ToUnicode table: single characters and ranges."""
    text = lambda b: b.decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        r = Reader(block)
        while (code := r.value()) is not None:
            out[int.from_bytes(code, "big")] = text(r.value())
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        r = Reader(block)
        while (low := r.value()) is not None:
            high, to = r.value(), r.value()
            first = int.from_bytes(low, "big")
            for i in range(int.from_bytes(high, "big") - first + 1):
                out[first + i] = text(to[i]) if isinstance(to, list) else text(to[:-1] + bytes([(to[-1] + i) & 255]))
    return out


class Document:
    """One file: cross references, objects, pages."""

    def __init__(self, data: bytes):
        self.data, self.trailer, self.offsets, self.cache = data, {}, {}, {}
        found = re.findall(rb"startxref\s+([0-9]+)", data[-2048:])
        at, seen = int(found[-1]) if found else None, set()
        while at is not None and at not in seen:
            seen.add(at)
            at = self._section(at)

    def _section(self, at: int) -> int | None:
        """Read a cross-reference section; what newer ones said stays. The offset of the previous one."""
        r = Reader(self.data, at)
        if r.value() != b"xref":
            return None
        while True:
            r.skip()
            m = re.compile(rb"([0-9]+)\s+([0-9]+)\s*").match(self.data, r.at)
            if not m:
                break
            r.at = m.end()
            for i in range(int(m[2])):
                e = re.compile(rb"\s*([0-9]{10})\s([0-9]{5})\s([nf])").match(self.data, r.at)
                r.at = e.end()
                self.offsets.setdefault(int(m[1]) + i, int(e[1]) if e[3] == b"n" else None)
        r.value()  # trailer
        trailer = r.value() or {}
        self.trailer = trailer | self.trailer
        return trailer.get("Prev")

    def get(self, value):
        """What a reference stands for; other values as they are."""
        if not isinstance(value, Ref):
            return value
        if value[0] not in self.cache:
            at = self.offsets.get(value[0])
            self.cache[value[0]] = self._object(at) if at is not None else None
        return self.cache[value[0]]

    def _object(self, at: int):
        r = Reader(self.data, at)
        m = re.compile(rb"\s*[0-9]+\s+[0-9]+\s+obj").match(self.data, at)
        if not m:
            return None
        r.at = m.end()
        value = r.value()
        if isinstance(value, dict) and (m := re.compile(rb"\s*stream\r?\n").match(self.data, r.at)):
            stream, size = Stream(value), self.get(value.get("Length"))
            stop = m.end() + size if isinstance(size, int) else self.data.find(b"endstream", m.end())
            stream.raw = self.data[m.end() : stop]
            return stream
        return value

    def content(self, stream: Stream) -> bytes | None:
        """The bytes behind the filters; None for filters that aren't supported."""
        data = stream.raw
        filters, params = self.get(stream.get("Filter")), self.get(stream.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        params = params if isinstance(params, list) else [params] * len(filters)
        for name, p in zip(filters, params, strict=False):
            p = self.get(p) or {}
            if name in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
            elif name in ("LZWDecode", "LZW"):
                data = lzw(data, p.get("EarlyChange", 1))
            elif name in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[\s>]", b"", data).decode())
            else:
                return None
            data = undo_predictor(data, p.get("Predictor", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
        return data

    def pages(self) -> list[dict]:
        """The pages in order, resources inherited."""
        out, seen = [], set()

        def walk(ref, resources) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
                return
            seen.add(ref if isinstance(ref, Ref) else id(node))
            own = self.get(node.get("Resources")) or resources
            if node.get("Type") == "Page":
                out.append(node | {"Resources": own})
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, own)

        walk((self.get(self.trailer.get("Root")) or {}).get("Pages"), {})
        return out

    def fonts(self, page: dict) -> dict[str, dict[int, str] | None]:
        found = {}
        for name, ref in (self.get((page.get("Resources") or {}).get("Font")) or {}).items():
            font = self.get(ref) or {}
            table = self.get(font.get("ToUnicode"))
            found[name] = cmap(self.content(table) or b"") if isinstance(table, Stream) else {"MacRomanEncoding": "mac_roman"}.get(self.get(font.get("Encoding")), "cp1252")
        return found

    def text(self, page: dict) -> list[tuple[str | None, str]]:
        """(font, text) of the strings shown between BT and ET, in order; the font carries over."""
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        data = b"\n".join(self.content(s) or b"" for s in map(self.get, parts) if isinstance(s, Stream))
        fonts, font, inside, stack, out = self.fonts(page), None, False, [], []
        r = Reader(data)
        while r.at < len(data):
            v = r.value()
            if not isinstance(v, Operator):
                stack.append(v)
                continue
            if v in (b"BT", b"ET"):
                inside = v == b"BT"
            elif v == b"Tf":
                font = next((str(x) for x in stack if isinstance(x, Name)), font)
            elif v in (b"Tj", b"TJ", b"'", b'"'):
                shown = [x for y in stack for x in (y if isinstance(y, list) else [y])]
                out += [(font, self._shown(x, fonts.get(font, "cp1252"))) for x in shown if inside and isinstance(x, bytes)]
            stack = []
        return out

    @staticmethod
    def _shown(raw: bytes, table) -> str:
        if isinstance(table, str):
            return raw.decode(table, "replace")
        wide = any(k > 255 for k in table)
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else list(raw)
        return "".join(table.get(c, chr(c) if c < 256 else "�") for c in codes)


def plain(value):
    """A value for JSON: references as `n g R`, bytes as Latin-1 text."""
    if isinstance(value, Ref):
        return f"{value[0]} {value[1]} R"
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


SCHEMAS = {"objects": "path string, obj int, start long, stop long, value string", "text": "path string, page int, seq int, font string, text string", "pages": "path string, page int, resources string, strings int"}


def rows(path: str, data: bytes, table: str) -> Iterator[tuple]:
    """The rows of one document for a table of SCHEMAS."""
    doc = Document(data)
    if table == "objects":
        live = sorted((at, obj) for obj, at in doc.offsets.items() if at is not None)
        for (at, obj), stop in zip(live, [a for a, _ in live[1:]] + [len(data)], strict=True):
            yield path, obj, at, stop, json.dumps(plain(doc.get(Ref((obj, 0)))))
        return
    for n, page in enumerate(doc.pages(), 1):
        found = doc.text(page)
        if table == "pages":
            yield path, n, json.dumps(plain(page["Resources"])), len(found)
        else:
            for i, (font, text) in enumerate(found):
                yield path, n, i, font, text


def read(spark: SparkSession, path: str, table: str = "text") -> DataFrame:
    """A table of all documents below path, on any file system: Spark lists and reads the files."""
    import pandas as pd

    columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(rows(name, bytes(content), table)), columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMAS[table])
