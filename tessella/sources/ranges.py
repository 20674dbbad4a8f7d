"""Byte ranges of text files, for data sources that are read by many tasks. Paths are those of pyarrow's file systems: local
ones, and URIs such as file, hdfs or s3 ones."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes that are held at once.
CHUNK = 1 << 22


@dataclass
class ByteRange(InputPartition):
    """A file's bytes from start up to stop."""

    file: str
    start: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files(path: str) -> list[tuple[str, int, int]]:
    """(name, size, identity) of a file, or of those below a folder but for names that start with . or _; identity is a local
    file's inode, so a file that was replaced is known as another one, and 0 elsewhere. Nothing if there is no such path."""
    store, at = opened(path)
    own = store.get_file_info(at)
    found = store.get_file_info(fs.FileSelector(at, recursive=True)) if own.type == fs.FileType.Directory else [own]
    scheme = path[: len(path) - len(path.lstrip("abcdefghijklmnopqrstuvwxyz0123456789+."))] if "://" in path else ""
    local = isinstance(store, fs.LocalFileSystem)
    out = []
    for f in found:
        below = f.path[len(at) :].split("/") if f.path != at else []
        if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in below):
            out.append((f.path if local or not scheme else f"{scheme}://{f.path}", f.size, os.stat(f.path).st_ino if local else 0))
    return sorted(out)


def split(file: str, start: int, stop: int, most: int) -> list[ByteRange]:
    """Ranges of at most so many bytes."""
    return [ByteRange(file, a, min(stop, a + most)) for a in range(start, stop, most)]


def _line_end(f, at: int) -> int | None:
    """The place behind the first line feed from `at` on, or None."""
    f.seek(at)
    while data := f.read(CHUNK):
        if (found := data.find(b"\n")) >= 0:
            return at + found + 1
        at += len(data)
    return None


def _line_start(f, at: int) -> int:
    """The place behind the last line feed before `at`, or 0."""
    while at > 0:
        low = max(0, at - CHUNK)
        f.seek(low)
        if (found := f.read(at - low).rfind(b"\n")) >= 0:
            return low + found + 1
        at = low
    return 0


def started(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the whole lines that start within the range; a line that goes on beyond it is read to its end, and
    the last one of the file needs no line feed."""
    store, path = opened(part.file)
    with store.open_input_file(path) as f:
        at = part.start if part.start == 0 else _line_end(f, part.start - 1)
        if at is None:
            return
        f.seek(at)
        rest = b""
        while at + len(rest) < part.stop:
            data = f.read(min(CHUNK, part.stop - at - len(rest)))
            if not data:
                break
            rest += data
            if end := rest.rfind(b"\n") + 1:
                yield at, rest[:end]
                at, rest = at + end, rest[end:]
        if rest:  # the line on which the range ends
            more = []
            while data := f.read(CHUNK):
                more.append(data)
                if b"\n" in data:
                    break
            rest = b"".join([rest, *more])
            yield at, rest[: rest.find(b"\n") + 1] or rest


def ended(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the whole lines whose line feeds lie within the range; a line that starts before it is read from its
    start. What has no line feed yet belongs to no range."""
    store, path = opened(part.file)
    with store.open_input_file(path) as f:
        at, rest = None, b""
        here = part.start
        while here < part.stop:
            f.seek(here)
            data = f.read(min(CHUNK, part.stop - here))
            if not data:  # the file was cut off meanwhile
                break
            here += len(data)
            if at is None:
                if b"\n" not in data:
                    continue
                at = _line_start(f, here - len(data))
                f.seek(at)
                rest = f.read(here - len(data) - at)
            rest += data
            if end := rest.rfind(b"\n") + 1:
                yield at, rest[:end]
                at, rest = at + end, rest[end:]
