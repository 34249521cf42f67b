"""Application archives: entries, binary XML and resource tables, decoded in Arrow batches.

Formats are those of the Android platform's public documentation: chunks of (type, header
size, size), a string pool, and typed values.
"""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Chunk types.
STRING_POOL, TABLE, XML = 0x0001, 0x0002, 0x0003
XML_START_NS, XML_END_NS, XML_START, XML_END, XML_TEXT = 0x0100, 0x0101, 0x0102, 0x0103, 0x0104
TABLE_PACKAGE, TABLE_TYPE = 0x0200, 0x0201
# Types of a resource value.
REFERENCE, STRING, FLOAT, DIMENSION, DECIMAL, HEXADECIMAL, BOOLEAN = 0x01, 0x03, 0x04, 0x05, 0x10, 0x11, 0x12


def entries(spark: SparkSession, path: str, pattern: str = r".*") -> DataFrame:
    """(app, name, size, content) of the archives' entries whose names match."""

    def run(frames):
        import re

        wanted = re.compile(pattern)
        for frame in frames:
            for app, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():  # one row at a time: an archive's entries need not fit in one batch
                        if not info.is_dir() and wanted.fullmatch(info.filename):
                            yield pd.DataFrame([(app, info.filename, info.file_size, archive.read(info))], columns=["app", "name", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "app string, name string, size long, content binary")


def replaced(content: bytes, changes: dict[str, bytes]) -> bytes:
    """An archive with entries added or replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            if info.filename not in changes:
                new.writestr(info, old.read(info))
        for name, data in changes.items():
            new.writestr(name, data)
    return out.getvalue()


def _length(data: bytes, at: int, wide: bool) -> tuple[int, int]:
    if wide:
        n = struct.unpack_from("<H", data, at)[0]
        return (n, at + 2) if not n & 0x8000 else ((n & 0x7FFF) << 16 | struct.unpack_from("<H", data, at + 2)[0], at + 4)
    return (data[at], at + 1) if not data[at] & 0x80 else ((data[at] & 0x7F) << 8 | data[at + 1], at + 2)


def string_pool(data: bytes, at: int) -> list[str]:
    _, header, _ = struct.unpack_from("<HHI", data, at)
    count, _, flags, start, _ = struct.unpack_from("<5I", data, at + 8)
    out = []
    for offset in struct.unpack_from(f"<{count}I", data, at + header):
        p = at + start + offset
        if flags & 0x100:  # UTF-8: length in characters, then in bytes
            _, p = _length(data, p, False)
            n, p = _length(data, p, False)
            out.append(data[p : p + n].decode("utf-8", "replace"))
        else:
            n, p = _length(data, p, True)
            out.append(data[p : p + 2 * n].decode("utf-16-le", "replace"))
    return out


def value(kind: int, data: int, strings: list[str]) -> str:
    if kind == STRING:
        return strings[data] if data < len(strings) else ""
    if kind == BOOLEAN:
        return "true" if data else "false"
    if kind == REFERENCE:
        return f"@{data:08x}"
    if kind == FLOAT:
        return repr(struct.unpack("<f", struct.pack("<I", data))[0])
    if kind == DECIMAL:
        return str(data - (1 << 32) if data >= 1 << 31 else data)
    return f"0x{data:08x}"


def binary_xml(data: bytes) -> list[tuple[int, int, str, dict[str, str]]]:
    """(number, number of the parent or -1, tag, attributes) of each element."""
    kind, at, _ = struct.unpack_from("<HHI", data, 0)
    if kind != XML:
        raise ValueError("not a binary XML document")
    strings, out, open_ = [], [], []
    while at + 8 <= len(data):
        kind, header, size = struct.unpack_from("<HHI", data, at)
        if kind == STRING_POOL:
            strings = string_pool(data, at)
        elif kind == XML_START:
            _, name, start, width, count = struct.unpack_from("<iiHHH", data, at + header)
            attributes = {}
            for i in range(count):
                _, key, raw, _, _, type_, content = struct.unpack_from("<iiiHBBI", data, at + header + start + i * width)
                attributes[strings[key]] = strings[raw] if raw >= 0 else value(type_, content, strings)
            out.append((len(out), open_[-1] if open_ else -1, strings[name], attributes))
            open_.append(len(out) - 1)
        elif kind == XML_END and open_:
            open_.pop()
        if size < 8:
            raise ValueError("a chunk has no length")
        at += size
    return out


def resources(data: bytes) -> list[tuple[int, str, str, str, str]]:
    """(id, package, type, name, value) of the simple entries of a resource table."""
    kind, at, _ = struct.unpack_from("<HHI", data, 0)
    if kind != TABLE:
        raise ValueError("not a resource table")
    strings, out = [], []
    while at + 8 <= len(data):
        kind, header, size = struct.unpack_from("<HHI", data, at)
        if kind == STRING_POOL:
            strings = string_pool(data, at)
        elif kind == TABLE_PACKAGE:
            number = struct.unpack_from("<I", data, at + 8)[0]
            package = data[at + 12 : at + 268].decode("utf-16-le").split("\0")[0]
            types_at, _, keys_at = struct.unpack_from("<III", data, at + 268)
            types, keys, p = string_pool(data, at + types_at), string_pool(data, at + keys_at), at + header
            while p + 8 <= at + size:
                inner, inner_header, inner_size = struct.unpack_from("<HHI", data, p)
                if inner == TABLE_TYPE:
                    type_id, count, start = data[p + 8], *struct.unpack_from("<II", data, p + 12)
                    for i, offset in enumerate(struct.unpack_from(f"<{count}I", data, p + inner_header)):
                        if offset != 0xFFFFFFFF:
                            e = p + start + offset
                            entry_size, flags, key = struct.unpack_from("<HHI", data, e)
                            if not flags & 1:  # complex entries have no single value
                                _, _, type_, content = struct.unpack_from("<HBBI", data, e + entry_size)
                                out.append((number << 24 | type_id << 16 | i, package, types[type_id - 1], keys[key], value(type_, content, strings)))
                p += max(8, inner_size)
        at += max(8, size)
    return out


def elements(files: DataFrame) -> DataFrame:
    """(app, name, number, parent, tag, attributes) of entries (app, name, content) in binary XML."""

    def run(frames):
        for frame in frames:
            for app, name, content in zip(frame["app"], frame["name"], frame["content"], strict=True):
                rows = [(app, name, *e) for e in binary_xml(content)]
                yield pd.DataFrame(rows, columns=["app", "name", "number", "parent", "tag", "attributes"])

    return files.select("app", "name", "content").mapInPandas(run, "app string, name string, number int, parent int, tag string, attributes map<string,string>")


def resource_table(files: DataFrame) -> DataFrame:
    """(app, id, package, type, name, value) of entries (app, content)."""

    def run(frames):
        for frame in frames:
            for app, content in zip(frame["app"], frame["content"], strict=True):
                yield pd.DataFrame([(app, *r) for r in resources(content)], columns=["app", "id", "package", "type", "name", "value"])

    return files.select("app", "content").mapInPandas(run, "app string, id long, package string, type string, name string, value string")


def components(xml: DataFrame) -> DataFrame:
    """(app, kind, name, exported) of the enabled components in elements of manifests."""
    a = F.col("attributes")
    rows = xml.where(F.col("tag").isin("activity", "service", "receiver", "provider") & (F.coalesce(a["enabled"], F.lit("true")) == "true"))
    return rows.select("app", F.col("tag").alias("kind"), a["name"].alias("name"), (F.coalesce(a["exported"], F.lit("false")) == "true").alias("exported"))
