"""Artifacts of variable layout, decoded in Arrow batches: one row of bytes becomes many records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times

PAGE = 4096
#: Names of the reasons of a change journal entry by bit; fixed values.
REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND",
    0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE",
    0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE",
    0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE",
    0x200000: "STREAM_CHANGE", 0x80000000: "CLOSE",
}
_ENTRY = struct.Struct("<IHHQQqQIIIIHH")
_SCRAPED = re.compile(rb"(?:[\x20-\x7e]\x00){4,}")
ROWS = 8192


def _usn_entries(data: bytes) -> Iterator[tuple]:
    """Entries of version 2; null pages are skipped as a whole, what isn't an entry by eight bytes."""
    at, end = 0, len(data) - _ENTRY.size
    while at <= end:
        size, major, _, ref, parent, usn, ticks, reason, _, _, attributes, length, start = _ENTRY.unpack_from(data, at)
        if size == 0 and at % PAGE == 0 and not any(data[at : at + PAGE]):
            at += PAGE
        elif 60 <= size <= 65536 and major == 2 and at + size <= len(data) and start + length <= size:
            name = data[at + start : at + start + length].decode("utf-16-le", "replace")
            yield usn, name, ref & 0xFFFFFFFFFFFF, ref >> 48, parent & 0xFFFFFFFFFFFF, bool(attributes & 0x10), reason, ticks
            at += size + 7 & ~7
        else:
            at += 8


def _log_records(data: bytes) -> Iterator[tuple]:
    """Records of an event log by chunk: number, ticks, offset, size and the first UTF-16 strings."""
    if data[:8] != b"ElfFile\0":
        return
    span = struct.unpack_from("<I", data, 44)[0] if len(data) >= 48 else 0
    span = span if span >= 512 else 65536
    for chunk in range(PAGE, len(data), span):
        if data[chunk : chunk + 8] != b"ElfChnk\0":
            continue
        free = min(struct.unpack_from("<I", data, chunk + 48)[0], span, len(data) - chunk)
        at = 512
        while at + 24 <= free:
            sign, size, number, ticks = struct.unpack_from("<IIQQ", data, chunk + at)
            if sign != 0x2A2A or size < 28 or at + size > free:
                break
            body = data[chunk + at + 24 : chunk + at + size - 4]
            found = list(dict.fromkeys(m[0].decode("utf-16-le") for m in _SCRAPED.finditer(body)))[:20]
            yield number, ticks, chunk + at, size, found
            at += size


def _decoded(rows: DataFrame, decode, kinds: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """One row for each tuple that ``decode`` makes of a content, in batches of bounded size; null contents have none."""
    names = ["path", "record_index", *(n for n, _ in kinds)]

    def batch(path: str, first: int, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int64()), *columns], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path, content in zip(given.column(0), given.column(1), strict=True):
                held, first = [], 0
                for row in decode(content.as_py() or b""):
                    held.append(row)
                    if len(held) == ROWS:
                        yield batch(path.as_py(), first, held)
                        first, held = first + ROWS, []
                if held:
                    yield batch(path.as_py(), first, held)

    return rows.select("path", "content").mapInArrow(work, f"path string, record_index long, {schema}")


def change_journal(rows: DataFrame) -> DataFrame:
    """Per entry of a change journal: usn, filename, numbers, is_directory, reason_flags (names), timestamp."""
    kinds = [(n, pa.int64()) for n in ("file_record_number", "file_sequence_number", "parent_record_number")]
    found = _decoded(
        rows, _usn_entries, [("usn", pa.int64()), ("filename", pa.string()), *kinds, ("is_directory", pa.bool_()), ("reason", pa.int64()), ("ticks", pa.int64())],
        "usn long, filename string, file_record_number long, file_sequence_number long, parent_record_number long, is_directory boolean, reason long, ticks long",
    )
    flags = F.filter(F.array(*(F.when(F.col("reason").bitwiseAND(F.lit(bit).cast("bigint")) != 0, F.lit(name)) for bit, name in REASONS.items())), lambda x: x.isNotNull())
    return found.select("*", flags.alias("reason_flags"), times.from_filetime(F.col("ticks")).alias("timestamp")).drop("reason", "ticks")


def event_log(rows: DataFrame) -> DataFrame:
    """Per record of an event log: record_number, offset, size, extracted_strings (20 at most), timestamp.

    Records without a valid time are left out. The binary XML of a record is not decoded.
    """
    kinds = [("record_number", pa.int64()), ("ticks", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("extracted_strings", pa.list_(pa.string()))]
    found = _decoded(rows, _log_records, kinds, "record_number long, ticks long, offset long, size long, extracted_strings array<string>")
    return found.withColumn("timestamp", times.from_filetime(F.col("ticks"))).where("timestamp is not null").drop("ticks")
