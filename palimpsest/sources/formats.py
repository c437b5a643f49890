"""Binary files of the same data: write-ahead logs and sorted files, decoded a file at a time into version rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions import bloom
from palimpsest.functions.hash32 import hash32_of
from palimpsest.shipping import ship

ROWS = "path string, key binary, commit_ts long, value binary"


class Damaged(ValueError):
    """A record ends before its length says so."""


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise Damaged(f"{n} bytes wanted at {at} of {len(data)}")
    return data[at : at + n]


def log_records(data: bytes, torn_tail: bool = True) -> Iterator[tuple[bytes, int, bytes]]:
    """Records of a write-ahead log; a torn last one is left out, or an error where torn_tail isn't allowed."""
    at = 0
    while at < len(data):
        try:
            (k,) = struct.unpack(">H", _take(data, at, 2))
            key, (ts,) = _take(data, at + 2, k), struct.unpack(">Q", _take(data, at + 2 + k, 8))
            (v,) = struct.unpack(">H", _take(data, at + 10 + k, 2))
            value = _take(data, at + 12 + k, v)
        except Damaged:
            if torn_tail:
                return
            raise
        yield key, ts, value
        at += 12 + k + v


def log_bytes(rows: list[tuple[bytes, int, bytes]]) -> bytes:
    return b"".join(struct.pack(">H", len(k)) + k + struct.pack(">QH", ts, len(v)) + v for k, ts, v in rows)


def block_bytes(rows: list[tuple[bytes, int, bytes]]) -> bytes:
    """A block of rows in order; it can't be empty."""
    if not rows:
        raise ValueError("a block needs a row")
    first, body, offsets = rows[0][0], b"", []
    for key, ts, value in rows:
        shared = 0
        if offsets:
            limit = min(len(first), len(key))
            shared = next((i for i in range(limit) if first[i] != key[i]), limit)
        offsets.append(len(body))
        body += struct.pack(">HH", shared, len(key) - shared) + key[shared:] + struct.pack(">QH", ts, len(value)) + value
    return body + struct.pack(f">{len(offsets)}HH", *offsets, len(offsets))


def block_rows(data: bytes) -> list[tuple[bytes, int, bytes]]:
    (n,) = struct.unpack(">H", _take(data, len(data) - 2, 2))
    offsets = struct.unpack(f">{n}H", _take(data, len(data) - 2 - 2 * n, 2 * n))
    out: list[tuple[bytes, int, bytes]] = []
    for at in offsets:
        shared, rest = struct.unpack(">HH", _take(data, at, 4))
        key = (out[0][0][:shared] if out else b"") + _take(data, at + 4, rest)
        ts, v = struct.unpack(">QH", _take(data, at + 4 + rest, 10))
        out.append((key, ts, _take(data, at + 14 + rest, v)))
    return out


def meta_bytes(metas: list[tuple[int, tuple[bytes, int], tuple[bytes, int]]]) -> bytes:
    """Offset u64, then length u16, key and timestamp u64 of the first and the last entry, for each block."""
    side = lambda k, ts: struct.pack(">H", len(k)) + k + struct.pack(">Q", ts)
    return b"".join(struct.pack(">Q", off) + side(*lo) + side(*hi) for off, lo, hi in metas)


def meta_rows(data: bytes) -> list[tuple[int, tuple[bytes, int], tuple[bytes, int]]]:
    out, at = [], 0
    while at < len(data):
        (off,), at, sides = struct.unpack(">Q", _take(data, at, 8)), at + 8, []
        for _ in range(2):
            (k,) = struct.unpack(">H", _take(data, at, 2))
            sides.append((_take(data, at + 2, k), struct.unpack(">Q", _take(data, at + 2 + k, 8))[0]))
            at += 10 + k
        out.append((off, *sides))
    return out


def sorted_file_rows(data: bytes) -> list[tuple[bytes, int, bytes]]:
    """Rows of a sorted file: blocks, block metadata, its offset u64, newest timestamp u64, filter, number of hashes u8,
    filter offset u32. The filter begins where its offset says; the 16 bytes before it are the two numbers."""
    (bloom,) = struct.unpack(">I", _take(data, len(data) - 4, 4))
    meta, _ = struct.unpack(">QQ", _take(data, bloom - 16, 16))
    metas = meta_rows(data[meta : bloom - 16])
    bounds = [*(m[0] for m in metas), meta]
    return [row for a, b in zip(bounds[:-1], bounds[1:], strict=True) for row in block_rows(data[a:b])]


def sorted_file_bytes(blocks: list[list[tuple[bytes, int, bytes]]], filter_data: bytes) -> bytes:
    """filter_data: the filter's bytes with the byte for the number of hashes."""
    body, metas = b"", []
    for rows in blocks:
        metas.append((len(body), rows[0][:2], rows[-1][:2]))
        body += block_bytes(rows)
    newest = max(ts for rows in blocks for _, ts, _ in rows)
    body, at = body + meta_bytes(metas), len(body)
    body += struct.pack(">QQ", at, newest)
    return body + filter_data + struct.pack(">I", len(body))


def locate(metas: list[tuple[int, tuple[bytes, int], tuple[bytes, int]]], key: bytes) -> int:
    """The block that may hold a key: the last whose first key isn't above it, else the first."""
    return max(0, sum(m[1][0] <= key for m in metas) - 1)


def _reader(decode):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                rows = list(decode(bytes(content)))
                yield pd.DataFrame({"path": path, "key": [r[0] for r in rows], "commit_ts": [r[1] for r in rows], "value": [r[2] for r in rows]})

    return run


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Versions in write-ahead log files; a torn tail is left out."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_reader(log_records), ROWS)


def read_sorted_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return unpacked(spark.read.format("binaryFile").load(path))


def unpacked(files: DataFrame) -> DataFrame:
    """Versions in sorted files (path, content)."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_reader(sorted_file_rows), ROWS)


def sorted_file(rows: list[tuple[bytes, int, bytes]], block_bytes: int, false_positives: float = 0.01) -> bytes:
    """A sorted file of rows in order: a block takes rows up to its size, and all versions of its last key."""
    blocks: list[list[tuple[bytes, int, bytes]]] = []
    size = 0
    for row in rows:
        n = 14 + len(row[0]) + len(row[2])
        if not blocks or size + n > block_bytes and blocks[-1][-1][0] != row[0]:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += n
    bits = bloom.bits_per_key(len(rows), false_positives)
    return sorted_file_bytes(blocks, bloom.filter_bytes({hash32_of(k) for k, _, _ in rows}, bits))


def packed(rows: DataFrame, file: str, *, block_bytes: int = 8192) -> DataFrame:
    """path, content: a sorted file of the rows (key, commit_ts, value) of each value of a column. A file is held whole in a
    task, so files must be small (16 MiB, say)."""
    ship(rows.sparkSession)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=-group["commit_ts"]).sort_values(["key", "order"])
        entries = [(bytes(k), int(t), bytes(v)) for k, t, v in zip(group["key"], group["commit_ts"], group["value"], strict=True)]
        return pd.DataFrame({"path": [str(group[file].iloc[0])], "content": [sorted_file(entries, block_bytes)]})

    return rows.select(file, "key", "commit_ts", "value").groupBy(file).applyInPandas(one, "path string, content binary")
