"""Byte strings: order, common prefixes, and the binary layouts of log records and blocks, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """How many first bytes two byte strings share."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), same))).otherwise(F.lit(0))


def compare(ka: Column, ta: Column, kb: Column, tb: Column) -> Column:
    """-1, 0 or 1: keys by bytes ascending, then timestamps descending."""
    return F.when(ka < kb, -1).when(ka > kb, 1).when(ta > tb, -1).when(ta < tb, 1).otherwise(0)


def u16(n: Column) -> Column:
    return F.to_binary(F.lpad(F.hex(n), 4, "0"), F.lit("hex"))


def u64(n: Column) -> Column:
    return F.to_binary(F.lpad(F.hex(n), 16, "0"), F.lit("hex"))


def log_record(key: Column, ts: Column, value: Column) -> Column:
    """Key length u16, key, timestamp u64, value length u16, value."""
    return F.concat(u16(F.octet_length(key)), key, u64(ts), u16(F.octet_length(value)), value)


def block_entry(first: Column, key: Column, ts: Column, value: Column) -> Column:
    """Bytes shared with the block's first key u16, number of the rest u16, the rest, timestamp, value length, value."""
    shared = common_prefix(first, key)
    rest = F.substring(key, shared + 1, F.octet_length(key))
    return F.concat(u16(shared), u16(F.octet_length(rest)), rest, u64(ts), u16(F.octet_length(value)), value)


def block(entries: Column) -> Column:
    """Entries, the offset of each as u16, and their number as u16. entries: array of entry bytes."""
    none = F.to_binary(F.lit(""), F.lit("hex"))
    body = F.aggregate(entries, none, lambda a, e: F.concat(a, e))
    offsets = F.transform(entries, lambda e, i: F.aggregate(F.slice(entries, F.lit(1), i), F.lit(0), lambda a, x: a + F.octet_length(x)))
    return F.concat(body, F.aggregate(offsets, none, lambda a, o: F.concat(a, u16(o))), u16(F.size(entries)))
