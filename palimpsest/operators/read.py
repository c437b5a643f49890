"""Reads as of a timestamp. Visibility is applied before the newest version of a key is taken, tombstones go after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import is_tombstone


def within(low=None, high=None, key: str = "k") -> Column:
    """Both ends included; None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(key) >= F.lit(low))
    if high is not None:
        out = out & (F.col(key) <= F.lit(high))
    return out


def newest(log: DataFrame, read_ts: int | None = None, low=None, high=None) -> DataFrame:
    """Each key's newest visible version, tombstones included. Filters reach the scan; the window keeps one row a key
    before and after the shuffle."""
    seen = log.where(within(low, high))
    if read_ts is not None:
        seen = seen.where(F.col("cts") <= read_ts)
    order = Window.partitionBy("k").orderBy(F.desc("cts"))
    return seen.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def snapshot(log: DataFrame, read_ts: int | None = None, low=None, high=None) -> DataFrame:
    """Live keys and their values."""
    return newest(log, read_ts, low, high).where(~is_tombstone("v"))


def get(log: DataFrame, key, read_ts: int | None = None) -> DataFrame:
    """At most one row: the newest visible version, unless it is a tombstone. No shuffle of the log: each task keeps one row."""
    seen = log.where(F.col("k") == F.lit(key))
    if read_ts is not None:
        seen = seen.where(F.col("cts") <= read_ts)
    return seen.orderBy(F.desc("cts")).limit(1).where(~is_tombstone("v"))


def multi_get(log: DataFrame, probes: DataFrame, read_ts: int | None = None) -> DataFrame:
    """k, v for every distinct probe; v is null where the key doesn't exist. Only probed keys' versions are shuffled where
    the probes are small enough for the planner to send them to the log."""
    keys = probes.select("k").distinct()
    found = snapshot(log.join(keys, "k", "left_semi"), read_ts).select("k", "v")
    return keys.join(found, "k", "left")


def count(log: DataFrame, low=None, high=None, read_ts: int | None = None) -> DataFrame:
    return snapshot(log, read_ts, low, high).agg(F.count("*").alias("n"))


def history(log: DataFrame) -> DataFrame:
    """All versions, with their rank from the newest."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cts"))).cast("long"))


def deleted(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Keys whose newest visible version is a tombstone, and when they were deleted."""
    return newest(log, read_ts).where(is_tombstone("v")).select("k", "cts")


def difference(log: DataFrame, before_ts: int, after_ts: int) -> DataFrame:
    """k, before, after, change for keys that differ between two snapshots, in one pass over the log."""
    at = lambda ts: F.max(F.when(F.col("cts") <= ts, F.struct("cts", "v")))
    both = log.where(F.col("cts") <= max(before_ts, after_ts)).groupBy("k").agg(at(before_ts).alias("x"), at(after_ts).alias("y"))
    live = lambda s: F.when(F.octet_length(f"{s}.v") > 0, F.col(f"{s}.v"))
    rows = both.select("k", live("x").alias("before"), live("y").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return rows.withColumn("change", change)
