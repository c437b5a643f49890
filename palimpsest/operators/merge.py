"""Merges of sorted runs as set operations: equal (key, timestamp) pairs come from the source with the lowest number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import is_tombstone


def k_way(sources: list[DataFrame]) -> DataFrame:
    """Every distinct (k, cts) once, from the first source that has it; tombstones and old versions stay."""
    return dedupe(reduce(DataFrame.unionByName, [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)]))


def dedupe(rows: DataFrame) -> DataFrame:
    """As k_way, over rows that name their source in src."""
    first = Window.partitionBy("k", "cts").orderBy("src")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def two_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, and what of b has no equal (k, cts) there."""
    return a.unionByName(b.join(a.select("k", "cts"), ["k", "cts"], "left_anti"))


def check_run(files: DataFrame) -> DataFrame:
    """Files of a sorted run in order of first_key, each with overlaps: does it begin before one before it ends?"""
    before = Window.partitionBy("run").orderBy("first_key", "sst_id").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("overlaps", F.coalesce(F.max("last_key").over(before) >= F.col("first_key"), F.lit(False)))


def concatenate(runs: list[DataFrame], key: str = "k") -> DataFrame:
    """The rows of files that don't overlap, in order."""
    return reduce(DataFrame.unionByName, runs).orderBy(key, F.desc("cts"))


def overlay(local: DataFrame, base: DataFrame) -> DataFrame:
    """A transaction's own writes (k, v; one row a key) over a snapshot (k, v): local ones win, local tombstones hide."""
    both = local.select("k", F.struct(F.lit(1).alias("own"), "v").alias("s")).unionByName(base.select("k", F.struct(F.lit(0).alias("own"), "v").alias("s")))
    return both.groupBy("k").agg(F.max("s").alias("s")).where(~is_tombstone("s.v")).select("k", F.col("s.v").alias("v"), (F.col("s.own") == 1).alias("own"))
