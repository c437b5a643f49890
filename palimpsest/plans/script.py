"""Scripts of commands over keys, replayed as one query: every get is an as-of lookup of the puts before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.mvcc import running


def parse(lines: DataFrame) -> DataFrame:
    """seq, cmd, k, k_end, v, valid from (seq, line). Values may hold spaces; a command with malformed arguments isn't valid,
    an unknown command is."""
    part = F.split(F.trim("line"), " ", 3)
    cmd, number = F.lower(F.get(part, F.lit(0))), lambda i: F.get(part, F.lit(i)).try_cast("long")
    two = cmd.isin("fill", "scan", "test")
    arguments = F.size(part)
    valid = (
        F.when(two, (arguments == 3) & number(1).isNotNull() & number(2).isNotNull())
        .when(cmd.isin("get", "delete"), (arguments == 2) & number(1).isNotNull())
        .when(cmd == "put", (arguments == 3) & number(1).isNotNull())
        .otherwise(F.lit(True))
    )
    value = F.when(cmd == "put", F.get(part, F.lit(2))).when(cmd == "delete", F.lit(""))
    return lines.select("seq", cmd.alias("cmd"), F.when(~two | valid, number(1)).alias("k"), F.when(two, number(2)).alias("k_end"), value.alias("v"), F.coalesce(valid, F.lit(False)).alias("valid"))


def epochs(ops: DataFrame) -> DataFrame:
    """ops with epoch: how many valid ones there were before."""
    return running(ops.withColumn("one", F.col("valid").cast("long")), "seq", "one", "epoch").drop("one")


def gets(ops: DataFrame) -> DataFrame:
    """seq, k, v of every get: the last value put before it, null where there is none or it was deleted. ops: seq, cmd, k, v."""
    before = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    put = F.when(F.col("cmd").isin("put", "delete"), F.col("v"))
    seen = ops.where(F.col("cmd").isin("put", "delete", "get")).withColumn("last", F.last(put, ignorenulls=True).over(before))
    return seen.where("cmd = 'get'").select("seq", "k", F.when(F.octet_length("last") > 0, F.col("last")).alias("v"))
