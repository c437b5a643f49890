"""Clock, batches, reader watermark and optimistic validation of transactions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.folders import shared_dir
from palimpsest.operators import graph, ranges
from palimpsest.shipping import ship


def running(rows: DataFrame, order: str, value: str, name: str, *, width: int = 1 << 16) -> DataFrame:
    """The sum of value over all rows before each, by a dense integer order: within blocks of so many, then over the blocks'
    totals, so no task sees more than a block or the list of blocks."""
    blocks = rows.withColumn("block", F.floor(F.col(order) / width))
    base = blocks.groupBy("block").agg(F.sum(value).alias("total"))
    base = base.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
    inside = F.sum(value).over(Window.partitionBy("block").orderBy(order)) - F.col(value)
    return blocks.withColumn("inside", inside).join(base, "block").withColumn(name, F.col("base") + F.col("inside")).drop("block", "base", "inside")


def clock(calls: DataFrame, order: str, start: int = 0) -> DataFrame:
    """read_ts and commit_ts of calls that commit by themselves: the i-th ticks the clock twice."""
    ranked = running(calls.withColumn("one", F.lit(1).cast("long")), order, "one", "i").drop("one")
    return ranked.withColumn("read_ts", start + 2 * F.col("i") + 1).withColumn("commit_ts", start + 2 * F.col("i") + 2).drop("i")


def last_in_batch(rows: DataFrame, batch: str, key: str, position: str) -> DataFrame:
    """Of a batch's writes to a key the last."""
    order = Window.partitionBy(batch, key).orderBy(F.desc(position))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def watermarks(readers: DataFrame, moments: DataFrame) -> DataFrame:
    """For each moment ts the oldest read_ts of the readers open then (read_ts <= ts < closed_ts), ts itself if none is.

    A reader is cut into the nodes of its span, and each node keeps its oldest reader alone, so neither the length of a span
    nor the number of readers open at once makes rows."""
    pieces = ranges.cut(readers.withColumn("last", F.col("closed_ts") - 1), "read_ts", "last")
    oldest = pieces.groupBy("level", "n").agg(F.min("read_ts").alias("oldest"))
    at = moments.select("ts").distinct()
    open_then = ranges.spread(at, "ts", ranges.levels_of(oldest)).join(oldest, ["level", "n"]).groupBy("ts").agg(F.min("oldest").alias("oldest"))
    return at.join(open_then, "ts", "left").select("ts", F.coalesce("oldest", "ts").alias("watermark"))


def watermark(readers: DataFrame, clock_ts: int) -> DataFrame:
    """One row: the oldest active read_ts, or the clock. readers: read_ts, n (times registered less times released)."""
    return readers.groupBy("read_ts").agg(F.sum("n").alias("n")).where("n > 0").agg(F.coalesce(F.min("read_ts"), F.lit(clock_ts)).alias("watermark"))


def prune(committed: DataFrame, oldest: int) -> DataFrame:
    """Committed transactions that may still matter to a reader."""
    return committed.where(F.col("commit_ts") >= oldest)


def conflicts(txns: DataFrame) -> DataFrame:
    """(txn, blocker): transactions that wrote, and ones that committed after it began and before it did and wrote what it read.

    txns: txn, read_ts, commit_ts, read_set, write_set (arrays). Sets meet in an equi-join on the key and a node of the
    clock, so a hot key isn't joined with its whole past, however long a transaction was open."""
    reads = txns.where("size(write_set) > 0").select("txn", (F.col("read_ts") + 1).alias("after"), (F.col("commit_ts") - 1).alias("before"), F.explode(F.array_distinct("read_set")).alias("key"))
    writes = txns.select(F.col("txn").alias("blocker"), F.col("commit_ts").alias("ts"), F.explode(F.array_distinct("write_set")).alias("key"))
    return ranges.points_in(reads, writes, "after", "before", "ts", on=("key",)).where("txn <> blocker").select("txn", "blocker").distinct()


def _outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    component, aborted = None, set()
    for rows in batches:
        out = []
        for mine, txn, by in zip(rows["component"], rows["txn"], rows["blocker"], strict=True):
            if mine != component:
                component, aborted = mine, set()
            stopped = any(b not in aborted for b in by)
            if stopped:
                aborted.add(txn)
            out.append(stopped)
        yield pd.DataFrame({"txn": rows["txn"], "aborted": out})


def outcomes(txns: DataFrame) -> DataFrame:
    """txn, committed as commits in order of commit_ts decide: an aborted transaction's writes stop nobody. Decisions depend
    on each other in order, but only along conflicts: each connected component of them passes in order through one task, and
    transactions without conflicts through none."""
    spark = txns.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    pairs = graph.written(conflicts(txns), folder, "pairs")
    of = graph.components(pairs.select(F.col("txn").alias("a"), F.col("blocker").alias("b")), folder)
    waiting = pairs.groupBy("txn").agg(F.collect_list("blocker").alias("blocker")).join(txns.select("txn", "commit_ts"), "txn").join(of.withColumnRenamed("node", "txn"), "txn")
    stopped = waiting.repartition("component").sortWithinPartitions("component", "commit_ts").select("component", "txn", "blocker").mapInPandas(_outcomes, "txn long, aborted boolean")
    return txns.select("txn").join(stopped, "txn", "left").select("txn", F.coalesce(~F.col("aborted"), F.lit(True)).alias("committed"))
