"""Compaction: which versions and which files survive, and which level is compacted next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import is_tombstone
from palimpsest.operators import ranges

MIB = 1 << 20


def collect_garbage(log: DataFrame, watermark: int, bottom: bool) -> DataFrame:
    """All versions above the watermark and the newest at or below it; at the bottom level that one goes if it is a
    tombstone, and what it hid stays gone."""
    old = F.col("cts") <= watermark
    order = Window.partitionBy("k", old).orderBy(F.desc("cts"))
    keep = ~old | (F.col("rn") == 1) & (~is_tombstone("v") if bottom else F.lit(True))
    return log.withColumn("rn", F.row_number().over(order)).where(keep).drop("rn")


def files_of(rows: DataFrame, file: Column) -> DataFrame:
    """Metadata of files: first and last entry in (key, newest first) order, entries, bytes, newest timestamp. rows: k, cts, v."""
    size = F.lit(16).cast("long") + F.octet_length("v")
    return rows.groupBy(file.alias("sst_id")).agg(
        F.min(F.struct("k", (-F.col("cts")).alias("t"))).alias("lo"), F.max(F.struct("k", (-F.col("cts")).alias("t"))).alias("hi"),
        F.count("*").alias("n_entries"), F.sum(size).alias("size_bytes"), F.max("cts").alias("max_ts"),
    ).select("sst_id", F.col("lo.k").alias("first_key"), (-F.col("lo.t")).alias("first_ts"), F.col("hi.k").alias("last_key"), (-F.col("hi.t")).alias("last_ts"), "n_entries", "size_bytes", "max_ts")


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(upper_id, lower_id) of files whose key ranges meet, ends included. Of two ranges that meet one begins within the
    other, so two joins of points with ranges find every pair once."""
    u = upper.select(F.col("sst_id").alias("upper_id"), F.col("first_key").alias("u_lo"), F.col("last_key").alias("u_hi"))
    l = lower.select(F.col("sst_id").alias("lower_id"), F.col("first_key").alias("l_lo"), F.col("last_key").alias("l_hi"))  # noqa: E741
    first = ranges.points_in(u, l, "u_lo", "u_hi", "l_lo").select("upper_id", "lower_id")
    inside = l.where("l_lo < l_hi").withColumn("l_lo", F.col("l_lo") + 1)  # the other way round, without equal beginnings
    return first.unionByName(ranges.points_in(inside, u, "l_lo", "l_hi", "u_lo").select("upper_id", "lower_id"))


def touching(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files that may hold keys of a range, ends included."""
    out = files
    if low is not None:
        out = out.where(F.col("last_key") >= F.lit(low))
    if high is not None:
        out = out.where(F.col("first_key") <= F.lit(high))
    return out


def level_targets(bottoms: DataFrame, *, levels: int = 6, base: int = 64 * MIB, multiplier: int = 2) -> DataFrame:
    """state, level, target for every row (state, bottom_bytes): the bottom level's target is its size or base, each level
    above has a part of the next one's while that is above base, else 0."""
    start = F.array(F.greatest(F.col("bottom_bytes"), F.lit(base).cast("long")))
    up = F.aggregate(F.sequence(F.lit(2), F.lit(levels)), start, lambda a, i: F.concat(F.array(F.when(F.get(a, F.lit(0)) > base, F.floor(F.get(a, F.lit(0)) / multiplier)).otherwise(F.lit(0)).cast("long")), a))
    return bottoms.select("state", F.posexplode(up).alias("p", "target")).select("state", (F.col("p") + 1).cast("long").alias("level"), "target")


def leveled_choice(sizes: list[int], l0_files: int, *, trigger: int = 3, base: int = 64 * MIB, multiplier: int = 2) -> dict | None:
    """The next task of leveled compaction by the sizes of levels 1, 2, ... and the number of files at level 0: which level
    goes down into which. A few numbers, decided on the driver."""
    targets = [0] * len(sizes)
    targets[-1] = max(sizes[-1], base)
    for i in range(len(sizes) - 2, -1, -1):
        targets[i] = targets[i + 1] // multiplier if targets[i + 1] > base else 0
    into = next(i for i, t in enumerate(targets) if t > 0) + 1
    if l0_files >= trigger:
        return {"upper": 0, "lower": into, "bottom": into == len(sizes), "targets": targets}
    ratios = {i + 1: s / t if t else float("inf") for i, (s, t) in enumerate(zip(sizes[:-1], targets[:-1], strict=True)) if s}
    over = {i: r for i, r in ratios.items() if r > 1}
    if not over:
        return None
    upper = max(over, key=lambda i: (over[i], -i))
    return {"upper": upper, "lower": upper + 1, "bottom": upper + 1 == len(sizes), "targets": targets}


def simple_task(files: list[int], *, trigger: int = 3, ratio_percent: int = 200) -> dict | None:
    """As simple_choice, for the numbers of files of one store's levels, on the driver: a whole level goes into the next."""
    for upper, (n, below) in enumerate(zip(files[:-1], files[1:], strict=True)):
        if n and (upper or n >= trigger) and below * 100 < n * ratio_percent:
            return {"upper": upper, "lower": upper + 1}
    return None


def simple_choice(counts: DataFrame, *, trigger: int = 3, ratio_percent: int = 200) -> DataFrame:
    """state, upper, lower: the first level whose next one has too few files beside it. counts: state, level, files."""
    by = Window.partitionBy("state").orderBy("level")
    pairs = counts.withColumn("next", F.lead("files").over(by)).where("next is not null and files > 0")
    due = pairs.where((F.col("next") * 100 < F.col("files") * ratio_percent) & ((F.col("level") > 0) | (F.col("files") >= trigger)))
    return due.groupBy("state").agg(F.min("level").alias("upper")).withColumn("lower", F.col("upper") + 1)


def replay(records: DataFrame) -> DataFrame:
    """Live files of a manifest. records: seq, type (add or remove), sst_id; the last record of a file counts."""
    return records.groupBy("sst_id").agg(F.max(F.struct("seq", "type")).alias("last")).where("last.type = 'add'").select("sst_id", F.col("last.seq").alias("seq"))
