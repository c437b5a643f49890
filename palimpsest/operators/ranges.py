"""Joins of points with ranges of whole numbers by a segment tree, whose cost follows the rows and the result, not the spans.

A node (level, n) stands for the numbers from n * 2**level on, 2**level of them. A range is cut into the few nodes that
exactly make it up (two a level at most); a point lies in one node a level. So points and ranges meet in an equi-join on nodes,
every pair once, and a range over 2**40 numbers has some 80 nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 63


def nodes(low: Column, high: Column) -> Column:
    """An array of structs level, n: the nodes that make up low..high, both included; empty where low > high or one is null."""

    def bounds(level: Column) -> tuple[Column, Column]:
        """The first node that begins in the range, and the last that ends in it."""
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
        top = F.call_function("shiftright", high, level)
        return F.call_function("shiftright", low, level) + F.when(low.bitwiseAND(mask) != 0, 1).otherwise(0), F.when(high.bitwiseAND(mask) == mask, top).otherwise(top - 1)

    def at(level: Column) -> Column:
        first, last = bounds(level)
        odd, even = first.bitwiseAND(F.lit(1).cast("long")) == 1, last.bitwiseAND(F.lit(1).cast("long")) == 0
        node = lambda take, n: F.when((first <= last) & take, F.struct(level.alias("level"), n.alias("n")))
        return F.array(node(odd, first), node(even, last))

    top = F.lit(LEVELS - 1)
    first, last = bounds(top)
    rest = F.when(first <= last, F.transform(F.sequence(first, last), lambda n: F.struct(top.alias("level"), n.alias("n"))))  # four at most
    span = F.greatest(high.cast("double") - low.cast("double") + 1, F.lit(1.0))
    below = F.least(F.ceil(F.log2(span)).cast("int") + 1, top - 1)  # a range has no node that is larger than it
    each = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), below), at)), F.coalesce(rest, F.array().cast("array<struct<level:int,n:bigint>>")))
    return F.when(low <= high, F.filter(each, lambda x: x.isNotNull()))


def node_of(point: Column, level: Column) -> Column:
    return F.call_function("shiftright", point, level)


def levels_of(cut: DataFrame) -> list[int]:
    """The levels of nodes that there are: 63 at most."""
    return sorted(r[0] for r in cut.select("level").distinct().collect())


def cut(rows: DataFrame, low: str, high: str) -> DataFrame:
    """The rows once for each of the nodes of their range: level, n."""
    return rows.withColumn("node", F.explode(nodes(F.col(low).cast("long"), F.col(high).cast("long")))).select("*", "node.level", "node.n").drop("node")


def spread(rows: DataFrame, point: str, levels: list[int]) -> DataFrame:
    """The rows once for each level: level, n."""
    each = F.array(*(F.lit(i) for i in levels)).cast("array<int>")
    return rows.withColumn("level", F.explode(each)).withColumn("n", node_of(F.col(point).cast("long"), F.col("level")))


def points_in(spans: DataFrame, points: DataFrame, low: str, high: str, point: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a row of spans and a row of points with low <= point <= high, and equal columns on, once."""
    pieces = cut(spans, low, high)
    return pieces.join(spread(points, point, levels_of(pieces)), [*on, "level", "n"]).drop("level", "n")
