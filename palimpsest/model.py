"""The data model: versions of keys, their order, and the version logs that the sample tables give.

A version is (key BINARY, commit_ts BIGINT, value BINARY); an empty value is a tombstone. Versions are ordered by key
(unsigned bytes) ascending, then commit_ts descending, so a key's newest version comes first. Analytical tables may hold
keys as BIGINT and values as STRING instead: all operators work on either, by the column names k, cts, v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("commit_ts", T.LongType(), False), T.StructField("value", T.BinaryType(), False)])
TS_MAX = 2**63 - 1
TS_MIN = 0


def is_tombstone(value: Column | str) -> Column:
    return F.octet_length(value) == 0


def encode_u64(number: Column | str) -> Column:
    """Eight bytes, big-endian, so that byte order is number order."""
    return F.to_binary(F.lpad(F.hex(number), 16, "0"), F.lit("hex"))


def decode_u64(key: Column | str) -> Column:
    """The number of an eight-byte key; 0 where there are fewer bytes."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.octet_length(key) < 8, F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("long"))


def encode_versioned(key: Column | str, ts: Column | str) -> Column:
    """Key followed by its timestamp."""
    return F.concat(key, encode_u64(ts))


def decode_versioned(encoded: Column | str) -> tuple[Column, Column]:
    encoded = F.col(encoded) if isinstance(encoded, str) else encoded
    n = F.octet_length(encoded)
    return F.substring(encoded, F.lit(1), n - 8), decode_u64(F.substring(encoded, n - 7, F.lit(8)))


def key_text(key: Column | str, ts: Column | str) -> Column:
    return F.concat_ws("@", F.hex(key), F.col(ts).cast("string") if isinstance(ts, str) else ts.cast("string"))


def value_text(number: Column, epoch: Column | int) -> Column:
    """The value that the generator gives a key."""
    return F.concat(F.lit("value"), number.cast("string"), F.lit("@"), (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"), F.lit("value"))


def fill(spark: SparkSession, begin: int, end: int, epoch: int) -> DataFrame:
    """Keys begin..end, both included."""
    if begin > end:
        raise ValueError(f"fill from {begin} to {end}: the range is empty")
    return spark.range(begin, end + 1).select(F.col("id").alias("k"), value_text(F.col("id"), epoch).alias("v"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = user, cts = event number from 1, v = props, a tombstone for an error event."""
    value = F.when(F.col("event_type") == "error", "").otherwise(F.coalesce("props", F.lit("")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("cts"), value.alias("v"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 1).alias("cts"), value.alias("v"))


def last_ts(log: DataFrame) -> int:
    return log.agg(F.max("cts")).first()[0] or 0
