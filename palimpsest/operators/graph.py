"""Connected components, and the tables written between the steps of such a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes written tables."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(hadoop).delete(path, True)


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component), a written table: the smallest node that a node reaches over undirected edges (a, b). Nodes without
    edges are absent.

    Alternates the two star operations of Kiveris et al. (2014) until the edges stay: every step is an aggregation by
    node and a join, and the edges are written between steps. Nulls and loops are ignored."""
    spark = edges.sparkSession
    now = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        folder, f"{name}_0",
    )
    step, before = 0, None
    while True:
        # large star: each larger neighbour is tied to the smallest one
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours are tied to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        after = written(small, folder, f"{name}_{step}")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        forget(spark, folder, f"{name}_{step - 1}")
        if sums == before:
            break
        now, before = after, sums
    heads = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = written(after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads), folder, name)
    forget(spark, folder, f"{name}_{step}")
    return out
