"""What the corpus operators share: tables that are written or kept, bounded Arrow batches, joins with ids."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.folders import shared_dir
from palimpsest.operators.graph import components, forget, written
from palimpsest.shipping import ship

__all__ = ["bounded_batches", "by_ids", "chunks", "components", "forget", "free_name", "kept", "release", "shared_dir", "written"]

#: Rows and bytes of a table that one Arrow batch may hold (or one row).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that are worked on at once (or one text): arrays over them take some 50 times as much.
CHUNK_BYTES = 1 << 20
#: Ids that may be broadcast: a few MB.
MOST_SENT = 250_000


def kept(df: DataFrame) -> DataFrame:
    """The rows on the executors' disks, for tables that are read again soon and made from written ones: what an executor
    loses is made again from those. unpersist() frees them."""
    return df.persist(StorageLevel.DISK_ONLY)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so once the driver has dropped their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A name like this that no column has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small enough for an executor's Python, which gets this package."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most so many bytes of the column (or one row), and the column without nulls."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + most, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little


def by_ids(rows: DataFrame, ids: DataFrame, condition, how: str) -> DataFrame:
    """rows joined (left_semi or left_anti) with ids, a written or kept table of one BIGINT. Up to MOST_SENT ids are sent to the
    rows, so texts aren't shuffled for a few of them; beyond, both sides are shuffled."""
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(ids) if few else ids, condition, how)
