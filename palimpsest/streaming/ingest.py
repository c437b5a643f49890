"""Streams of writes into a store, and the newest live value of each key as a stream's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.store import Store


def into_store(rows: DataFrame, store: Store, checkpoint: str, *, compact: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch of (key, value[, pos]) is one atomic commit; compaction runs after it while it is due. The commit
    itself names the stream (by its checkpoint) and the batch's number, so a batch that is run again after a failure, wherever
    that was, isn't written twice."""

    def batch(df: DataFrame, number: int) -> None:
        store.refresh()
        if store.state["streams"].get(checkpoint, -1) >= number:
            return
        df = df.persist()
        if not df.isEmpty():
            store.write(df, stream=(checkpoint, number))
            while compact and store.compact():
                pass
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(rows: DataFrame) -> DataFrame:
    """A streaming aggregate: k, v of the newest version of every key, tombstones left out. rows: k, cts, v; update or
    complete output mode."""
    return rows.groupBy("k").agg(F.max(F.struct("cts", "v")).alias("s")).where(F.octet_length("s.v") > 0).select("k", F.col("s.cts").alias("cts"), F.col("s.v").alias("v"))
