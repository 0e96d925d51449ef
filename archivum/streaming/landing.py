"""Landing folders as streams: new files become claims once, late and repeated ones are taken care of (beyond the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivum.operators.claims import CLAIM_KEY, supersede
from archivum.sinks.writers import TableStore


def read_claims(spark: SparkSession, folder: str, schema: str, event_time: str = "observed_at", late: str = "7 days") -> DataFrame:
    """Claims from JSON lines as they land; repeats within the watermark are dropped by key."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(CLAIM_KEY)


def merge_batches(claims: DataFrame, store: TableStore, table: str, checkpoint: str, run_id: Callable[[int], str] = lambda n: f"stream-{n}") -> StreamingQuery:
    """Supersede table claims with each micro-batch; stops when all that has landed is taken in."""

    def merge(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        # A replayed batch meets its own claims and changes nothing.
        old = store.read(table)
        if old is None:
            old = batch.limit(0).withColumn("current", F.lit(True)).withColumn("superseded_by_run_id", F.lit(None).cast("string"))
        store.write(table, supersede(old, batch, run_id(n)))

    return claims.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", key: str = "event_type", event_time: str = "ts") -> DataFrame:
    """Counts per tumbling window; windows close when the watermark passes them."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, every), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
