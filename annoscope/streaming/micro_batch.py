"""Per-document scorers on a stream via ``foreachBatch``.

Every document's tokens arrive with the document row, so a per-document score needs no state
across micro-batches: each micro-batch is scored with the ordinary batch operator (broadcast or
AQE-sized joins, one aggregation by id) and appended to a sink. The sink write is keyed by the
batch id (``replaceWhere`` on a ``batch_id`` partition), so a micro-batch replayed after a failure
overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of input a core gets in one micro-batch, at least.
CORE_BYTES = 256 << 20


def batch_bytes(spark: SparkSession, table_bytes: int = 0) -> int:
    """Size of a micro-batch (option ``maxBytesPerTrigger``) that keeps every core busy and is at least twice a table that each
    micro-batch joins: however long the stream, the table is read for half as many bytes as the input at most."""
    return max(spark.sparkContext.defaultParallelism * CORE_BYTES, 2 * table_bytes)


def score_stream(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                 available_now: bool = True, trigger_interval: str | None = None):
    """Start a streaming query that applies ``score_batch`` to each micro-batch and writes the
    scores (plus ``batch_id``) as Parquet under ``path``. Returns the ``StreamingQuery``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        out = score_batch(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_interval:
        w = w.trigger(processingTime=trigger_interval)
    return w.start()
