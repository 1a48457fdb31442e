"""Stream-stream interval join of posts and comments (F5 as a stream).

A comment is joined to its post if it is not later than ``window`` after it — the batch rule, which has no
lower bound. Without ``watermark`` and ``lookback`` the result equals the batch join however the
input is cut into micro-batches, and join state is kept. To let Spark drop state, give a
``watermark`` (the input's largest disorder; later rows are dropped) and a ``lookback``
(comments older than that before their post are not joined).
``TIMESTAMP + INTERVAL`` is evaluated in the session time zone (a DST day is 23 or 25 hours);
build the streams from a UTC session for exact windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_comments_stream(posts: DataFrame, comments: DataFrame, window: str = "18 hours",
                             lookback: str | None = None, watermark: str | None = None,
                             labels=("YTA", "NTA", "ESH", "NAH")) -> DataFrame:
    """``posts(id, created)`` ⋈ ``comments(id, parent_id, created, label, ...)`` for streams."""
    p = posts.select(F.col("id").alias("post_id"), F.col("created").alias("post_created"))
    c = comments.where(F.col("label").isin(list(labels)))
    if watermark:
        p, c = p.withWatermark("post_created", watermark), c.withWatermark("created", watermark)
    cond = (F.col("parent_id") == F.col("post_id")) & (F.col("created") <= F.col("post_created") + F.expr(f"INTERVAL {window}"))
    if lookback:
        cond = cond & (F.col("created") >= F.col("post_created") - F.expr(f"INTERVAL {lookback}"))
    return c.join(p, cond, "inner")


def run_to_table(stream_df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Drain all available input (``availableNow``) into a file sink with a checkpoint."""
    q = (stream_df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
