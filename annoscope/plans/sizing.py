"""Broadcast only behind a size check.

``maybe_broadcast`` hints a broadcast when the caller gives a proven row bound that fits the session's
``spark.sql.autoBroadcastJoinThreshold``; otherwise Spark plans (and AQE re-plans) the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit_bytes(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; 0 where broadcasts are switched off."""
    raw = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")).strip().lower()
    digits = raw.rstrip("bkmg")
    return max(int(digits) * _UNITS[raw[len(digits):]], 0)


def maybe_broadcast(df: DataFrame, max_rows: int | None, row_bytes: int = 64) -> DataFrame:
    if max_rows is None:
        return df
    return F.broadcast(df) if max_rows * row_bytes <= broadcast_limit_bytes(df) else df


def shared(df: DataFrame) -> DataFrame:
    """An intermediate that several branches of one query read under different projections or filters, written
    once to the shared folder (Spark only reuses *identical* exchanges). Nothing stays cached."""
    from annoscope.session import written

    return written(df, "shared")
