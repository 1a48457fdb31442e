"""Snowflake ids (B18-B20) and dates found in URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Twitter snowflake epoch (ms) and the field widths (bits).
TWITTER_EPOCH_MS = 1288834974657
DATACENTER_BITS = 5
WORKER_BITS = 5
SEQUENCE_BITS = 12

URL_DATE_PATTERN = r"/(\d{4})/(\d{1,2})/(\d{1,2})/"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def snowflake_encode(ts_ms, datacenter, worker, sequence, epoch_ms: int = TWITTER_EPOCH_MS) -> Column:
    """``((ms - epoch) << 22) | (dc << 17) | (worker << 12) | seq`` on LongType."""
    ms = (_c(ts_ms).cast("long") - F.lit(epoch_ms)).cast("long")
    out = F.shiftleft(ms, DATACENTER_BITS + WORKER_BITS + SEQUENCE_BITS)
    out = out.bitwiseOR(F.shiftleft(_c(datacenter).cast("long"), WORKER_BITS + SEQUENCE_BITS))
    out = out.bitwiseOR(F.shiftleft(_c(worker).cast("long"), SEQUENCE_BITS))
    return out.bitwiseOR(_c(sequence).cast("long"))


def snowflake_decode(sid, epoch_ms: int = TWITTER_EPOCH_MS) -> Column:
    """struct(ts_ms, datacenter, worker, sequence) of a snowflake id."""
    s = _c(sid).cast("long")
    return F.struct(
        (F.shiftright(s, DATACENTER_BITS + WORKER_BITS + SEQUENCE_BITS) + F.lit(epoch_ms)).alias("ts_ms"),
        F.shiftright(s, WORKER_BITS + SEQUENCE_BITS).bitwiseAND((1 << DATACENTER_BITS) - 1).alias("datacenter"),
        F.shiftright(s, SEQUENCE_BITS).bitwiseAND((1 << WORKER_BITS) - 1).alias("worker"),
        s.bitwiseAND((1 << SEQUENCE_BITS) - 1).alias("sequence"),
    )


def snowflake_date(sid, epoch_ms: int = TWITTER_EPOCH_MS) -> Column:
    """UTC date of a snowflake id (pure arithmetic, independent of the session time zone;
    the reference uses the machine's zone)."""
    ms = F.shiftright(_c(sid).cast("long"), DATACENTER_BITS + WORKER_BITS + SEQUENCE_BITS) + F.lit(epoch_ms)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))


def epoch_millis(ts) -> Column:
    """Milliseconds since 1970-01-01 of a TIMESTAMP_NTZ column (no time-zone conversion)."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def url_date(url) -> Column:
    """Date from the first ``/yyyy/m/d/`` of a URL; NULL when absent or invalid."""
    u = _c(url)
    y = F.regexp_extract(u, URL_DATE_PATTERN, 1)
    m = F.regexp_extract(u, URL_DATE_PATTERN, 2)
    d = F.regexp_extract(u, URL_DATE_PATTERN, 3)
    return F.when(y != "", F.try_make_timestamp_ntz(y.cast("int"), m.cast("int"), d.cast("int"),
                                                    F.lit(0), F.lit(0), F.lit(0)).cast("date"))
