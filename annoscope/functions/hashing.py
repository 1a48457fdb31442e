"""Deterministic hashing shared with the DuckDB oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _concat(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return F.concat(*[c.cast("string") for c in cols])


def u01(*parts) -> Column:
    """Uniform [0,1) number from the md5 of the concatenated parts.

    A ``str`` part is a column name; wrap literal text in ``F.lit``.

    Equal to DuckDB's ``('0x'||substr(md5(x),1,8))::BIGINT / 4294967296.0``.
    """
    h = F.conv(F.substring(F.md5(_concat(*parts)), 1, 8), 16, 10).cast("bigint").cast("double")
    return h / F.lit(4294967296.0).cast("double")


def u01_below(limit: float, *parts) -> Column:
    """``u01(*parts) < limit`` for 0 < limit < 1, told by the first hex digits of the hash: nothing is converted to a number."""
    return F.md5(_concat(*parts)) < F.lit(f"{math.ceil(limit * 2**32):08x}")


def stable_rank_key(*parts) -> Column:
    """Order key for reproducible shuffles: md5 of the concatenated parts (hex string)."""
    return F.md5(_concat(*parts))
