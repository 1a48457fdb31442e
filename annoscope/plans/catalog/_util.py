"""Small helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both engines round before the value comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
