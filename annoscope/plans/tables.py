"""Driver-table access. Parquet scans keep Catalyst's column pruning and filter pushdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows get per-row work (tokenising, hashing, window joins) right after the scan.
WORKED = frozenset(("documents", "conversations", "lineitem", "orders", "embeddings"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One that is a single split (so at most ``spark.sql.files.maxPartitionBytes``,
    or one row group) is dealt to all cores before the per-row work; a table of more splits is read
    as it is, without a shuffle."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in WORKED and df._jdf.rdd().getNumPartitions() == 1:  # planning only, no job
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
