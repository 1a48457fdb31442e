"""Session helpers. Library code never creates a session; callers pass theirs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "annoscope") -> SparkSession:
    """A local session for tests, the bench and the examples."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ANNOSCOPE_DRIVER_MEMORY", "16g"))
    )
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (driver and executors in one process) may go without: it gets a folder of
    its own. On a cluster a missing folder is an error, as a local one would break later reads.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="annoscope-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: several consumers read the
    table instead of recomputing it, and nothing stays cached in executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_group(df: DataFrame, name: str = "per_group") -> DataFrame:
    """A table of one row (or a few) per group, written first: its size is then known when a join with it is
    planned, so Spark broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and the rows it is joined to are
    not shuffled by a key of a few values."""
    return written(df, name)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever the driver was started: a zip of its
    modules goes out with ``addPyFile``, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_annoscope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="annoscope-zip-"), "annoscope_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._annoscope_shipped = True
