"""Written intermediate tables: a lineage cut that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where driver and tasks share it."""
    root = spark.conf.get(SETTING, None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sensorweave-stage-")
        spark.conf.set(SETTING, root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet and read it back (runs a job).

    Later readers scan only the columns they need, and Spark knows the size of a staged table, so it
    can choose a broadcast join for a small one.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again; other tables stay."""
    path = getattr(df, "_staged_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
