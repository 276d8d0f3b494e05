"""What driver and executors share: the checkpoint folder, and where this package is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_shared(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir where the cluster names it; a local master gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plumbline-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_path(spark: SparkSession) -> str:
    """The shared folder's path."""
    ensure_shared(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder, for several readers that each need some of its columns."""
    spark = df.sparkSession
    path = f"{shared_path(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
