"""Snapshots between steps, in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(df: DataFrame) -> str:
    got = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakekeel-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder of its own in the shared folder."""
    return f"{shared_folder(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a run's folder, wherever the shared folder lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
