"""Written intermediate results in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only for a local master.

    Executors of a cluster would each write to a folder of their own machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="wordspace-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new folder name under the scratch folder."""
    _made.append(f"{scratch_dir(spark)}/wordspace-{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this process has written to the scratch folder; returns how many folders there were.

    For the end of a job: results that were not written elsewhere can no longer be read.
    """
    removed = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    A written table survives lost executors, cuts the lineage and knows its own size,
    which lets Spark choose join sides by it.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
