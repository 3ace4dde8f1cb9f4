"""Folders for tables that a plan writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder name under the shared checkpoint folder of the session.

    Only a local session that names none (tests, a single machine) gets a temporary folder; on a
    cluster, other executors would not see it, so that the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
