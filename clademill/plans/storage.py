"""Paths in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a temporary folder where that is unset on a local master (tests)."""
    app = spark.sparkContext.applicationId
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="clademill-"))
    return f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
