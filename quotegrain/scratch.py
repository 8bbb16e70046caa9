"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared checkpoint folder. Where none is set: below the warehouse on a cluster, in a
    temporary folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and spark.conf.get("spark.master", "").startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a written table: what is used several times is computed once, and lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
