"""Tables that pass between jobs: written to the folder all executors share, so that a lost executor costs a job at most."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own on one machine, or one beside the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        alone = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        given = f"file://{tempfile.mkdtemp(prefix='stages-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written there and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
