"""Tables written between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quern-scratch"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what its rows say of each other stays true, and lost executors cost no recomputation."""
    path = f"{folder(df.sparkSession)}/quern-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
