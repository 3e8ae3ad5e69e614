"""Tables that operators write and read again, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, or, where that is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/ledger-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str | None = None, partition: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return the table read back; a lost executor then costs its tasks only."""
    spark = df.sparkSession
    path = path or scratch_folder(spark)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
