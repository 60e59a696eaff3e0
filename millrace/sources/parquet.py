"""Tables as Parquet folders or files, one a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(column: str):
    """A price or amount as exact decimal, for sums that do not depend on order."""
    return F.col(column).cast("decimal(18,2)")
