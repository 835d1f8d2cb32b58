"""Reading the driver's parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; projection and filters later push into this scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
