"""Readers for the Parquet tables that stand in for the lead-discovery domain."""

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; only Spark's own reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
