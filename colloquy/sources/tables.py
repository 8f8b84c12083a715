"""Parquet tables addressed by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` below ``directory``; a file or a folder of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
