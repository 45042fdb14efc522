"""Parquet tables with explicit column lists.

``read`` selects exactly the columns asked for, so extra columns with clashing
names in a delivery never reach an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, pruned to ``columns`` (all if none given)."""
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*columns) if columns else df
