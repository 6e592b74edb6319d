"""Readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_EMPTY = ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND")


def read_tree(spark: SparkSession, root: str, partition_columns: set[str]) -> DataFrame:
    """A partitioned parquet folder; ``FileNotFoundError`` when it holds no such table."""
    try:
        table = spark.read.option("basePath", root).parquet(root)
    except AnalysisException as error:
        if error.getCondition() in _EMPTY:
            raise FileNotFoundError(f"no parquet files under {root}") from error
        raise
    if not partition_columns <= set(table.columns):
        raise FileNotFoundError(f"no {sorted(partition_columns)} folders under {root}")
    return table
