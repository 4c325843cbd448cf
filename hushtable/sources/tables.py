"""Readers for private tables: Parquet, and CSV in which words such as None stay ordinary text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read a table and keep the asked columns; a missing one is an error."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).option("nullValue", "\u0000").csv(path)
    else:
        df = spark.read.parquet(path)
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*columns) if columns else df
