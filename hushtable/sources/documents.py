"""Small public documents, written and read by Spark so that any store will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hushtable.operators.stage import Release


def write_release(spark: SparkSession, release: Release, path: str) -> None:
    """One JSON line; an existing path is an error."""
    spark.createDataFrame([(release.to_json(),)], "value string").coalesce(1).write.text(path)


def read_release(spark: SparkSession, path: str) -> Release:
    found = spark.read.text(path).head(2)
    if len(found) != 1:
        raise ValueError(f"not one release in {path}")
    return Release.from_json(found[0][0])
