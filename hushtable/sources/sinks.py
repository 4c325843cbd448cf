"""Where results go: tables as CSV or Parquet, small public documents as one line of JSON, records in several forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a record may hold; records are for reports.
RECORD_ROWS = 10_000
#: Columns that say where a row came from and aren't part of a synthetic table.
PROVENANCE = ("_cohort", "_cell", "key", "call", "row")


def without_provenance(df: DataFrame) -> DataFrame:
    return df.drop(*PROVENANCE)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, or CSV with a header where the path ends in .csv (a folder of part files); an existing path is an error."""
    if path.rstrip("/").endswith(".csv"):
        df.write.option("header", True).csv(path)
    else:
        df.write.parquet(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document, default=str),)], "value string").coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    found = spark.read.text(path).head(2)
    if len(found) != 1:
        raise ValueError(f"not one document in {path}")
    return json.loads(found[0][0])


def write_record(spark: SparkSession, values: dict, tables: dict[str, DataFrame], path: str, all_forms: bool = False) -> None:
    """Named values and small tables: one JSON document, and with `all_forms` a CSV of each table and a Markdown text too.

    A table of more than RECORD_ROWS rows is refused: it belongs in `write_table`.
    """
    held = {}
    for name, df in tables.items():
        rows = df.limit(RECORD_ROWS + 1).collect()
        if len(rows) > RECORD_ROWS:
            raise ValueError(f"{name} has more than {RECORD_ROWS} rows")
        held[name] = (df.columns, [list(r) for r in rows])
    write_document(spark, {"values": values, "tables": {name: {"columns": c, "rows": r} for name, (c, r) in held.items()}}, f"{path}/json")
    if all_forms:
        for name, df in tables.items():
            df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).coalesce(1).write.option("header", True).csv(f"{path}/{name}.csv")
        spark.createDataFrame([(markdown(values, held),)], "value string").coalesce(1).write.text(f"{path}/markdown")


def markdown(values: dict, tables: dict) -> str:
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    out = [f"- {cell(k)}: {cell(v)}" for k, v in values.items()]
    for name, (columns, rows) in tables.items():
        out += ["", f"**{name}**", "", *("| " + " | ".join(map(cell, r)) + " |" for r in (columns, ["-"] * len(columns), *rows))]
    return "\n".join(out)
