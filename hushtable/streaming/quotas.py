"""What generation has emitted and still owes, kept up as batches of rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators.audit import emitted_counts


def running_counts(rows: DataFrame, schema: Schema, cohorts: list[str], name: str, checkpoint: str) -> DataFrame:
    """Emitted counts of all rows that a stream has brought so far, as the table `name`.

    The counts are Spark's own state, kept in `checkpoint`: a later call with the same one goes on where the last stopped,
    and rows that were counted aren't counted again. The table has a row for each cohort, class and bin, whose number the
    schema bounds.
    """
    out = emitted_counts(rows, schema, cohorts).writeStream.outputMode("complete").format("memory").queryName(name)
    out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.table(name)


def still_owed(counts: DataFrame, owed: DataFrame) -> DataFrame:
    """Quotas (cohort, positive, n) less what was emitted: (cohort, positive, owed), 0 where a quota is met."""
    col = counts.agg(F.min("col")).first()[0]  # every row is counted once in each column
    have = counts.where(F.col("col") == col).groupBy("cohort", "positive").agg(F.sum("n").alias("have"))
    left = F.greatest(F.col("n") - F.coalesce("have", F.lit(0)), F.lit(0))
    return owed.join(have, ["cohort", "positive"], "left").select("cohort", "positive", left.alias("owed"))
