"""Packing: length buckets of least padding from the global histogram, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import materialize


def optimal_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bins of at most `buckets` buckets over a histogram, with the least sum of (count * upper bin).

    counts[i] is how many have length bin i + 1. best[k][j]: the least cost of bins 1..j in k buckets.
    """
    m = len(counts)
    below = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = np.full((buckets + 1, m + 1), np.inf)
    best[0, 0] = 0
    cut = np.zeros((buckets + 1, m + 1), np.int64)
    for k in range(1, buckets + 1):
        for j in range(1, m + 1):
            cost = best[k - 1, :j] + (below[j] - below[:j]) * j
            cut[k, j] = cost.argmin()
            best[k, j] = cost[cut[k, j]]
    k, j, out = int(best[1:, m].argmin()) + 1, m, []
    while k > 0:
        if below[j] > below[cut[k, j]]:
            out.append(j)
        j, k = int(cut[k, j]), k - 1
    return out[::-1]


def token_length(text: str = "text"):
    """Runs of letters and digits, and single other characters: a native stand-in for a tokenizer's count.

    Give `pack` another column as `length`, such as the n_tokens of `count_tokens`, to pack by real ids.
    """
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length=None, buckets: int = 8, step: int = 1, longest: int = 4096, budget: int = 32_768) -> DataFrame:
    """Place every document in batches whose padded size stays within a token budget.

    Documents longer than `longest` tokens are cut into segments, none is dropped; a null or empty text is one segment of
    0 tokens. Bucket bounds (multiples of `step`) are chosen by dynamic programming over the histogram of all segments
    (at most longest/step bins come to the driver). Segments are sorted by bucket and a hash; a segment's number within
    its bucket, counted over the sorted partitions, gives its batch, so only each bucket's last batch may be part full.
    Repeated rows are packed each. Returns key, segment, n_tokens, bucket_len, batch_id, place.
    """
    n = F.coalesce(length if length is not None else token_length(text), F.lit(0)).cast("long")
    one = docs.select(F.col(key).alias("key"), n.alias("n"))
    cuts = one.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / longest), F.lit(0)))).alias("segment"))
    cuts = materialize(cuts.select("key", "segment", F.least(F.col("n") - F.col("segment") * longest, F.lit(longest)).alias("n_tokens")))
    bin_of = F.greatest(F.ceil(F.col("n_tokens") / step), F.lit(1)).cast("int")
    histogram = np.zeros(-(-longest // step), np.int64)
    for row in cuts.groupBy(bin_of.alias("bin")).count().collect():
        histogram[row["bin"] - 1] = row["count"]
    bounds = [b * step for b in optimal_bounds(histogram, buckets)] or [longest]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    placed = cuts.withColumn("bucket_len", bucket).withColumn("h", F.xxhash64("key", "segment", "n_tokens"))
    placed = placed.repartitionByRange("bucket_len", "h", "key").sortWithinPartitions("bucket_len", "h", "key", "segment")
    # the id's upper bits are the partition, the lower ones the row in it; written, so that a lost task can't change them
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()))
    first = placed.groupBy(F.shiftright("at", 33).cast("int").alias("part"), "bucket_len").agg(F.min("at").alias("start"), F.count("*").alias("rows")).collect()
    before: dict = {}
    offsets = []
    for row in sorted(first, key=lambda r: (r["bucket_len"], r["part"])):
        offsets.append((row["part"], row["bucket_len"], before.get(row["bucket_len"], 0) - row["start"]))
        before[row["bucket_len"]] = before.get(row["bucket_len"], 0) + row["rows"]
    shift = docs.sparkSession.createDataFrame(offsets, "part int, bucket_len int, shift long")  # a row for each partition and bucket at most one more
    rows_a_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    out = placed.withColumn("part", F.shiftright("at", 33).cast("int")).join(F.broadcast(shift), ["part", "bucket_len"])
    out = out.withColumn("number", F.col("at") + F.col("shift"))
    return out.select(
        F.col("key").alias(key), "segment", "n_tokens", F.col("bucket_len").cast("long").alias("bucket_len"),
        F.concat_ws("-", F.col("bucket_len"), F.floor(F.col("number") / rows_a_batch)).alias("batch_id"),
        F.pmod(F.col("number"), rows_a_batch).cast("long").alias("place"),
    )
