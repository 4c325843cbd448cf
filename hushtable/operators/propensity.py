"""Relabelling that keeps the order in which rows lean to the positive class, where there is such an order."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushtable.functions.bins import number, Schema, text
from hushtable.operators.correct import one_level, with_cell
from hushtable.operators.ranks import ranked, unit_hash
from hushtable.operators.scores import auc

#: Under this area a target is as good as noise given the features, and an order learned from it would be made up.
INFORMATIVE = 0.55
FEWEST = 50


def lean(df: DataFrame, schema: Schema, ids: list[str], folds: int = 3, trees: int = 50, depth: int = 8, seed: int = 0) -> tuple[DataFrame | None, float | None]:
    """`df` with `score`, how much its features lean to the positive class as the table itself tells it, and the mean area
    over folds of a model that hasn't seen them. No table but this one is read.

    None for the scores where they would do harm: under FEWEST rows, one class alone, or a mean area under INFORMATIVE.
    Folds go by a hash of ids. Rows without a declared label are scored too, but nothing is learned from them.
    """
    label = F.when(text(schema.target) == schema.positive, 1.0).when(text(schema.target) == schema.negative, 0.0)
    rows = df.select(label.alias("label")).where("label is not null").agg(F.count("*"), F.count_distinct("label")).first()
    if rows[0] < FEWEST or rows[1] < 2:
        return None, None
    numbers = [F.coalesce(number(c), F.lit(0.0)).alias(f"_f_{c}") for c in schema.numeric]
    texts = [F.coalesce(text(c), F.lit("nan")).alias(f"_t_{c}") for c in schema.categorical]
    fold = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(folds))
    base = df.select("*", label.alias("_label"), fold.alias("_fold"), *numbers, *texts)
    indexed = [f"_f_{c}" for c in schema.categorical]
    if indexed:
        base = StringIndexer(inputCols=[f"_t_{c}" for c in schema.categorical], outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc").fit(base).transform(base)
    base = VectorAssembler(inputCols=[*[f"_f_{c}" for c in schema.numeric], *indexed], outputCol="features").transform(base)
    bins = max(32, max((len(v) + 2 for v in schema.categorical.values()), default=2))
    forest = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed)
    known = base.where("_label is not null").persist()
    areas = []
    for k in range(folds):
        told = forest.fit(known.where(F.col("_fold") != k)).transform(known.where(F.col("_fold") == k))
        area = auc(told, vector_to_array("probability")[1], F.col("_label") == 1).first()["auc"]
        areas += [] if area is None else [area]
    mean = sum(areas) / len(areas) if areas else None
    scored = None
    if mean is not None and mean >= INFORMATIVE:
        scored = forest.fit(known).transform(base).select(*df.columns, vector_to_array("probability")[1].alias("score"))
    known.unpersist()
    return scored, mean


def relabel_in_order(scored: DataFrame, table: DataFrame, schema: Schema, columns: tuple[str, ...], ids: list[str], seed: int = 0) -> DataFrame:
    """In each released cell, exactly rate * n rows get the positive label (a fraction is rounded at random): those with the
    highest scores, ties in random order. Rows of other cells keep their label. `table` has columns cell, rate.

    Scores count to four digits. So a cell has at most 10,001 of them, whose counts say where each begins; rows of one
    score are ranked by parts of a hash, and a hot cell is sorted in no task.
    """
    own = one_level(schema, columns)
    rows = with_cell(scored, own, columns).withColumn("_score", F.round(F.coalesce("score", F.lit(0.0)), 4))
    counts = rows.groupBy("cell", "_score").agg(F.count("*").alias("_n"))
    higher = F.sum("_n").over(Window.partitionBy("cell").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("cell", "_score", F.coalesce(higher, F.lit(0)).alias("_higher"), F.sum("_n").over(Window.partitionBy("cell")).alias("_all"))
    placed = ranked(rows, ["cell", "_score"], ids, seed).join(first, ["cell", "_score"]).join(F.broadcast(table.select("cell", "rate")), "cell", "left")
    exact = F.col("rate") * F.col("_all")
    quota = F.floor(exact) + (unit_hash(F.concat("cell", F.lit(f"|{seed}"))) < exact - F.floor(exact)).cast("long")
    label = F.when(F.col("_higher") + F.col("rank") < quota, F.lit(schema.positive)).otherwise(F.lit(schema.negative))
    out = placed.withColumn(schema.target, F.when(F.col("rate").isNull(), F.col(schema.target)).otherwise(label))
    return out.select(*[c for c in scored.columns if c != "score"])
