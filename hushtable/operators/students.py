"""Utility of a table: classifiers trained on it and judged on real rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, clipped, text
from hushtable.operators.scores import auc

STUDENTS = ("logistic", "forest", "boosted")


def prepared(df: DataFrame, schema: Schema) -> DataFrame:
    """Features and `label`: missing numbers at their lowest bound, missing categories as `nan`; rows without a label go."""
    target = text(schema.target)
    label = F.when(target == schema.positive, 1.0).when(target == schema.negative, 0.0).alias("label")
    numbers = [F.coalesce(clipped(c, e), F.lit(float(e[0]))).alias(c) for c, e in schema.numeric.items()]
    return df.select(*numbers, *[F.coalesce(text(c), F.lit("nan")).alias(c) for c in schema.categorical], label).where("label is not null")


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number `rows`: models learn and are judged by weights, and private tables have far fewer
    different rows than rows."""
    return rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("rows"))


def students(train: DataFrame, test: DataFrame, schema: Schema, seed: int, names: tuple[str, ...] = STUDENTS) -> DataFrame:
    """Area under the curve of each student on the test rows: (student, auc, positives, negatives).

    Categories that training lacks are one further category. If training rows have fewer than two classes no student can
    learn, and all areas are 0.5.
    """
    made = {
        "logistic": LogisticRegression(maxIter=50, regParam=1e-4, featuresCol="scaled", weightCol="rows"),
        "forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, weightCol="rows"),
        "boosted": GBTClassifier(maxIter=20, maxDepth=3, seed=seed, weightCol="rows"),
    }
    fit, judge = counted(prepared(train, schema)), counted(prepared(test, schema))
    known = fit.select("label").distinct().count()
    indexed = [f"_i_{c}" for c in schema.categorical]
    coded = [f"_o_{c}" for c in schema.categorical]
    steps = []
    if indexed:
        steps += [StringIndexer(inputCols=list(schema.categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep")]
    steps += [VectorAssembler(inputCols=[*schema.numeric, *coded], outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled")]
    out = []
    if known >= 2:
        encoder = Pipeline(stages=steps).fit(fit)
        fit, judge = (encoder.transform(df).select("features", "scaled", "label", "rows").persist() for df in (fit, judge))
    for name in names:
        score = F.lit(0.0)
        rows = judge
        if known >= 2:
            rows = made[name].fit(fit).transform(judge)
            score = vector_to_array("probability")[1]
        out.append(auc(rows.select("label", "rows", score.alias("score")), F.col("score"), F.col("label") == 1, F.col("rows")).select(F.lit(name).alias("student"), "auc", "positives", "negatives"))
    fit.unpersist()
    return reduce(DataFrame.unionByName, out)
