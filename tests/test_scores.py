import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hushtable.operators.scores import advantage, advantage_bound, auc


def area(spark, s, p):
    df = spark.createDataFrame(pd.DataFrame({"s": s, "p": p}).astype({"s": float, "p": bool}))
    return auc(df, F.col("s"), F.col("p")).first()


def test_area_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    for s in (rng.normal(size=300), rng.integers(0, 5, 300), np.ones(300), np.append(rng.random(299), 1e9)):
        p = rng.random(300) < 0.4
        pairs = np.sign(np.asarray(s, float)[p][:, None] - np.asarray(s, float)[~p][None])
        assert abs(area(spark, s, p)[0] - (pairs.mean() + 1) / 2) < 1e-8


def test_area_without_both_classes_or_scores(spark):
    assert area(spark, [1, 2], [True, True])[0] is None
    df = spark.createDataFrame([(None, True), (float("nan"), False), (1.0, None)], "s double, p boolean")
    assert tuple(auc(df, F.col("s"), F.col("p")).first()) == (None, 0, 0)
    assert auc(df.limit(0), F.col("s"), F.col("p")).count() == 1


def test_advantage_and_its_bound():
    assert advantage(0.4) == advantage(0.6) and round(advantage_bound(2), 3) == 0.762
