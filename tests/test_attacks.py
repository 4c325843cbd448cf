import numpy as np
import pytest
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators import attacks

SCHEMA = Schema(numeric={"x": (0.0, 1.0), "z": (0.0, 1.0)}, categorical={"c": ("a", "b")}, target="y", positive="1", negative="0", stratify="c")
NAMES = ("nearest", "exact", "shadow", "likelihood")


@pytest.fixture(scope="module")
def world(spark):
    u = "pmod(xxhash64(id, {}), 100000) / 100000.0"
    df = spark.range(2400).selectExpr("id", f"{u.format(1)} x", f"{u.format(2)} z", f"if({u.format(3)} < 0.5, 'a', 'b') c", f"string(int({u.format(4)} < 0.3)) y").cache()
    return df.where("id % 3 = 0"), df.where("id % 3 = 1"), df.where("id % 3 = 2")


def test_copies_are_found_and_independent_rows_are_not(world):
    members, others, free = world
    got = {r["attack"]: r for r in attacks.controlled(free, members, others, SCHEMA, ["id"], seed=1, draws=400).collect()}
    assert set(got) == set(NAMES)
    for r in got.values():
        assert r["advantage"] < 0.08 and r["low"] <= r["auc"] <= r["high"]
    assert got["nearest"]["control"] == 1.0 == got["exact"]["control"] and all(got[n]["works"] for n in ("nearest", "exact", "shadow"))


def test_likelihood_finds_copies_among_many_columns(spark):
    """Where rows are few for their number of columns, a copy raises the density at its place; where they are many, as in
    `world`, its kernel is too wide to show one row, and the control says so."""
    wide = Schema(numeric={f"n{i}": (0.0, 1.0) for i in range(12)}, categorical={"c": ("a", "b")}, target="y", positive="1", negative="0", stratify="c")
    numbers = [f"pmod(xxhash64(id, {i}), 100000) / 100000.0 n{i}" for i in range(12)]
    df = spark.range(900).selectExpr("id", *numbers, "if(id % 2 = 0, 'a', 'b') c", "string(int(id % 7 = 0)) y")
    members, others, free = (df.where(f"id % 3 = {i}") for i in range(3))
    got = attacks.controlled(free, members, others, wide, ["id"], seed=1, draws=200, names=("likelihood",)).first()
    assert got["advantage"] < 0.2 and got["works"] and got["control"] > 0.9


def brute_area(s, y):
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("values", [5, 10_000])
def test_interval_against_resampling(spark, values):
    rng = np.random.default_rng(values)
    y = rng.random(500) < 0.4
    s = np.round((rng.normal(size=500) + 0.5 * y) * values / 4) / values
    df = spark.createDataFrame([*zip(s.tolist(), y.tolist()), (None, True), (float("nan"), False), (0.1, None)], "s double, y boolean")
    got = attacks.auc_interval(df, F.col("s"), F.col("y"), 1500, seed=3).first()
    assert got["auc"] == round(brute_area(s, y), 9) and got["positives"] == y.sum() and got["negatives"] == (~y).sum()
    areas = []
    for _ in range(1500):
        i = rng.integers(0, 500, 500)
        areas.append(brute_area(s[i], y[i]))
    assert np.allclose([got["low"], got["high"]], np.quantile(areas, [0.025, 0.975]), atol=0.008)
    again = attacks.auc_interval(df.repartition(5), F.col("s"), F.col("y"), 1500, seed=3).first()
    assert got == again


def test_interval_without_both_classes(spark):
    for rows in ([], [(1.0, True)], [(None, False)]):
        got = attacks.auc_interval(spark.createDataFrame(rows, "s double, y boolean"), F.col("s"), F.col("y"), 50).first()
        assert got["auc"] is None and got["low"] is None and got["positives"] == sum(bool(r[1]) for r in rows if r[0] is not None)


def test_likelihood_against_plain_densities(spark, world, monkeypatch):
    """Blocks and tasks change nothing; a resample whose weights are all counted gives the plain density."""
    members, others, free = world
    few = members.limit(60).withColumn("member", F.lit(True)).unionByName(others.limit(60).withColumn("member", F.lit(False)))
    one = attacks.likelihood_scores(free, few, SCHEMA, ["id"], seed=2)
    cut = attacks.likelihood_scores(free.repartition(7), few, SCHEMA, ["id"], seed=2, most=13)
    a, b = (sorted((r["member"], round(r["score"], 6)) for r in df.collect()) for df in (one, cut))
    assert a == b and len(a) == 120


def test_nothing_to_learn_from(spark, world):
    members, others, free = world
    got = {r["attack"]: r["auc"] for r in attacks.attacked(free.limit(0), members, others, SCHEMA, ["id"], draws=20, names=("exact", "shadow", "likelihood")).collect()}
    assert set(got.values()) == {0.5}


def test_forest_learns_from_a_few_pieces_of_equal_rows(world, monkeypatch):
    members, others, _ = world
    copies = lambda df: df.orderBy("id").limit(50).drop("id").crossJoin(df.sparkSession.range(40))
    seen, fit = [], attacks.RandomForestClassifier.fit
    monkeypatch.setattr(attacks.RandomForestClassifier, "fit", lambda self, rows: (seen.append(rows.agg(F.count("*"), F.sum("_weight")).first()), fit(self, rows))[1])
    told = attacks.shadow_scores(copies(members), copies(others).withColumn("member", F.col("id") % 2 == 0), SCHEMA, ["id"], trees=3)
    assert tuple(seen[0]) == (400, 4000.0)
    assert sorted(map(tuple, told.groupBy("member").count().collect())) == [(False, 1000), (True, 1000)]


def test_principal_components_weigh_equal_rows(world):
    rows = [([0.0, 1.0], 3), ([1.0, 0.0], 1), ([2.0, 2.0], 4)]
    n, axes, spread = attacks._components(world[0].sparkSession.createDataFrame(rows, "_x array<double>, _n long"), 2)
    x = np.repeat([r[0] for r in rows], [r[1] for r in rows], axis=0)
    cov = np.cov(x.T, bias=True)
    assert n == 8 and np.allclose(axes @ np.diag(spread) @ axes.T, cov) and spread[0] > spread[1]
