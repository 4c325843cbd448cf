import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators import centres, propensity, transport, values, workloads
from hushtable.operators.distances import k_way_distance
from hushtable.operators.ledger import Ledger
from hushtable.operators.scores import auc

SCHEMA = Schema(numeric={"x": (0.0, 5.0, 10.0), "z": (0.0, 0.5, 2.0)}, categorical={"c": ("a", "b", "d")}, target="y", positive="1", negative="0", stratify="c")


def rows(spark, seed, n, tilt=0.0):
    rng = np.random.default_rng(seed)
    made = [(i, float(rng.integers(0, 9)) + tilt, float(rng.choice([0.0, 0.25, 1.0])), str(rng.choice(["a", "b", "?"])) if i % 7 else None, str(int(rng.random() < 0.4))) for i in range(n)]
    return made, spark.createDataFrame(made, "id long, x double, z double, c string, y string")


# transport


def test_least_cost_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n = int(rng.integers(1, 7))
        cost = rng.integers(0, 20, (n, n)).astype(float) if rng.random() < 0.5 else rng.random((n, n))
        want = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert np.isclose(transport.least_cost(np.ones(n), np.ones(n), cost), want)


def test_whole_masses_equal_single_units():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(1, 4)), rng.integers(1, 4, rng.integers(1, 4))
        a[0] += max(0, b.sum() - a.sum())
        b[0] += max(0, a.sum() - b.sum())
        cost = rng.random((len(a), len(b)))
        units = np.repeat(np.repeat(cost, a, axis=0), b, axis=1)
        assert np.isclose(transport.least_cost(a, b, cost), transport.least_cost(np.ones(len(units)), np.ones(len(units)), units))
    with pytest.raises(ValueError):
        transport.least_cost(np.array([1]), np.array([2]), np.ones((1, 1)))


def test_transport_along_a_line_and_duality():
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.random(300)), np.sort(rng.random(300) ** 2)
    assert np.isclose(transport.least_cost(np.ones(300), np.ones(300), np.abs(x[:, None] - y[None, :])), np.abs(x - y).sum())


def test_one_way_transport_is_the_wasserstein_distance(spark):
    (_, a), (_, b) = rows(spark, 4, 90), rows(spark, 5, 61, 1.0)
    got = {r["col"]: r["distance"] for r in transport.k_way_transport(a, b, SCHEMA, 1, ["id"]).collect()}
    want = {r["col"]: r["distance"] for r in values.wasserstein(a, b, SCHEMA).collect()}
    assert all(np.isclose(got[c], want[c], atol=1e-8) for c in ("x", "z")) and np.isclose(got["mean"], np.mean([got[c] for c in "xzcy"]), atol=1e-8)
    # a category's distance is the root of 2 times its total variation
    varied = {r["col"]: r["distance"] for r in k_way_distance(a, b, SCHEMA, 1).collect()}
    assert np.isclose(got["c"], 2**0.5 * varied["c"], atol=1e-8) and np.isclose(got["y"], 2**0.5 * varied["y"], atol=1e-8)


def test_pairs_and_empty_tables(spark):
    made, a = rows(spark, 6, 6)
    other, b = rows(spark, 7, 6, 0.5)
    got = {r["col"]: r["distance"] for r in transport.k_way_transport(a, b, SCHEMA, 2, ["id"]).collect()}
    assert len(got) == 7
    cost = np.array([[(((p[1] - q[1]) / 10) ** 2 + 2 * ((p[3] or "nan") != (q[3] or "nan"))) ** 0.5 for q in other] for p in made])
    assert np.isclose(got["x|c"], min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6))) / 6, atol=1e-8)
    none = transport.k_way_transport(a, b.limit(0), SCHEMA, 2, ["id"]).collect()
    assert len(none) == 7 and all(r["distance"] is None for r in none)
    assert transport.k_way_transport(a, a, SCHEMA, 3, ["id"]).where("distance <> 0").count() == 0
    with pytest.raises(ValueError):
        transport.k_way_transport(a, b, SCHEMA, 5, ["id"])


# workloads


def test_drawn_sets_are_skewed_and_different():
    names = [f"c{i}" for i in range(12)]
    got = workloads.skewed_sets(names, 60, seed=3)
    assert len(set(got)) == 60 == len(got) and all(list(s) == sorted(s, key=names.index) and len(set(s)) == 3 for s in got)
    uses = sorted(sum(c in s for s in got) for c in names)
    assert uses[-1] > 2 * max(uses[2], 1) and got == workloads.skewed_sets(names, 60, seed=3) != workloads.skewed_sets(names, 60, seed=4)
    assert len(workloads.skewed_sets(names[:5], 256)) == 10
    assert workloads.target_sets(["a", "t", "b"], "t") == [("t", "a", "b")]


def test_workload_errors_are_twice_the_distances(spark):
    (_, a), (_, b) = rows(spark, 8, 200), rows(spark, 9, 150, 2.0)
    every = list(itertools.combinations(["x", "z", "c", "y"], 3))
    mine = workloads.target_sets(["x", "z", "c", "y"], "y")
    got = {r["workload"]: r for r in workloads.workload_error(a, b, SCHEMA, {"all": every, "target": mine, "heavy": every[:2]}, {"heavy": [3.0, 1.0]}).collect()}
    want = {r["col"]: r["distance"] for r in k_way_distance(a, b, SCHEMA, 3).collect()}
    assert np.isclose(got["all"]["error"], 2 * want["mean"], atol=1e-8) and np.isclose(got["target"]["error"], 2 * want["mean with target"], atol=1e-8)
    assert got["all"]["sets"] == 4 and np.isclose(got["heavy"]["error"], 2 * (3 * want["|".join(every[0])] + want["|".join(every[1])]) / 4, atol=1e-8)


# centres


def test_planted_centres_are_found_and_the_budget_spent(spark):
    rng = np.random.default_rng(10)
    planted = np.array([[2.0, 30.0], [8.0, 80.0]])
    points = [(float(a), float(b)) for a, b in planted[rng.integers(0, 2, 4000)] + rng.normal(0, 0.3, (4000, 2)) * [1, 10]] + [(None, 5.0)] * 50
    df = spark.createDataFrame(points, "u double, v double")
    bounds, ledger = {"u": (0.0, 10.0), "v": (0.0, 100.0)}, Ledger(3.0)
    found = centres.noisy_centres(df, bounds, 2, 3.0, ledger=ledger, seed=1)
    got = found[found[:, 0].argsort()] * [10, 100]
    assert np.allclose(got, planted, atol=[0.5, 5]) and np.isclose(ledger.total, 3.0)
    with pytest.raises(ValueError):
        ledger.spend("more", 0.1)
    told = centres.clustered(df, bounds, found).groupBy("cluster").count().collect()
    assert {r["cluster"] for r in told} == {0, 1, None} and sum(r["count"] for r in told) == 4050
    assert centres.noisy_centres(df.limit(0), bounds, 3, 1.0, seed=2).shape == (3, 2)


# order kept


@pytest.fixture(scope="module")
def leaning(spark):
    u = "pmod(xxhash64(id, {}), 1000) / 1000.0"
    return spark.range(1500).selectExpr("id", f"10 * {u.format(1)} x", f"2 * {u.format(2)} z", f"element_at(array('a', 'b', 'd'), 1 + cast(pmod(xxhash64(id, 3), 3) as int)) c", f"string(int({u.format(4)} < {u.format(1)})) y", f"string(int({u.format(5)} < 0.4)) noise")


def test_scores_only_where_there_is_something_to_keep(spark, leaning):
    scored, area = propensity.lean(leaning, SCHEMA, ["id"], trees=20)
    assert 0.75 < area < 0.9 and scored.count() == 1500 and scored.columns == [*leaning.columns, "score"]
    noise, area = propensity.lean(leaning.withColumn("y", F.col("noise")), SCHEMA, ["id"], trees=20)
    assert noise is None and area < 0.55
    assert propensity.lean(leaning.limit(20), SCHEMA, ["id"]) == (None, None)
    assert propensity.lean(leaning.withColumn("y", F.lit("1")), SCHEMA, ["id"]) == (None, None)


def test_labels_follow_the_order_within_cells(spark):
    rng = np.random.default_rng(11)
    made = [(i, float(rng.integers(0, 10)), "a" if i % 3 else "b", "0", None if i % 50 == 0 else float(rng.choice([0.1, 0.5, 0.5, 0.90001, 0.90002]))) for i in range(400)]
    scored = spark.createDataFrame([(i, x, 0.1, c, y, s) for i, x, c, y, s in made], "id long, x double, z double, c string, y string, score double")
    table = spark.createDataFrame([("c=a", 0.37)], "cell string, rate double")
    got = {r["id"]: r["y"] for r in propensity.relabel_in_order(scored, table, SCHEMA, ("c",), ["id"], 3).collect()}
    assert len(got) == 400 and all(got[i] == "0" for i, _, c, _, _ in made if c == "b")
    mine = [(round(s or 0.0, 4), got[i]) for i, _, c, _, s in made if c == "a"]
    ones = sorted(s for s, y in mine if y == "1")
    assert len(ones) in (int(0.37 * len(mine)), int(0.37 * len(mine)) + 1)
    assert max(s for s, y in mine if y == "0") <= min(ones)


def test_order_is_kept_end_to_end(spark, leaning):
    scored, _ = propensity.lean(leaning, SCHEMA, ["id"], trees=20)
    table = spark.createDataFrame([(f"c={v}", 0.3) for v in "abd"], "cell string, rate double")
    out = propensity.relabel_in_order(scored, table, SCHEMA, ("c",), ["id"])
    assert out.columns == leaning.columns and abs(out.where("y = '1'").count() - 450) <= 2
    assert auc(out, F.col("x"), F.col("y") == "1").first()["auc"] > 0.9
