import numpy as np
import pandas as pd
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import correct, distances, ranks, select, stage
from hushtable.operators.ledger import Ledger, check_unit, divide, laplace, total_of

SCHEMA = Schema(numeric={"x": (0, 1, 2)}, categorical={"g": ("a", "b")}, target="y", positive="1", negative="0", stratify="g", levels=((), ("g",), ("g", "x")))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    g = rng.choice(["a", "b"], 4000, p=[0.7, 0.3])
    x = rng.uniform(0, 2, 4000)
    y = (rng.random(4000) < np.where(g == "a", 0.2, 0.6)).astype(int).astype(str)
    return spark.createDataFrame(pd.DataFrame({"id": range(4000), "g": g, "x": x, "y": y})).cache()


def test_ledger_composes_groups_and_paths():
    ledger = Ledger(2.0)
    assert ledger.spend("sizes", 0.5, ["a", "b"]) == 2.0
    ledger.spend("marginals", 0.3, ["a", "b"])
    ledger.spend("marginals", 0.4, ["a/0", "a/1", "b/0"])
    ledger.spend("plain", 0.2)
    ledger.spend("plain", 0.1)
    assert abs(ledger.total - (0.5 + 0.7 + 0.3)) < 1e-12
    with pytest.raises(ValueError):
        ledger.spend("plain", 0.6)
    for bad in ((0, 1), (-1, 1), (float("nan"), 1), (0.1, 0)):
        with pytest.raises(ValueError):
            ledger.spend("plain", bad[0], sensitivity=bad[1])
    ledger.seal()
    with pytest.raises(ValueError):
        ledger.spend("plain", 0.01)
    assert abs(sum(ledger.audit()["groups"].values()) - ledger.total) < 1e-12 and total_of([]) == 0


def test_budget_of_two_is_divided_as_documented():
    b = divide(2.0, 0.2, 4)
    assert np.allclose([b.cohorts, b.cells, b.rates, b.query * 5], [0.1, 0.1, 0.4, 1.4])
    with pytest.raises(ValueError):
        divide(2.0, 1.0, 4)


def test_unit_gate_and_noise():
    assert check_unit(2, None) and check_unit(2, 5) is None and check_unit(2, 6, True) is None
    with pytest.raises(ValueError):
        check_unit(2, 6)
    assert np.array_equal(laplace(1, 5, 3), laplace(1, 5, 3))
    z = laplace(2.0, 20000)
    assert abs(np.median(z)) < 0.15 and abs(np.abs(z).mean() - 2) < 0.15


def test_release_spends_its_budget_and_follows_the_table(people):
    r = stage.release(people, SCHEMA, ["a", "b"], epsilon=2.0, n_min=50, seed=1)
    assert abs(r.audit["total"] - 2.0) < 1e-9 and r.audit["sealed"]
    assert abs(r.cohorts.set_index("cohort")["size"]["a"] - 2800) < 300
    assert np.allclose(r.marginals.groupby(["cohort", "positive", "col"])["share"].sum(), 1, atol=1e-4)
    rates = r.cells.set_index("cell")["rate"]
    assert abs(rates["*"] - 0.32) < 0.05
    assert abs(rates["g=a"] - 0.2) < 0.06 and abs(rates["g=b"] - 0.6) < 0.06 and set(r.cells["level"]) == {0, 1, 2}
    again = stage.Release.from_json(r.to_json())
    assert again.cells.equals(r.cells) and again.audit == r.audit and again.to_json() == r.to_json()


def test_release_refuses(people):
    for wrong in ({"n_min": 10}, {"n_min": 100000}, {"conditional_fraction": 0.0}, {"rows_per_person": 100}):
        with pytest.raises(ValueError):
            stage.release(people, SCHEMA, ["a", "b"], seed=1, **wrong)


def test_ranks_equal_a_sort(spark):
    df = spark.createDataFrame([(i, k) for i in range(3000) for k in ("p", "q") if k == "p" or i < 5], "id int, k string")
    got = ranks.ranked(df, ["k"], ["id"], 3).withColumn("h", ranks.order_key(["id"], 3)).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values("h")
        assert part["rank"].tolist() == list(range(len(part))) and set(part["size"]) == {len(part)}
    assert ranks.sample_exactly(df, 100, ["id", "k"], 1).count() == 100
    assert ranks.sample_exactly(df.limit(0), 100, ["id", "k"], 1).count() == 0
    nulls = spark.createDataFrame([(i, None) for i in range(10)], "id int, k string")
    assert ranks.holdout_split(nulls, "k", 0.2, ["id"], 1).where("held_out").count() == 2


def test_apportionment_adds_up(spark):
    got = ranks.apportion(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "c string, w int"), "c", "w", 100).toPandas().set_index("c")["quota"]
    assert got.to_dict() == {"a": 34, "b": 33, "c": 33, "d": 0}


def test_relabelling_gives_the_released_rates(spark, people):
    table = spark.createDataFrame([("g=a", 0.5)], "cell string, rate double")
    out = correct.relabel(people, table, SCHEMA, ("g",), ["id"], 1).toPandas()
    was = people.toPandas()
    a = out[out["g"] == "a"]
    assert abs((a["y"] == "1").sum() - len(a) / 2) < 1
    b = out[out["g"] == "b"].sort_values("id")["y"].tolist()
    assert len(out) == len(was) and b == was[was["g"] == "b"].sort_values("id")["y"].tolist()
    after = correct.relabel(people, table, SCHEMA, ("g",), ["id"], 1)
    told = correct.gain(people, after, table, SCHEMA, ("g",))
    assert told["worth_it"] and told["after"] < 0.001 < told["before"]
    with pytest.raises(ValueError):
        correct.relabel(people, table, SCHEMA, ("y",), ["id"])


def test_bounds_and_verdict(spark, people):
    table = correct.conditional_table(people, SCHEMA, ("g",), 2.0, n_min=100, seed=1)
    flipped = people.withColumn("y", ranks.F.when(ranks.F.col("g") == "a", "1").otherwise("0"))
    lacking = people.where("g = 'a'")
    scored = correct.bounds(people, {"synthetic": people, "ceiling": people, "floor": flipped, "lacking": lacking}, table, SCHEMA, ("g",), 2.0, n_min=100, seed=2)
    got = {(r.condition, r.cell): r.bound for r in scored.collect()}
    assert got["lacking", "g=b"] == 1.0 and got["synthetic", "g=a"] < 0.05 and got["floor", "g=a"] > 0.5
    assert correct.verdict(scored, 0.1) is True and correct.verdict(scored, 0.001) is None
    assert "n" not in scored.columns


def test_distances_of_higher_order_at_their_ends(people):
    assert {r.distance for r in distances.k_way_distance(people, people, SCHEMA, 3).collect()} == {0.0}
    none = distances.conditional_distance(people, people.limit(0), SCHEMA, ("g",)).toPandas()
    assert abs(none["weight"].sum() - 1) < 1e-6 and (none["distance"] > 0).all()


def test_exact_matches_take_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "p int, q string")
    b = spark.createDataFrame([(1, None, 7), (2, "y", 8), (2, "x", 9), (None, None, 10)], "p int, q string, k int")
    assert sorted(r.k for r in distances.exact_matches(a, b, ["p", "q"]).collect()) == [7, 9]


def test_selection_follows_the_release(people):
    released = stage.release(people, SCHEMA, ["a", "b"], n_min=50, seed=1)
    pool = people.where("y = '0' or id % 2 = 0")  # half of the positives are gone
    odd = pool.withColumn("g", ranks.F.when(ranks.F.col("id") % 50 == 0, "zzz").otherwise(ranks.F.col("g")))
    out = select.select_to_release(odd, released, SCHEMA, 400, ["id"], 3).toPandas()
    assert len(out) == 400 == out["id"].nunique() and set(out["g"]) == {"a", "b"}
    size = released.cohorts.set_index("cohort")
    for c in "ab":
        part = out[out["g"] == c]
        assert abs(len(part) - 400 * size["size"][c] / size["size"].sum()) <= 6
        assert abs((part["y"] == "1").mean() - size["positive_share"][c]) < 0.04
    again = select.select_to_release(odd, released, SCHEMA, 400, ["id"], 3).toPandas()
    assert set(again["id"]) == set(out["id"])
    with pytest.raises(ValueError):
        select.select_to_release(pool.where("g = 'a'"), released, SCHEMA, 400, ["id"])


def test_systematic_picks_the_asked_number():
    rng = np.random.default_rng(0)
    for _ in range(200):
        count = rng.integers(1, 30, 20)
        n = int(rng.integers(1, count.sum() + 1))
        w = select.fill(np.clip(rng.random(20), 0.01, 1), count, n)
        k = select.systematic(w, count, n, rng.random())
        assert k.sum() == n and (k <= count).all()
