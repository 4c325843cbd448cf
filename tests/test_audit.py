import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, clipped_band, half_open_band, number, selection_bin, whole
from hushtable.operators import audit, ledger

SCHEMA = Schema(numeric={"x": (0.0, 2.0, 4.0)}, categorical={"c": ("a", "b")}, target="y", positive="P", negative="N", stratify="c")
ROWS = [("1", "a", "P"), ("2", "b", "N"), ("9", "a", "P"), ("?", "z", "N"), (None, None, "Q"), ("-1", " b ", None)]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "x string, c string, y string")


def test_bins_at_the_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.9, 2.0, 4.0, 5.0, None)], "x double")
    got = df.select(selection_bin(F.col("x"), (0, 2, 4)), half_open_band(F.col("x"), (0, 2, 4)), clipped_band("x", (0, 2, 4))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 1, 1, 0]
    assert [r[1] for r in got] == ["nan", "0", "0", "1", "nan", "nan", "nan"]
    assert [r[2] for r in got] == ["0", "0", "0", "0", "1", "1", None]
    assert [r[0] for r in spark.createDataFrame([("2.0",), ("-3.0",), ("2.50",), ("a.0",), (None,)], "v string").select(whole(F.col("v"))).collect()] == ["2", "-3", "2.50", "a.0", None]


def test_problems_and_refusal(rows):
    got = {(r["col"], r["problem"]): r["n"] for r in audit.problems(rows, SCHEMA).collect()}
    assert got == {("x", "missing"): 1, ("x", "unreadable"): 1, ("x", "outside"): 2, ("c", "missing"): 1, ("c", "undeclared"): 1, ("y", "missing"): 1, ("y", "undeclared"): 1}
    with pytest.raises(ValueError, match="c: 1 missing"):
        audit.require(rows, SCHEMA)
    with pytest.raises(ValueError, match="not found: y"):
        audit.require(rows.drop("y"), SCHEMA)
    good = rows.where("y in ('P', 'N') and c in ('a', 'b')")
    assert audit.require(good, SCHEMA) is good and audit.problems(rows.where("false"), SCHEMA).count() == 0
    assert number("x") is not None


def test_values_seen_and_other(rows):
    got = {r["col"]: (r["declared"], r["seen"], r["other"]) for r in audit.distinct_seen(rows, SCHEMA).collect()}
    assert got == {"c": (2, 2, 1), "y": (2, 2, 1)}


def test_names_there_and_back(rows):
    there = audit.renamed(rows, {"c": "k1"}, {"c": {"a": "v1", "b": "v2"}})
    assert [r.k1 for r in there.collect()] == ["v1", "v2", "v1", None, None, "v2"]
    back = audit.renamed(there, {"k1": "c"}, {"k1": {"v1": "a", "v2": "b"}})
    assert [r.c for r in back.collect()] == ["a", "b", "a", None, None, "b"]
    with pytest.raises(ValueError):
        audit.renamed(rows, {}, {"c": {"a": "v", "b": "v"}})


def test_histograms_by_hand(spark):
    one = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], 0.25, 1.0, 3.0)], "p array<double>, q array<double>, w double, lo double, hi double")
    r = one.select(audit.mixture(F.col("p"), F.col("q"), F.col("w")), audit.mass_between(F.col("p"), (0, 2, 4), F.col("lo"), F.col("hi"))).first()
    assert np.allclose(r[0], [0.875, 0.125]) and r[1] == 0.5
    marginals = spark.createDataFrame([("u", 3, "x", "0", 0.25), ("u", 3, "x", "1", 0.75), ("v", 1, "x", "0", 1.0), ("u", 3, "c", "a", 1.0)], "cohort string, size int, col string, bin string, share double")
    cells = spark.createDataFrame([("x=0",), ("x[0,2) & y=P",)], "cell string")
    got = {r["col"]: r["covered"] for r in audit.band_coverage(marginals, cells, SCHEMA).collect()}
    assert got == {"x": round((0.25 * 3 + 1) / 4, 9)}


def test_order_of_texts_and_numbers(spark):
    df = spark.createDataFrame([(1, 10), (2, 2), (3, 10)], "id int, v int")
    assert [r.id for r in audit.as_texts(df, ["v"], ["id"]).collect()] == [1, 3, 2]
    assert {r.id: r.number for r in audit.numbered(df, "v", ["id"]).collect()} == {1: 0, 3: 1, 2: 0}
    assert [(r.side, r.id) for r in audit.extremes(df, "v", "id", 1).collect()] == [("worst", 1), ("best", 2)]


def test_mechanisms():
    assert ledger.mean_sensitivity(0, 10, 5) == 2
    with pytest.raises(ValueError):
        ledger.mean_sensitivity(1, 1, 5)
    scores = [0.0, 1.0, 2.0]
    for choose in (ledger.exponential_choice, ledger.permute_and_flip):
        picks = np.bincount([choose(scores, 2.0, seed=i) for i in range(4000)], minlength=3) / 4000
        assert picks[0] < picks[1] < picks[2] and choose(scores, 500.0, seed=1) == 2
    picks = np.bincount([ledger.exponential_choice(scores, 2.0, seed=i) for i in range(4000)], minlength=3) / 4000
    assert np.allclose(picks, np.exp(scores) / np.exp(scores).sum(), atol=0.03)
    for epsilon, delta in ((1.0, 1e-6), (4.0, 1e-9)):
        rho = ledger.rho_of(epsilon, delta)
        assert 0.9 * delta < ledger.delta_of(rho, epsilon) <= delta
        # no worse than the plain bound epsilon = rho + 2 sqrt(rho log(1 / delta))
        assert rho + 2 * math.sqrt(rho * math.log(1 / delta)) >= epsilon
    assert abs(ledger.gaussian(0.5, 1.0, 20_000, seed=1).std() - 1) < 0.02
