import numpy as np
import pandas as pd
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import bands, closest, students, values

SCHEMA = Schema(numeric={"x": (0.0, 5.0, 10.0), "z": (0.0, 1.0)}, categorical={"c": ("a", "b", "d")}, target="y", positive="P", negative="N", stratify="c")


def table(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, 3.0, rng.random(n) * 10) + shift
    df = pd.DataFrame({"id": np.arange(n), "x": x, "z": rng.random(n), "c": rng.choice(["a", "b", "d"], n)})
    df["y"] = np.where(df["x"] + rng.normal(size=n) > 4, "P", "N")
    return df, spark.createDataFrame(df)


@pytest.mark.parametrize("n", [1, 2, 700])
def test_quantiles_are_exact(spark, n):
    df, sdf = table(spark, n, 1)
    got = {(r["col"], r["i"]): r["value"] for r in values.quantiles(sdf, ["x", "z"], 10).collect()}
    assert len(got) == 22
    for c in ("x", "z"):
        assert np.allclose([got[c, i] for i in range(11)], np.quantile(df[c], np.linspace(0, 1, 11)), atol=1e-8)


def test_quantiles_leave_out_what_is_no_number(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("NaN",), ("Infinity",), ("3",)], "x string")
    assert [r["value"] for r in values.quantiles(df, ["x"], 2).orderBy("i").collect()] == [1.0, 2.0, 3.0]
    assert values.quantiles(df.limit(0), ["x"], 2).count() == 0
    assert values.with_quantile_bins(SCHEMA, df.selectExpr("x", "x as z"), 2).numeric["x"] == [1.0, 2.0, 3.0]
    assert values.with_quantile_bins(SCHEMA, df.selectExpr("'1' as x", "'1' as z"), 2) == SCHEMA


def test_wasserstein_equals_sorted_differences(spark):
    (a, sa), (b, sb) = table(spark, 500, 1), table(spark, 500, 2, 0.3)
    got = {r["col"]: r["distance"] for r in values.wasserstein(sa, sb, SCHEMA).collect()}
    for c, width in (("x", 10), ("z", 1)):
        assert abs(got[c] - np.abs(np.sort(a[c]) - np.sort(b[c])).mean() / width) < 1e-8
    assert {r["distance"] for r in values.wasserstein(sa, sa, SCHEMA).collect()} == {0.0}
    assert {r["distance"] for r in values.wasserstein(sa, sb.limit(0), SCHEMA).collect()} == {None}


def test_cohorts_by_bands(spark):
    df = spark.createDataFrame([(0.0, "a"), (5.0, "b"), (10.0, "a"), (11.0, "a"), (None, "a"), (1.0, None)], "x double, c string")
    out, schema, every = bands.with_cohorts(df, SCHEMA, {"x": {"low": (0.0, 5.0), "high": (5.0, 10.0)}, "c": None})
    assert [r["cohort"] for r in out.collect()] == ["low & a", "high & b", "high & a", "oob & a", "oob & a", None]
    assert schema.stratify == "cohort" and len(every) == 6 and bands.with_cohorts(df, SCHEMA, {})[2] == ["all"]
    for wrong in ({}, {"low": (0.0, 4.0), "high": (5.0, 10.0)}, {"low": (0.0, 5.0)}):
        with pytest.raises(ValueError):
            bands.with_cohorts(df, SCHEMA, {"x": wrong})


def test_coarsened_categories(spark):
    df = spark.createDataFrame([("a",), (" b ",), ("q",), (None,)], "c string")
    out, schema = bands.coarsened(df, SCHEMA, {"c": {"a": "g0", "b": "g0"}})
    assert [r["c"] for r in out.collect()] == ["g0", "g0", "q", None] and schema.categorical["c"] == ("g0", "d")
    with pytest.raises(ValueError):
        bands.coarsened(df, SCHEMA, {"c": {"q": "g0"}})


def test_nearest_equals_all_pairs(spark):
    (a, sa), (b, sb) = table(spark, 60, 1), table(spark, 400, 2)
    got = {r["id"]: r["distance"] for r in closest.nearest(sa, sb, SCHEMA).collect()}
    for r in a.itertuples():
        d = ((r.x - b.x) / 10) ** 2 + (r.z - b.z) ** 2 + 2 * (r.c != b.c)
        assert abs(got[r.id] - np.sqrt(d.min())) < 1e-8
    assert len(got) == 60
    assert {r["distance"] for r in closest.nearest(sa, sb.limit(0), SCHEMA).collect()} == {None}
    assert closest.nearest(sa.limit(0), sb, SCHEMA).count() == 0
    with pytest.raises(ValueError):
        closest.nearest(sa, sb, SCHEMA, most=10)


def test_nearest_meets_equal_rows_once(spark, monkeypatch):
    (_, sa), (b, sb) = table(spark, 60, 1), table(spark, 400, 2)
    met, least = [], closest._least
    monkeypatch.setattr(closest, "_least", lambda points, rows, schema: (met.append(rows.count()), least(points, rows, schema))[1])
    many = sb.crossJoin(spark.range(30)).drop("id").repartition(7)
    got = [{r["id"]: r["distance"] for r in closest.nearest(sa, rows, SCHEMA).collect()} for rows in (sb, many)]
    assert met == [400, 400] and got[0] == got[1] and len(got[0]) == 60


def test_copies_are_closer(spark):
    (_, sa), (_, sb) = table(spark, 200, 1), table(spark, 200, 2)
    assert tuple(closest.closer_share(sa, sa, sb, SCHEMA).first()) == (200, 1.0)
    assert closest.closer_share(sa, sb, sb, SCHEMA).first()["share"] == 0.5


def test_closer_share_takes_all_queries_in_blocks(spark):
    (a, sa), (b, sb), (c, sc) = table(spark, 90, 1), table(spark, 80, 2), table(spark, 120, 3)
    far = lambda p, t: np.sqrt((((p.x - t.x) / 10) ** 2 + (p.z - t.z) ** 2 + 2 * (p.c != t.c)).min()).round(9)
    score = [(far(r, b) < far(r, c)) + 0.5 * (far(r, b) == far(r, c)) for r in a.itertuples()]
    got = closest.closer_share(sa.union(sa.where("id < 5")), sb, sc, SCHEMA, most=20).first()
    assert got["n"] == 95 and abs(got["share"] - (sum(score) + sum(score[:5])) / 95) < 1e-8
    assert tuple(closest.closer_share(sa, sb.limit(0), sc, SCHEMA).first()) == (0, None)
    assert tuple(closest.closer_share(sa.limit(0), sb, sc, SCHEMA).first()) == (0, None)


def test_students_learn(spark):
    (_, sa), (_, sb) = table(spark, 600, 1), table(spark, 600, 2)
    got = students.students(sa, sb, SCHEMA, 1).collect()
    assert [r["student"] for r in got] == list(students.STUDENTS) and min(r["auc"] for r in got) > 0.85
    one = students.students(sa.where("y = 'P'"), sb, SCHEMA, 1, ("logistic",)).first()
    assert one["auc"] == 0.5
