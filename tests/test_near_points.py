import numpy as np
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators.near_points import covered, k_nearest, nearest_rows

SCHEMA = Schema(numeric={"x": (0.0, 10.0), "z": (0.0, 1.0)}, categorical={"c": ("a", "b", "d")}, target="y", positive="1", negative="0", stratify="c")


def tables(spark, seed, n, m, spread=200):
    rng = np.random.default_rng(seed)
    made = lambda n: [(i, float(rng.integers(0, spread)) * 10 / spread, float(rng.normal(0.5, 0.2)) if i % 9 else None, str(rng.choice(["a", "b", "?"]))) for i in range(n)]
    sides = made(n), made(m)
    return *sides, *(spark.createDataFrame(s, "id long, x double, z double, c string") for s in sides)


def point(r):
    place = {"a": 0, "b": 1, "d": 2}.get(r[3], -1)
    z = 0.0 if r[2] is None else min(max(r[2], 0.0), 1.0)
    return r[1] / 10, z, place


def apart(p, q):
    return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + 2 * (p[2] != q[2])) ** 0.5


@pytest.mark.parametrize("pivots,block", [(1024, 20_000), (12, 40), (1, 7)])
def test_k_nearest_rows_equal_all_pairs(spark, monkeypatch, pivots, block):
    from hushtable.operators import near_points

    monkeypatch.setattr(near_points.k_nearest, "__defaults__", (pivots, block))
    asked, rows, a, b = tables(spark, 1, 60, 300, 12)
    got = {r["id"]: r["distances"] for r in nearest_rows(a, b, SCHEMA, 4).collect()}
    for r in asked:
        assert np.allclose(got[r[0]], sorted(apart(point(r), point(s)) for s in rows)[:4], atol=1e-8)


def test_few_rows_and_none(spark):
    asked, rows, a, b = tables(spark, 2, 10, 3)
    assert {len(r["distances"]) for r in nearest_rows(a, b, SCHEMA, 5).collect()} == {3}
    assert {len(r["distances"]) for r in nearest_rows(a, b.limit(0), SCHEMA, 5).collect()} == {0}
    assert nearest_rows(a.limit(0), b, SCHEMA, 5).count() == 0
    twice = nearest_rows(a.limit(1).unionAll(a.limit(1)), b.limit(1).unionAll(b.limit(1)), SCHEMA, 5).collect()
    assert len(twice) == 2 and [len(r["distances"]) for r in twice] == [2, 2]


def test_most_cells_are_ruled_out(spark):
    """Tight clusters: a point must not be compared with the other clusters' points."""
    rng = np.random.default_rng(3)
    centres = rng.uniform(0, 100, (40, 2))
    made = lambda n: spark.createDataFrame([(float(x), float(y)) for x, y in centres[rng.integers(0, 40, n)] + rng.normal(0, 0.05, (n, 2))], "u double, v double")
    a, b = made(200), made(4000)
    got = k_nearest(a, b, ["u", "v"], 2, 3).toPandas()
    x = b.toPandas().to_numpy()
    for (u, v), part in got.groupby(["u", "v"]):
        assert np.allclose(part.sort_values("rank")["distance"], np.sort(np.hypot(x[:, 0] - u, x[:, 1] - v))[:3], atol=1e-8)
    assert len(got) == 600


def test_cover(spark):
    asked, rows, a, b = tables(spark, 4, 80, 150, 30)
    k, hits = 3, 0
    points = [point(s) for s in rows]
    for r in asked:
        p = point(r)
        d, near = min((round(apart(p, q), 12), q) for q in points)
        hits += d <= sorted(apart(near, q) for q in points)[k] + 1e-9
    got = covered(a, b, SCHEMA, k).first()
    assert got["n"] == 80 and np.isclose(got["share"], hits / 80)
    assert covered(a.limit(0), b, SCHEMA).first()["n"] == 0
    assert covered(b, b, SCHEMA).first()["share"] == 1.0
