import numpy as np
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import adaptive
from hushtable.operators.ledger import rho_of

SCHEMA = Schema(numeric={"x": (0, 10, 20, 30), "z": (0, 1, 2)}, categorical={"k": ("u", "v", "w"), "g": ("a", "b")}, target="y", positive="1", negative="0", stratify="g")


@pytest.fixture(scope="module")
def planted(spark):
    """x - k - y is a chain, z depends on g, and the two parts know nothing of each other."""
    h = "pmod(xxhash64(id, {}), 1000) / 1000.0"
    df = spark.range(20000).selectExpr("id", f"30 * {h.format(1)} x", f"{h.format(2)} r", f"{h.format(3)} s", f"if({h.format(4)} < 0.4, 'a', 'b') g", f"{h.format(5)} t")
    df = df.selectExpr("id", "x", "g", "s", "element_at(array('u', 'v', 'w'), 1 + cast(if(r < 0.9, floor(x / 10), pmod(id, 3)) as int)) k", "if((g = 'a') = (t < 0.85), 0.5, 1.5) z")
    return df.selectExpr("id", "x", "z", "k", "g", "if((k = 'u') = (s < 0.9), '1', '0') y").cache()


def test_counts_of_sets(spark, planted):
    sets = [("x",), ("k", "y"), ("g", "z", "k")]
    got = adaptive.table_counts(planted, SCHEMA, sets)
    rows = planted.toPandas()
    assert got["x",].tolist() == np.histogram(rows["x"], SCHEMA.numeric["x"])[0].tolist()
    for i, k in enumerate("uvw"):
        for j, y in enumerate("01"):
            assert got["k", "y"][i, j] == ((rows["k"] == k) & (rows["y"] == y)).sum()
    assert got["g", "z", "k"].shape == (2, 2, 3) and got["g", "z", "k"].sum() == 20000
    odd = spark.createDataFrame([(1.0, 0.5, "u", "a", "1"), (None, 0.5, "u", "a", "1"), (1.0, 0.5, "?", None, "1")], "x double, z double, k string, g string, y string")
    got = adaptive.table_counts(odd, SCHEMA, sets)
    assert got["x",].sum() == 2 and got["k", "y"].sum() == 1 and got["g", "z", "k"].sum() == 1


def test_a_planted_tree_is_found_and_the_budget_spent(planted):
    got = adaptive.spanning_tree(planted, SCHEMA, 2.0, seed=3)
    pairs = {frozenset(s) for s in got.sets if len(s) == 2}
    assert len(pairs) == 4 and {frozenset("xk"), frozenset("ky"), frozenset("zg")} <= pairs
    assert np.isclose(got.audit["total"], rho_of(2.0, 1e-9)) and np.isclose(got.audit["total"], got.audit["declared"])
    rows = planted.toPandas()
    have = got.model.table(("k", "y"))
    assert np.isclose(have[0, 1] / have[0].sum(), (rows.loc[rows["k"] == "u", "y"] == "1").mean(), atol=0.03)


def test_rounds_measure_what_is_missed(spark, planted):
    got = adaptive.worst_tables(planted, SCHEMA, 2.0, rounds=8, seed=4)
    assert got.sets[:5] == [("x",), ("z",), ("k",), ("g",), ("y",)]
    assert {("x", "k"), ("k", "y"), ("z", "g")} <= set(got.sets)
    assert np.isclose(got.audit["total"], rho_of(2.0, 1e-9)) and got.audit["sealed"]
    tight = adaptive.worst_tables(planted, SCHEMA, 2.0, rounds=4, entries=1, seed=4)
    assert all(len(s) == 1 for s in tight.sets)
    rows = adaptive.drawn_rows(spark, got.model, SCHEMA, 20000, 1).toPandas()
    real = planted.toPandas()
    pair = lambda t: t.groupby([np.minimum(t["x"] // 10, 2), "k"]).size().div(len(t))
    assert pair(rows).sub(pair(real), fill_value=0).abs().sum() / 2 < 0.03
    assert rows["z"].between(0, 2).all() and set(rows["y"]) == {"0", "1"}


def test_the_exact_law_stays_below_the_conversion():
    """The Gaussian mechanism's own delta, from the normal law, is below what its rho says for every epsilon."""
    import math

    from hushtable.operators.ledger import delta_of

    below = lambda x: math.erfc(-x / math.sqrt(2)) / 2
    for rho in (0.01, 0.1, 1.0, 4.0):
        for epsilon in (0.1, 1.0, 3.0):
            s = 1 / math.sqrt(2 * rho)
            exact = below(1 / (2 * s) - epsilon * s) - math.exp(epsilon) * below(-1 / (2 * s) - epsilon * s)
            bound = delta_of(rho, epsilon)
            assert exact <= bound <= 30 * exact + 1e-12
            if 1e-12 < bound < 1:
                assert math.isclose(rho_of(epsilon, bound), rho, rel_tol=1e-6)
