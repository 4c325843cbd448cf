import numpy as np
import pandas as pd

from hushtable.functions.bins import Schema
from hushtable.operators import configure
from hushtable.operators.ledger import Ledger

SCHEMA = Schema(numeric={"x": (0.0, 2.0, 4.0, 6.0)}, categorical={"c": tuple("abcdefgh"), "noise": ("u", "v")}, target="y", positive="P", negative="N", stratify="noise")


def test_choice_ranks_groups_and_charges(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"x": rng.random(4000) * 6, "c": rng.choice(list("abcdefgh"), 4000), "noise": rng.choice(["u", "v"], 4000)})
    df["y"] = np.where(rng.random(4000) < df["c"].map({k: i / 7 for i, k in enumerate("abcdefgh")}), "P", "N")
    ledger = Ledger(4.0)
    plan = configure.derive(spark.createDataFrame(df), SCHEMA, ledger, 4.0, rows=4000, n_records=300, share=0.5, seed=1)
    assert plan.columns[0] == "c" and plan.levels[0] == () and plan.levels[-1] == plan.columns
    # eight values in four groups of two, whose rates rise from group to group
    members = {}
    for value, group in plan.groups["c"].items():
        members.setdefault(group, []).append(value)
    assert sorted(map(sorted, members.values())) == [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]]
    assert plan.epsilon == ledger.total == 2.0
    # bands cover the declared range without gap or overlap
    assert sorted(plan.cohorts["x"].values()) == [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0)]
    # one column more would leave fewer records a cell than are needed, or be further from what is wanted
    each = 300 / configure.COHORTS / plan.cells
    assert each >= configure.LEAST_CELL and plan.cells == 4 * (3 if "x" in plan.columns else 1) * (2 if "noise" in plan.columns else 1)
    few = configure.derive(spark.createDataFrame(df.head(9)), SCHEMA, Ledger(4.0), 4.0, rows=9, n_records=9, share=0.1, seed=1)
    assert few.columns == () and few.levels == ((),) and few.cohorts == {}


def test_information():
    assert abs(configure.information(np.array([[5, 0], [0, 5]])) - np.log(2)) < 1e-12
    assert configure.information(np.array([[-1.0, 0], [0, -2]])) == 0 == configure.information(np.ones((3, 2)))
    both = np.stack([np.array([[5.0, 0], [0, 5]]), np.ones((2, 2))])
    assert np.allclose(configure.information(both), [np.log(2), 0])


def test_bands_are_evenly_ranked():
    assert configure.spread((0, 9)) == []
    for m in range(1, 12):
        bands = configure.spread(range(m + 2))
        assert len(bands) == min(m, 2) + 1 and bands[0][0] == 0 and bands[-1][1] == m + 1
        assert all(a[1] == b[0] for a, b in zip(bands, bands[1:]))
