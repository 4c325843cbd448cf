import numpy as np
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import assess, counts, decode, joint, select, stage

SCHEMA = Schema(
    numeric={"x": (0, 10, 20), "z": (0.0, 0.5, 1.5)}, categorical={"g": ("a", "b"), "k": ("p", "q")},
    target="y", positive="1", negative="0", stratify="g", levels=(("g",), ("x", "k")),
)


@pytest.fixture(scope="module")
def private(spark):
    label = "string(int(case when x < 10 and k = 'p' then id % 10 < 8 else id % 10 < 2 end))"
    df = spark.range(8000).selectExpr("id", "if(id % 3 = 0, 'b', 'a') g", "double(id % 21) x", "double(id % 4) / 4 z", "if(id % 7 < 3, 'p', 'q') k")
    return df.selectExpr("*", f"{label} y").cache()


@pytest.fixture(scope="module")
def released(private):
    return stage.release(private, SCHEMA, ["a", "b"], epsilon=20.0, n_min=50, rows_per_person=1, acknowledged=True, seed=2)


def rates(df):
    return {r["cell"]: r["rate"] for r in counts.cell_rates(df, SCHEMA).where("level = 1").collect()}


def test_fit_meets_cells_and_marginals(released):
    got = joint.fit(released, SCHEMA)
    assert got.columns == ["x", "k"] and got.shares.shape == (2, 2, 2, 2) and np.isclose(got.shares.sum(), 1) and got.apart < 0.02
    for r in released.cells[released.cells["level"] == 1].itertuples():
        x, k = r.cell.split(" & ")
        part = got.shares[:, :, int(x.startswith("x[10")), int(k == "k=q")].sum(axis=0)
        assert abs(part[1] / part.sum() - r.rate) < 0.03
    with pytest.raises(ValueError):
        joint.fit(released, Schema(**{**SCHEMA.__dict__, "numeric": {"x": tuple(range(2_000_000)), "z": (0.0, 0.5, 1.5)}}))


def test_fit_is_the_greatest_entropy_of_a_made_case(released):
    """Without cells the fit is the product of the columns' shares in each cohort and class."""
    bare = stage.Release(released.cohorts, released.marginals, released.cells.iloc[:0], released.audit, [])
    p = joint.fit(bare, SCHEMA).shares
    given = p / p.sum(axis=(2, 3), keepdims=True)
    assert np.allclose(given, given.sum(axis=3, keepdims=True) * given.sum(axis=2, keepdims=True), atol=1e-9)


def test_joint_rows_have_the_released_rates_and_independent_ones_do_not(spark, released, private):
    rows = decode.draw(spark, released, SCHEMA, 6000, 1, joint.fit(released, SCHEMA))
    assert rows.count() == 6000 == rows.select("row").distinct().count()
    real, got, plain = rates(private), rates(rows), rates(decode.draw(spark, released, SCHEMA, 6000, 1))
    apart = lambda other: max(abs(real[c] - other[c]) for c in real)
    assert apart(got) < 0.04 and apart(plain) > 0.1
    chosen = decode.decode(spark, released, SCHEMA, 2000, seed=3)
    assert chosen.count() == 2000 and apart(rates(chosen)) < 0.04


def test_selection_meets_cells(spark, released, private):
    """A pool without the link between columns and target yields rows that have it."""
    pool = decode.draw(spark, released, SCHEMA, 9000, 5)
    real = rates(private)
    got = select.select_to_release(pool, released, SCHEMA, 1500, ["row"])
    assert got.count() == 1500
    assert max(abs(real[c] - r) for c, r in rates(got).items()) < 0.05 < max(abs(real[c] - r) for c, r in rates(pool).items())


def test_exchanges_only_bring_counts_nearer(spark, released):
    pool = select.with_signature(decode.draw(spark, released, SCHEMA, 9000, 5), SCHEMA)
    keys = ["_cohort", "_positive", "_bin_x", "_bin_z", "_bin_g", "_bin_k"]
    signatures = pool.groupBy(*keys).count().withColumnRenamed("count", "n").toPandas().sort_values(keys, ignore_index=True)
    even = np.minimum(signatures["n"].to_numpy(), 40)
    n = int(even.sum())
    goals = select.cell_goals(released, n)

    def off(quota):
        return sum(abs(sum(q for q, k in zip(quota, level) if k == goal) - goals[goal]) for level in select.level_keys(signatures, SCHEMA) for goal in set(level) & set(goals))

    got = select.swapped(signatures, even, released, SCHEMA, n, 500)
    assert got.sum() == n and (got >= 0).all() and (got <= signatures["n"]).all() and off(got) < 0.7 * off(even)
    assert (select.swapped(signatures, even, released, SCHEMA, n, 0) == even).all()


def test_redraw_stays_in_bins_and_bands(spark):
    df = spark.createDataFrame([(i, float(i % 21), (i % 15) / 10, "a", "p", "1") for i in range(500)] + [(500, None, 9.0, "a", "p", "1")], "id int, x double, z double, g string, k string, y string")
    got = select.redraw(df, SCHEMA, ["id"], 3, {"x": [0, 5, 20]}).toPandas().set_index("id").sort_index()
    was = df.toPandas().set_index("id").sort_index()
    assert np.isnan(got.x[500]) and 0.5 <= got.z[500] <= 1.5
    a, b = was[:-1], got[:-1]
    assert (np.digitize(a.x, [5, 10]) == np.digitize(b.x, [5, 10])).all() and (b.x % 1 == 0).all() and b.x.max() == 20 and (a.x != b.x).any()
    assert ((a.z < 0.5) == (b.z < 0.5)).all() and list(got.columns) == ["x", "z", "g", "k", "y"]


def test_permuted_keeps_counts_and_breaks_links(private):
    got = assess.permuted(private, "y", ["id"], 1)
    assert got.columns == private.columns and got.count() == private.count() == got.select("id").distinct().count()
    assert got.groupBy("y").count().collect() and dict(got.groupBy("y").count().collect()) == dict(private.groupBy("y").count().collect())
    assert max(rates(got).values()) - min(rates(got).values()) < 0.1
    assert assess.permuted(private.limit(0), "y", ["id"]).count() == 0


def test_feasible():
    assert assess.domain_size(SCHEMA) == 32 and not assess.infeasible(SCHEMA, 10**9)
    wide = Schema(**{**SCHEMA.__dict__, "numeric": {f"c{i}": tuple(range(9)) for i in range(18)}, "levels": ()})
    assert len(assess.infeasible(wide, 60_000)) == 3


def test_bound_with_controls(private, released, spark):
    train, holdout = private.where("id % 2 = 0"), private.where("id % 2 = 1")
    table = spark.createDataFrame([(c, 1000, r) for c, r in rates(train).items()], "cell string, support long, rate double")
    args = dict(release=released, table=table, schema=SCHEMA, columns=("x", "k"), ids=["id"], epsilon=2.0, rows_per_person=2, n_min=150, noise_seed=1)
    good = assess.bound_with_controls(train, holdout, holdout, **args)
    assert good["controls_discriminate"] and good["verdict"] is True and good["epsilon_per_person"] == 2 * (released.audit["total"] + 2)
    bad = assess.bound_with_controls(train, assess.permuted(holdout, "y", ["id"], 4), holdout, **args)
    assert bad["verdict"] is False
    assert assess.bound_with_controls(train, holdout, holdout, **args, allowed=1.0)["verdict"] is None
    with pytest.raises(ValueError):
        assess.bound_with_controls(train, holdout.limit(0), holdout, **args)


def test_correct(private, spark):
    flat = assess.permuted(private, "y", ["id"], 1)
    after, told = assess.correct(private, flat, SCHEMA, ("x", "k"), ["id"], 2.0, noise_seed=1)
    assert told["worth_it"] and told["after"] < 0.02 and told["shift"] == 0 and after.count() == private.count()


def test_evaluate(private):
    train, holdout = private.where("id % 2 = 0"), private.where("id % 2 = 1")
    got = {(r["table"], r["measure"]): r for r in assess.evaluate({"copy": train}, train, holdout, SCHEMA, ["id"], 1500, draws=1, names=("logistic",)).collect()}
    assert got["copy", "one-way distance"]["mean"] == 0 == got["copy", "absent values"]["mean"]
    assert got["real", "area of logistic"]["mean"] > 0.7 and got["copy", "area of logistic"]["mean"] > 0.7
    assert got["permuted", "two-way distance"]["mean"] > got["real", "two-way distance"]["mean"] + 0.02
    assert got["permuted", "area of logistic"]["least"] == got["permuted", "area of logistic"]["most"]
    with pytest.raises(ValueError):
        assess.evaluate({"real": train}, train, holdout, SCHEMA, ["id"], 10)


def test_pooled_counts_weigh_more(spark, private, released):
    """A heavier weight on counts over all cohorts brings those nearer, and numbers drawn anew stay in their bins."""
    import pandas as pd
    from pyspark.sql import functions as F

    n, columns = 300, [*SCHEMA.numeric, *SCHEMA.categorical]
    keys = ["_cohort", "_positive", *(f"_bin_{c}" for c in columns)]
    signatures = select.with_signature(private, SCHEMA).groupBy(*keys).agg(F.count("*").alias("n")).toPandas().sort_values(keys, ignore_index=True)
    signatures = signatures[signatures["_cohort"].isin(released.cohorts["cohort"])].reset_index(drop=True)
    rng = np.random.default_rng(1)
    start = np.minimum(rng.multinomial(n, np.full(len(signatures), 1 / len(signatures))), signatures["n"].to_numpy())
    size = released.cohorts.set_index("cohort")
    of = lambda r: size.at[r.cohort, "size"] / size["size"].sum() * start.sum() * (size.at[r.cohort, "positive_share"] if r.positive else 1 - size.at[r.cohort, "positive_share"])
    goal = pd.Series(0.0, index=pd.MultiIndex.from_tuples(sorted({(r.col, r.bin) for r in released.marginals.itertuples()})))
    for r in released.marginals.itertuples():
        goal[r.col, r.bin] += r.share * of(r)

    def off(quota):
        have = {(c, b): quota[(signatures[f"_bin_{c}"] == b).to_numpy()].sum() for c, b in goal.index}
        return sum(abs(have[k] - goal[k]) for k in goal.index)

    light, heavy = (select.swapped(signatures, start, released, SCHEMA, int(start.sum()), 400, pooled=p) for p in (0.0, 10.0))
    assert off(heavy) <= off(light) < off(start) and heavy.sum() == start.sum()
    got = select.select_to_release(private, released, SCHEMA, 200, ["id"], within_bins=True)
    both = got.select("id", F.col("x").alias("new")).join(private, "id").toPandas()
    assert len(both) == 200 and (both["new"] != both["x"]).any()
    edges = SCHEMA.numeric["x"][1:-1]
    assert (np.digitize(both["new"], edges) == np.digitize(both["x"], edges)).all()


def test_the_gate_refuses_a_budget_that_protects_nobody(spark, private, released):
    table = spark.createDataFrame([("x[0,10)", 1000, 0.5)], "cell string, support long, rate double")
    with pytest.raises(ValueError, match="over 10"):
        assess.bound_with_controls(private, private, private, released, table, SCHEMA, ("x", "k"), ["id"], 2.0, 2, gate=True)
