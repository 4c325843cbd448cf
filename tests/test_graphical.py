import itertools

import numpy as np
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import decode, fitted, joint, stage
from hushtable.operators.graphical import Measured, calibrated, fit, junction_tree, sampled


def random_joint(widths, seed):
    p = np.random.default_rng(seed).gamma(1.0, size=tuple(widths.values())) + 0.05
    return p / p.sum()


def over(p, widths, columns):
    names = list(widths)
    kept = sorted(columns, key=names.index)
    out = p.sum(axis=tuple(i for i, c in enumerate(names) if c not in columns))
    return out.transpose([kept.index(c) for c in columns])


def test_messages_equal_enumeration():
    widths = dict(zip("abcde", (2, 3, 2, 4, 3)))
    rng = np.random.default_rng(3)
    tree = junction_tree(widths, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("e",)])
    potentials = {c: rng.normal(size=[widths[x] for x in tree.bag(c)]) for c in tree.order}
    whole = np.zeros([widths[c] for c in tree.order])
    for c, table in potentials.items():
        whole = whole + table.reshape([widths[x] if x in tree.bag(c) else 1 for x in tree.order])
    log_sum, given, shares = calibrated(tree, potentials)
    p = np.exp(whole)
    assert np.isclose(log_sum, np.log(p.sum()))
    own = dict(zip(tree.order, p.shape))
    for c in tree.order:
        assert np.allclose(shares[c], over(p / p.sum(), own, tree.bag(c))) and np.allclose(given[c].sum(axis=0), 1)


def test_exact_tables_along_a_tree_have_the_closed_form():
    widths = dict(zip("abcd", (3, 2, 4, 3)))
    p = random_joint(widths, 1)
    m = fit(widths, [Measured(c, 5000 * over(p, widths, c)) for c in (("b", "a"), ("b", "c"), ("d", "c"))], 5000, tolerance=1e-10)
    ab, bc, cd = (over(p, widths, c) for c in (("a", "b"), ("b", "c"), ("c", "d")))
    want = ab[:, :, None, None] * bc[None, :, :, None] * cd[None, None, :, :] / bc.sum(axis=1)[None, :, None, None] / cd.sum(axis=1)[None, None, :, None]
    assert np.allclose(m.table(tuple("abcd")), want, atol=1e-7) and m.gap <= 1e-10 and not m.notes
    assert np.allclose(m.table(("d", "a")), want.sum(axis=(1, 2)).T, atol=1e-7) and np.isclose(m.table(()), 1)


def test_a_loop_has_the_greatest_entropy():
    widths = dict(zip("abc", (2, 3, 3)))
    p = random_joint(widths, 2)
    pairs = list(itertools.combinations("abc", 2))
    m = fit(widths, [Measured(c, 900 * over(p, widths, c)) for c in pairs], 900, tolerance=1e-10)
    raked = np.full(p.shape, 1 / p.size)
    for _ in range(3000):
        for axis in range(3):
            raked = raked * np.nan_to_num(p.sum(axis=axis, keepdims=True) / raked.sum(axis=axis, keepdims=True))
    assert np.allclose(m.table(tuple("abc")), raked, atol=1e-7)


def test_contradictions_part_by_their_variance():
    widths = {"a": 2, "b": 2}
    tables = [Measured(("a",), np.array([600.0, 400.0]), 10.0), Measured(("a", "b"), np.array([[350.0, 350.0], [150.0, 150.0]]), 20.0)]
    m = fit(widths, tables, 1000, slack=1e-4)
    # per entry of a: 600 with variance 100, and the sum of two entries of variance 400
    assert np.isclose(1000 * m.table(("a",))[0], (600 / 100 + 700 / 800) / (1 / 100 + 1 / 800), atol=1.0)
    negative = fit(widths, [Measured(("a",), np.array([1005.0, -5.0]), 10.0)], 1000)
    assert 0 <= negative.table(("a",))[1] < 0.01 and not negative.notes
    partial = fit(widths, [Measured(("a", "b"), np.array([[100.0, np.nan], [np.nan, np.nan]]))], 1000)
    assert np.allclose(1000 * partial.table(("a", "b")), [[100, 300], [300, 300]], atol=1e-2)


def test_many_columns_never_meet_in_one_array():
    widths = {f"c{i}": 8 for i in range(40)}
    rng = np.random.default_rng(5)
    tables = []
    ends = rng.dirichlet(np.full(8, 5.0), 40)
    for i in range(39):
        tables.append(Measured((f"c{i}", f"c{i + 1}"), 1e5 * np.outer(ends[i], ends[i + 1]), 5.0))
    m = fit(widths, tables, 1e5)
    assert np.allclose(m.table(("c0", "c39")), np.outer(ends[0], ends[39]), atol=1e-3)
    with pytest.raises(ValueError):
        fit(widths, [Measured(c, np.ones((8, 8))) for c in itertools.combinations(list(widths)[:12], 2)], 1e5)


def test_drawn_rows_follow_the_model(spark):
    widths = dict(zip("abcd", (2, 3, 4, 3)))
    p = random_joint(widths, 7)
    m = fit(widths, [Measured(c, 1000 * over(p, widths, c)) for c in (("a", "b", "c"), ("c", "d"))], 1000, last=("a",))
    rows = spark.range(200000).selectExpr("id as row", "cast(id % 4 = 0 as int) as _at_a")
    got = sampled(rows, m, ("a",), 3)
    table = got.toPandas()
    have = np.zeros(p.shape)
    np.add.at(have, tuple(table[f"_at_{c}"] for c in "abcd"), 1)
    want = m.table(tuple("abcd"))
    for a in (0, 1):
        assert np.abs(have[a] / have[a].sum() - want[a] / want[a].sum()).sum() / 2 < 0.02
    assert got.repartition(7).toPandas().sort_values("row").reset_index(drop=True).equals(table.sort_values("row").reset_index(drop=True))
    with pytest.raises(ValueError):
        sampled(rows.withColumnRenamed("_at_a", "_at_b"), m, ("b",), 3)


SCHEMA = Schema(numeric={"x": (0, 10, 20, 30)}, categorical={"g": ("a", "b"), "k": ("u", "v"), "w": ("s", "t")}, target="y", positive="1", negative="0", stratify="g", levels=(("x", "k"), ("g", "x")))


@pytest.fixture(scope="module")
def released(spark):
    df = spark.range(24000).selectExpr("if(id % 3 = 0, 'b', 'a') g", "double(pmod(hash(id), 30)) x", "if(pmod(hash(id), 30) < 12, 'u', 'v') k", "if(id % 4 = 0, 's', 't') w", "string(int(pmod(hash(id), 30) < 9 and id % 3 > 0)) y")
    return stage.release(df, SCHEMA, ["a", "b"], epsilon=8.0, n_min=50, seed=2)


def test_a_release_is_met_as_by_the_dense_fit(released):
    model = fitted.fit_release(released, SCHEMA)
    dense = joint.fit(released, SCHEMA)
    assert not model.notes and model.tree.order[-2:] in ([fitted.COHORT, fitted.CLASS], [fitted.CLASS, fitted.COHORT])
    have = model.table((fitted.COHORT, fitted.CLASS, *dense.columns))
    assert np.abs(have - dense.shares).sum() / 2 < 0.01
    worst = fitted.apart(model, released, SCHEMA)
    assert len(worst) == 2 * 3 and worst[0][0] < 0.02 and worst == sorted(worst, key=lambda x: -x[0])


def test_decoded_rows_keep_the_joined_columns_together(spark, released):
    got = decode.draw(spark, released, SCHEMA, 20000, 4, fitted.fit_release(released, SCHEMA)).toPandas()
    assert len(got) == 20000 and got["row"].is_unique
    low = got[got["x"] < 10]
    assert (low["k"] == "u").mean() > 0.9 and (got[got["x"] >= 20]["k"] == "v").mean() > 0.9
    size = released.cohorts.set_index("cohort")["size"]
    assert abs((got["g"] == "b").sum() - 20000 * size["b"] / size.sum()) <= 1
    assert len(decode.decode(spark, released, SCHEMA, 400, seed=1).toPandas()) == 400
