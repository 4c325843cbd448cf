import numpy as np
import pandas as pd
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators.stage import Release
from hushtable.streaming import generation

SCHEMA = Schema(numeric={"x": (0, 10, 20), "z": (0.0, 0.5, 2.0)}, categorical={"g": ("a", "b"), "k": ("u", "v", "w")}, target="y", positive="1", negative="0", stratify="g", levels=(("k",),))


@pytest.fixture(scope="module")
def released():
    rng = np.random.default_rng(1)
    marginals = []
    for cohort in ("a", "b"):
        for positive in (True, False):
            for c in generation.quota_columns(SCHEMA):
                shares = [float(b == cohort) for b in SCHEMA.bins("g")] if c == "g" else rng.dirichlet(np.ones(len(SCHEMA.bins(c)))).tolist()
                marginals += [(cohort, positive, c, b, s) for b, s in zip(SCHEMA.bins(c), shares)]
    cohorts = pd.DataFrame([("a", 700, 0.31), ("b", 300, 0.5)], columns=["cohort", "size", "positive_share"])
    cells = pd.DataFrame([(0, "k=u", 400, 0.25), (0, "k=v", 350, 0.5), (0, "k=w", 250, 0.123)], columns=["level", "cell", "support", "rate"])
    return Release(cohorts, pd.DataFrame(marginals, columns=["cohort", "positive", "col", "bin", "share"]), cells, {}, [])


def counted(rows, quotas):
    """Counts of rows by key, class, column and bin, laid out like the quotas."""
    out = {}
    for key in quotas:
        own = rows[rows["key"] == key]
        out[key] = {"n": len(own), "positives": int((own["y"] == "1").sum()), "classes": {}}
        for label in ("1", "0"):
            part = own[own["y"] == label]
            bins = {c: np.clip(np.digitize(part[c], SCHEMA.numeric[c][1:-1]), 0, 9) for c in SCHEMA.numeric} | {c: part[c].map(list(v).index) for c, v in SCHEMA.categorical.items()}
            out[key]["classes"][label] = {c: np.bincount(np.asarray(b, int), minlength=len(SCHEMA.bins(c))).tolist() for c, b in bins.items()}
    return out


def test_splits_add_up():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, per = int(rng.integers(0, 80)), int(rng.integers(1, 30))
        k = int(rng.integers(0, n + 1))
        calls = generation.split_rows(n, k, per)
        assert sum(a for a, _ in calls) == n and sum(b for _, b in calls) == k and all(0 <= b <= a <= per for a, b in calls)
        counts = rng.multinomial(n, [0.5, 0.3, 0.2, 0.0])
        dealt = generation.split_counts(counts, [a for a, _ in calls], rng)
        assert [x.sum() for x in dealt] == [a for a, _ in calls] and np.array_equal(sum(dealt, np.zeros(4, int)), counts)
    assert generation.shared_out([1, 1, 1], 4, rng).tolist().count(1) == 2 and generation.shared_out([0, 0], 3, rng).sum() == 3
    assert {tuple(generation.shared_out([1, 1], 1, rng)) for _ in range(50)} == {(0, 1), (1, 0)}


def test_counts_are_met_exactly(spark, released, tmp_path):
    quotas = generation.cohort_quotas(released, SCHEMA, 331, seed=3, most=120)
    assert sum(q["n"] for q in quotas.values()) == 331 and {k.split("#")[0] for k in quotas} == {"a", "b"} and all(q["n"] <= 120 for q in quotas.values())
    rows = generation.generate(spark, quotas, SCHEMA, str(tmp_path), generation.exact_mock(SCHEMA, 1), per_call=25).toPandas()
    assert len(rows) == 331 and counted(rows, quotas) == quotas
    ended = generation.status(spark, str(tmp_path)).toPandas()
    assert set(ended["reason"]) == {"met"} and ended["rows"].sum() == 331
    again = generation.generate(spark, quotas, SCHEMA, str(tmp_path), None, per_call=25).toPandas()
    assert len(again) == 331


def test_failed_calls_are_asked_again_and_a_cut_off_run_goes_on(spark, released, tmp_path):
    quotas = generation.cohort_quotas(released, SCHEMA, 150, seed=4)
    mock = lambda: generation.exact_mock(SCHEMA, 2, failing=0.3)
    whole = generation.generate(spark, quotas, SCHEMA, str(tmp_path / "whole"), mock(), per_call=20).toPandas()
    assert len(whole) == 150 and counted(whole, quotas) == quotas
    assert generation.generate(spark, quotas, SCHEMA, str(tmp_path / "cut"), mock(), per_call=20, most_calls=1).count() < 150

    def broken(frame):
        raise RuntimeError("the machine is gone")

    with pytest.raises(Exception):
        generation.generate(spark, quotas, SCHEMA, str(tmp_path / "cut"), broken, per_call=20)
    rest = generation.generate(spark, quotas, SCHEMA, str(tmp_path / "cut"), mock(), per_call=20).toPandas()
    order = [*whole.columns]
    assert whole.sort_values(order).reset_index(drop=True).equals(rest[order].sort_values(order).reset_index(drop=True))


def test_low_yield_and_too_many_tries_stop(spark, released, tmp_path):
    quotas = generation.cohort_quotas(released, SCHEMA, 60, seed=5)
    none = generation.generate(spark, quotas, SCHEMA, str(tmp_path / "a"), generation.exact_mock(SCHEMA, 1, failing=1.0), per_call=10, after=3)
    assert none.count() == 0 and {r["reason"] for r in generation.status(spark, str(tmp_path / "a")).collect()} == {"low yield"}
    some = generation.generate(spark, quotas, SCHEMA, str(tmp_path / "b"), generation.exact_mock(SCHEMA, 1, failing=1.0), per_call=10, after=10**6)
    assert some.count() == 0
    for r in generation.status(spark, str(tmp_path / "b")).collect():
        assert r["reason"] == "out of tries" and r["rows"] == 0 and r["calls"] >= 3 * (r["of"] // 10 + 1)


def test_cells(spark, released, tmp_path):
    quotas = generation.cell_quotas(spark, released, SCHEMA, 0, 200, seed=6)
    assert [q["n"] for q in quotas.values()] == [80, 70, 50]
    assert quotas["k=u#0"]["positives"] == 20 and quotas["k=w#0"]["positives"] in (6, 7)
    rows = generation.generate(spark, quotas, SCHEMA, str(tmp_path), generation.exact_mock(SCHEMA, 3), per_call=30).toPandas()
    assert counted(rows, quotas) == quotas and (rows.loc[rows["key"] == "k=v#0", "k"] == "v").all()
    import dataclasses

    part = dataclasses.replace(released, cells=released.cells.iloc[:1])
    with pytest.raises(ValueError, match="k "):
        generation.cell_quotas(spark, part, SCHEMA, 0, 200)
    assert list(generation.cell_quotas(spark, part, SCHEMA, 0, 200, uncovered=True)) == ["k=u#0"]
    with pytest.raises(ValueError):
        generation.cell_quotas(spark, released, SCHEMA, 1, 200)
