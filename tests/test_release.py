import math

import duckdb
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import counts
from hushtable.plans import registry, release  # noqa: F401

SF = "/root/testdata/sf0.001"
SCHEMA = Schema(numeric={"x": (0, 1, 2)}, categorical={"g": ("a", "b")}, target="y", positive="1", negative="0", stratify="g", levels=(("g",), ("g", "x")))


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.execute(registry.ORACLE[name]).fetchdf()
    want = want[sorted(want.columns)].astype(object).where(want[sorted(want.columns)].notna(), None)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == list(want.columns)
    key = lambda r: tuple(map(str, r))
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-6))
    a, b = sorted(rows(got), key=key), sorted(want.itertuples(index=False, name=None), key=key)
    assert len(a) == len(b) and all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


def test_bins_at_edges_and_outside(spark):
    df = spark.createDataFrame([("0", "a", "1"), ("1", "a ", "0"), ("2", "b", "1"), ("9", "b", "0"), ("-1", "a", "1"), ("oops", "a", "1"), (None, "a", "0"), ("NaN", "b", "1")], "x string, g string, y string")
    got = {(r.cohort, r.col, r.bin): r.n for r in counts.dense_histogram(df, SCHEMA, ["a", "b"]).collect()}
    assert got["a", "x", "0"] == 2 and got["a", "x", "1"] == 1 and got["b", "x", "1"] == 2 and got["b", "g", "a"] == 0


def test_empty_table_has_the_whole_domain(spark):
    df = spark.createDataFrame([], "x double, g string, y string")
    assert {r.n for r in counts.dense_histogram(df, SCHEMA, ["a", "b"]).collect()} == {0}
    assert counts.cell_rates(df, SCHEMA).count() == 2 + 4
    assert counts.absent_categories(df, SCHEMA).count() == 2


def test_noise_is_drawn_once_and_shares_add_up(spark):
    df = spark.createDataFrame([(0.5, "a", "1")] * 50, "x double, g string, y string")
    a, b = (counts.noisy_histogram(df, SCHEMA, ["a", "b"], 1.0, 3).toPandas() for _ in range(2))
    assert a.equals(b) and all(abs(s - 1) < 1e-9 for s in a.groupby(["cohort", "col"])["share"].sum())


def test_schema_is_checked():
    with pytest.raises(ValueError):
        Schema(numeric={"x": (1, 0)}, categorical={}, target="y", positive="1", negative="0", stratify="g")
