from hushtable.functions.bins import Schema
from hushtable.operators.audit import emitted_counts
from hushtable.streaming import quotas

SCHEMA = Schema(numeric={"x": (0.0, 2.0, 4.0)}, categorical={"c": ("a", "b")}, target="y", positive="P", negative="N", stratify="c")


def test_counts_go_on_after_a_restart(spark, tmp_path):
    first = spark.createDataFrame([(1.0, "a", "P"), (3.0, "a", "N"), (9.0, "b", "P")], "x double, c string, y string")
    more = spark.createDataFrame([(1.5, "a", "P"), (None, "b", "N")], first.schema)
    owed = spark.createDataFrame([("a", True, 3), ("a", False, 1), ("b", True, 0), ("b", False, 5)], "cohort string, positive boolean, n long")
    key = lambda df: sorted(tuple(r) for r in df.select("cohort", "positive", "col", "bin", "n").collect())
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    assert key(quotas.running_counts(rows, SCHEMA, ["a", "b"], "seen1", str(tmp_path / "state"))) == key(emitted_counts(first, SCHEMA, ["a", "b"]))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = quotas.running_counts(rows, SCHEMA, ["a", "b"], "seen1", str(tmp_path / "state"))
    assert key(got) == key(emitted_counts(first.union(more), SCHEMA, ["a", "b"]))
    assert {(r.cohort, r.positive): r.owed for r in quotas.still_owed(got, owed).collect()} == {("a", True): 1, ("a", False): 0, ("b", True): 0, ("b", False): 4}
