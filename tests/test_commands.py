import json

import pytest

import hushtable
from hushtable import commands
from hushtable.functions.bins import Schema
from hushtable.sources import sinks
from hushtable.sources.documents import read_release
from hushtable.sources.schemas import from_document, load_schema, to_document
from hushtable.sources.tables import read_table

TEXT = """
from hushtable.functions.bins import Schema
from beside import EDGES
SCHEMA = Schema(numeric={"x": EDGES}, categorical={"g": ("a", "b"), "k": ("u", "v")}, target="y", positive="1", negative="0", stratify="g", levels=(("k",),))
"""


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("commands")
    (at / "beside.py").write_text("EDGES = (0, 10, 20)\n")
    (at / "schema.py").write_text(TEXT)
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'b', 'a') g", "double(pmod(hash(id), 20)) x", "if(pmod(hash(id), 20) < 8, 'u', 'v') k", "string(int(pmod(hash(id), 20) < 5)) y")
    df.write.option("header", True).csv(str(at / "data.csv"))
    return at


def test_schema_files(place, tmp_path):
    schema = load_schema(str(place / "schema.py"))
    assert schema.numeric["x"] == (0, 10, 20) and schema.levels == (("k",),)
    (tmp_path / "s.json").write_text(json.dumps(to_document(schema)))
    assert load_schema(str(tmp_path / "s.json")) == schema
    (tmp_path / "none.py").write_text("X = 1\n")
    for wrong in (tmp_path / "none.py", tmp_path / "gone.py"):
        with pytest.raises(ValueError):
            load_schema(str(wrong))
    with pytest.raises(ValueError):
        from_document({"numeric": {}, "colour": 1})


def test_csv_keeps_words_and_reports_what_is_lacking(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nNone,NA\n,nan\n")
    rows = [tuple(r) for r in read_table(spark, str(tmp_path / "t.csv"), ["b", "a"]).collect()]
    assert rows[0] == ("NA", "None") and rows[1][0] == "nan"
    with pytest.raises(ValueError, match="c"):
        read_table(spark, str(tmp_path / "t.csv"), ["a", "c"])


def test_run_and_its_parts(spark, place, capsys):
    out = str(place / "run")
    base = ["--schema", str(place / "schema.py")]
    assert commands.main(["run", *base, "--data", str(place / "data.csv"), "--ids", "id", "--out", out, "--n-rows", "200", "--epsilon", "4", "--bound-epsilon", "2", "--all-forms"], spark) == 0
    released = read_release(spark, f"{out}/release")
    audit = sinks.read_document(spark, f"{out}/audit")
    assert audit["total"] <= 4 + 1e-9 and audit["sealed"] and released.audit == audit
    manifest = sinks.read_document(spark, f"{out}/manifest")
    assert manifest["privacy_cost"] == 0 and not manifest["private_data_read"] and not manifest["notes"] and manifest["mean_distance"] < 0.05
    rows = read_table(spark, manifest["files"][0])
    assert rows.count() == 200 and set(rows.columns) == {"g", "x", "k", "y"}
    report = sinks.read_document(spark, f"{out}/bound")
    assert set(report["worst"]) == {"synthetic", "ceiling", "floor"} and abs(report["epsilon_per_row"] - audit["total"] - 2) < 1e-9
    record = sinks.read_document(spark, f"{out}/record/json")
    assert record["values"]["synthetic rows"] == 200 and "- verdict" in "\n".join(r[0] for r in spark.read.text(f"{out}/record/markdown").collect())
    again = str(place / "decoded")
    assert commands.main(["decode", *base, "--release", f"{out}/release", "--out", again, "--n-rows", "50", "--draws", "2", "--no-select"], spark) == 0
    assert [read_table(spark, f"{again}/decoded_{k}.csv").count() for k in (0, 1)] == [50, 50]
    made = str(place / "generated")
    assert commands.main(["generate", *base, "--release", f"{out}/release", "--out", made, "--n-rows", "60"], spark) == 0
    assert read_table(spark, f"{made}/generated.csv").count() == 60


def test_refusals(spark, place, capsys):
    base = ["--schema", str(place / "schema.py"), "--data", str(place / "data.csv")]
    assert commands.main(["release", *base, "--out", str(place / "r1"), "--n-min", "10"], spark) == 2
    assert commands.main(["release", *base, "--out", str(place / "r2"), "--epsilon", "4", "--per-person", "5"], spark) == 2
    assert commands.main(["release", "--schema", str(place / "schema.py"), "--data", str(place / "data.csv"), "--out", str(place / "r3"), "--n-min", "100000"], spark) == 2
    said = capsys.readouterr().err
    assert said.count("refused: ") == 3 and "over 10" in said
    odd = spark.createDataFrame([("z", 1.0, "u", "1")], "g string, x double, k string, y string")
    odd.write.parquet(str(place / "odd"))
    assert commands.main(["release", "--schema", str(place / "schema.py"), "--data", str(place / "odd"), "--out", str(place / "r4")], spark) == 2
    assert "undeclared" in capsys.readouterr().err


def test_records_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "RECORD_ROWS", 3)
    with pytest.raises(ValueError):
        sinks.write_record(spark, {}, {"t": spark.range(4)}, str(tmp_path / "a"))
    sinks.write_record(spark, {"a|b": "x\ny"}, {"t": spark.range(2)}, str(tmp_path / "b"), True)
    assert sinks.read_document(spark, str(tmp_path / "b/json"))["tables"]["t"]["rows"] == [[0], [1]]
    assert spark.read.option("header", True).csv(str(tmp_path / "b/t.csv")).count() == 2


def test_public_names():
    assert all(hasattr(hushtable, name) for name in hushtable.__all__) and hushtable.Schema is Schema


def test_cells_leave_out_rows_with_a_missing_number(spark):
    """A quarter of the rows has no number: they are in no cohort, and in no cell either."""
    schema = Schema(numeric={"x": (0, 10, 20)}, categorical={"g": ("a", "b")}, target="y", positive="1", negative="0", stratify="g", levels=(("x",),))
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') g", "if(id % 4 = 3, null, double(id % 10)) x", "string(int(id % 5 = 0)) y")
    made = hushtable.release(df, schema, ["a", "b"], epsilon=8.0, n_min=50, seed=1)
    assert list(made.cells["cell"]) == ["x[0,10)"] and abs(made.cells["support"].sum() - 3000) < 60
