import numpy as np
import pytest

from hushtable.functions.bins import Schema
from hushtable.operators import decode, stage
from hushtable.sources.documents import read_release, write_release
from hushtable.sources.generated import parse_generated

SCHEMA = Schema(numeric={"x": (0, 10, 20), "z": (0.0, 0.5, 1.5)}, categorical={"g": ("a", "b")}, target="y", positive="1", negative="0", stratify="g", levels=(("g",),))


@pytest.fixture(scope="module")
def released(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'b', 'a') g", "double(id % 21) x", "double(id % 4) / 4 z", "string(int(id % 5 = 0)) y")
    return stage.release(df, SCHEMA, ["a", "b"], n_min=50, seed=2)


def test_drawn_rows_follow_the_release(spark, released):
    got = decode.draw(spark, released, SCHEMA, 20000, 1).toPandas()
    assert len(got) == 20000 == got["row"].nunique()
    size = released.cohorts.set_index("cohort")
    for c in "ab":
        part = got[got["g"] == c]
        assert abs(len(part) - 20000 * size["size"][c] / size["size"].sum()) <= 1
        assert abs((part["y"] == "1").mean() - size["positive_share"][c]) < 0.001
        want = released.marginals.query("cohort == @c and not positive and col == 'x' and bin == '0'")["share"].item()
        assert abs((part.loc[part["y"] == "0", "x"] < 10).mean() - want) < 0.02
    assert got["x"].between(0, 20).all() and (got["x"] % 1 == 0).all() and got["z"].between(0, 1.5).all() and got["x"].max() == 20
    again = decode.draw(spark, released, SCHEMA, 20000, 1).toPandas()
    assert got.sort_values("row").reset_index(drop=True).equals(again.sort_values("row").reset_index(drop=True))


def test_decoded_rows_are_as_many_as_asked(spark, released):
    got = decode.decode(spark, released, SCHEMA, 300, seed=4).toPandas()
    assert len(got) == 300
    assert np.isclose((got["g"] == "b").mean(), released.cohorts.set_index("cohort")["size"]["b"] / released.cohorts["size"].sum(), atol=0.01)


def test_generated_text(spark):
    text = "Sure!\nx,z,g,y\n5,0.5,a,1\n 6 , 0.1 ,b,0\n99,0.5,a,1\nfive,0.5,a,1\n5,0.5,c,1\n5,0.5,a,maybe\n5,0.5,a\nx,z,g,y\n7,1.5,b,0\nbye"
    numbered = Schema(numeric={"x": (0, 20)}, categorical={"k": ("1", "2")}, target="y", positive="1", negative="0", stratify="k")
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no header\n1,2,3,4"), (5, "y,x,z\r\n1,3,0.2\r\n")], "id int, text string")
    got = sorted(tuple(r) for r in parse_generated(df, SCHEMA, key="id").select("id", "x", "z", "y").collect())
    assert got == [(1, 5.0, 0.5, "1"), (1, 6.0, 0.1, "0"), (1, 7.0, 1.5, "0"), (5, 3.0, 0.2, "1")]
    two = spark.createDataFrame([("x,k,y\n1,2.0,1\n1,,1\n1,3.0,1",)], "text string")
    assert [r.k for r in parse_generated(two, numbered).collect()] == ["2"]
    with pytest.raises(ValueError):
        parse_generated(df, SCHEMA, key="y")


def test_release_document(spark, released, tmp_path):
    path = f"file://{tmp_path}/release"
    write_release(spark, released, path)
    assert read_release(spark, path).to_json() == released.to_json()
    with pytest.raises(Exception):
        write_release(spark, released, path)
