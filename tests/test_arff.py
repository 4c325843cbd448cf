import pytest

from hushtable.sources.arff import read_arff

TEXT = """% about the table
@RELATION 'some people'
@attribute age NUMERIC
@ATTRIBUTE 'work class' {'Private work', gov, "self, own"}
@attribute n integer % how many
@attribute note string

@data
% a comment
39.5,'Private work',3,'said: it\\'s, fine'
?, gov ,?,plain
1e3,"self, own",-2,?
"""


def test_rows_of_a_written_file(spark, tmp_path):
    (tmp_path / "t.arff").write_text(TEXT)
    rows, declared = read_arff(spark, str(tmp_path / "t.arff"))
    assert rows.dtypes == [("age", "double"), ("work class", "string"), ("n", "bigint"), ("note", "string")]
    assert [tuple(r) for r in rows.collect()] == [(39.5, "Private work", 3, "said: it's, fine"), (None, "gov", None, "plain"), (1000.0, "self, own", -2, None)]
    assert declared == {"work class": ["Private work", "gov", "self, own"]}


def test_round_trip_of_many_rows(spark, tmp_path):
    lines = ["@relation r", "@attribute id integer", "@attribute v real", "@data", *(f"{i},{i / 8}" for i in range(20_000))]
    (tmp_path / "t.arff").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows, _ = read_arff(spark, str(tmp_path / "t.arff"))
        assert sorted((r.id, r.v) for r in rows.collect()) == [(i, i / 8) for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line", ["1,2,3", "1", "{0 1}"])
def test_odd_rows_are_refused(spark, tmp_path, line):
    (tmp_path / "t.arff").write_text(f"@attribute a real\n@attribute b real\n@data\n1,2\n{line}\n")
    rows, _ = read_arff(spark, str(tmp_path / "t.arff"))
    with pytest.raises(Exception, match="values|sparse"):
        rows.collect()


def test_odd_headers_are_refused(spark, tmp_path):
    for k, text in enumerate(("1,2\n", "@attribute a relational\n@data\n1\n", "@attribute a\n@data\n")):
        (tmp_path / f"{k}.arff").write_text(text)
        with pytest.raises(ValueError):
            read_arff(spark, str(tmp_path / f"{k}.arff"))
