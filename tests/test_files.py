import uuid
from pathlib import Path

import pytest

from broadloom.operators import selectors as s
from broadloom.operators.binning import BinRule
from broadloom.plans import flows
from broadloom.session import StageRegistry, discard, shared_folder, shared_path, stage
from broadloom.sources import files


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('K,V,T\n1, 2.5 ,"say ""hi"", all"\n2,NA,NA\n3,,  x y \n')
    rows = files.read_csv(spark, str(path), "K int, V double, T string").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, 'say "hi", all'), (2, None, None), (3, None, "x y")]
    inferred = files.read_csv(spark, str(path))
    assert dict(inferred.dtypes) == {"K": "int", "V": "double", "T": "string"}


def test_tab_rules(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("K\tT\n1\t a,b \n2\tNA\n3\t\n")
    rows = files.read_tab(spark, str(path), "K int, T string").collect()
    assert [tuple(r) for r in rows] == [(1, "a,b"), (2, None), (3, None)]


@pytest.mark.parametrize("sep, read", [(",", files.read_csv), ("\t", files.read_tab)])
def test_text_survives_the_roundtrip(spark, sep, read):
    rows = [(1, 'q "x", y'), (2, None), (3, "plain\\slash"), (4, "tab\tinside")]
    path = shared_path(spark, "text")
    files.write_csv(spark.createDataFrame(rows, "k int, t string"), path, sep)
    assert sorted(tuple(r) for r in read(spark, path, "k int, t string").collect()) == rows


def test_line_breaks_and_repeated_headers(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('A,A,,A.1,a\n1,"two\nlines, ""q""",x,y,5\n2,NA,,"\n",6\n')
    back = files.read_csv(spark, str(path), line_breaks=True)
    assert back.columns == ["A", "A.2", "X3", "A.1", "a.3"]
    rows = [tuple(r) for r in back.collect()]
    assert rows[0] == (1, 'two\nlines, "q"', "x", "y", 5) and rows[1][:3] == (2, None, None)
    by_place = files.read_csv(spark, str(path), "k int, t string, u string, v string, w int", line_breaks=True)
    assert by_place.columns == list("ktuvw") and by_place.first().t == 'two\nlines, "q"'
    texts = [(1, "a\nb"), (2, '"\n"'), (3, "c,\r\nd")]
    out = shared_path(spark, "broken")
    files.write_csv(spark.createDataFrame(texts, "k int, t string"), out)
    assert sorted(tuple(r) for r in files.read_csv(spark, out, "k int, t string", line_breaks=True).collect())[:2] == texts[:2]
    assert files.repaired_names(["x", "x", "X", None, " ", "x.1"]) == ["x", "x.2", "X.3", "X4", "X5", "x.1"]


def test_text_sink(spark):
    path = shared_path(spark, "list")
    files.write_text(spark.createDataFrame([("a,\nb",)], "code string"), path)
    assert "".join(p.read_text() for p in Path(path).glob("part-*")) == "a,\nb\n"


def test_named_tables(spark, tmp_path):
    for n in (3, 5):  # a later version replaces the earlier one
        files.save_tables({"a": spark.range(n), "b": spark.range(2)}, str(tmp_path))
    back = files.load_tables(spark, str(tmp_path), ["a", "b"])
    assert back["a"].count() == 5 and back["b"].count() == 2


def test_stage_cuts_lineage_and_keeps_the_schema(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k").groupBy("k").count()
    staged = stage(df, "t")
    assert staged.schema.names == df.schema.names
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect()))
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and shared_folder(spark) in plan.replace("file:", "")


def test_discarded_stages_are_gone(spark):
    one, two = stage(spark.range(3), "one"), stage(spark.range(4), "two")
    discard(one, spark.range(1))
    assert two.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(one.staged_at).count()


def test_a_rerun_finds_finished_stages(spark, tmp_path):
    job = f"job-{uuid.uuid4().hex}"
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    wide = lambda: spark.read.parquet(source).selectExpr("id", "id * 2 AS twice")
    first = StageRegistry(spark, job).keep("wide", wide())
    again = StageRegistry(spark, job).keep("wide", wide())
    assert again.staged_at == first.staged_at and again.count() == 10
    other = StageRegistry(spark, job).keep("wide", wide().where("id > 4"))  # another plan replaces it
    assert other.staged_at != first.staged_at and other.count() == 5
    assert not Path(first.staged_at.replace("file:", "")).exists()
    registry = StageRegistry(spark, job)
    registry.keep("narrow", spark.read.parquet(source), version="2")
    assert set(registry.finished()) == {"wide", "narrow"}
    spark.range(20).write.mode("overwrite").parquet(source)  # new files are another source
    assert registry.keep("narrow", spark.read.parquet(source), version="2").count() == 20
    # a stage whose write did not end does not count
    Path(f"{registry.keep('narrow', spark.read.parquet(source), version='2').staged_at}/_SUCCESS".replace("file:", "")).unlink()
    assert set(registry.finished()) == {"wide"}
    assert registry.keep("narrow", spark.read.parquet(source), version="2").count() == 20
    registry.release("wide")
    assert set(registry.finished()) == {"narrow"}
    registry.close()
    assert registry.finished() == {}


def test_master_table_flow(spark):
    rows = [(1, "X", "a", "p q", 1.0), (2, "Y", None, None, None), (3, "Z", "b", "p q", 2.0)]
    df = spark.createDataFrame(rows, "id int, cls string, code string, place string, v double")
    out = flows.master_table(df, "id", "cls", [BinRule("code", {"A": ["a"]})], {"XY": ["X", "Y"]})
    assert out.columns == [
        "id", "TARGET_XY", "TARGET_Z", "v", "CODE_A", "CODE_NULL", "CODE_UNKNOWN", "PLACE_NULL", "PLACE_P_Q",
    ]
    assert sorted(map(tuple, out.collect())) == [
        (1, 1, 0, 1.0, 1, 0, 0, 0, 1), (2, 1, 0, -1.0, 0, 0, 1, 1, 0), (3, 0, 1, 2.0, 0, 1, 0, 0, 1),
    ]


def test_correlation_cut_flow(spark):
    rows = [(i, float(i), 2.0 * i, float(i % 3), "t") for i in range(30)]
    df = spark.createDataFrame(rows, "KEY_ID long, a double, b double, c double, word string")
    cut = flows.correlation_cut(df, s.starts_with("key"), "LIB.T")
    assert {r.field: r.final_verdict for r in cut.verdicts.collect()} == {"a": "KEEP", "b": "DROP", "c": "KEEP"}
    assert cut.statement.first()[0] == "SELECT \nKEY_ID,\na,\nc\nFROM LIB.T"
    assert flows.project(df, cut.manifest).columns == ["KEY_ID", "a", "c"]
    # a wider scope keeps columns that took no part in the correlation
    wide = flows.correlation_cut(df, s.starts_with("key"), "LIB.T", scope=~s.starts_with("key"), keep=["b"])
    assert [r.field for r in wide.manifest.orderBy("position").collect()] == ["KEY_ID", "a", "b", "c", "word"]


def test_share_columns_by_convention(spark):
    names = ["ALL_WON_DTL_REVN_COMP_SUM_C", "A_WON_DTL_COMP_SUM_C", "A_WON_DTL_COMP_SUM_C_FLG", "A_WON_DTL_INDIV"]
    df = spark.createDataFrame([(1, 2, 3, 4)], names)
    assert flows.share_columns().names(df) == ["A_WON_DTL_COMP_SUM_C"]
