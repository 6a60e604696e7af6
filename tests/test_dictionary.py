"""Numbering, dictionaries, sparse rows and merged profiles."""

import random

import pytest
from pyspark.sql import functions as F

from broadloom.operators import dictionary, encoding, forests, numbering, profiles


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_numbers_span_partitions(spark, part_rows):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randint(0, 50) if draw.random() < 0.9 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: r.position for r in numbering.numbered(df, ["g"], ["v", "i"], part_rows=part_rows).collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in order] == list(range(len(order)))
    whole = numbering.numbered(df, [], ["i"], "n", part_rows=part_rows).collect()
    assert sorted(r.n for r in whole) == list(range(400)) and all(r.n == r.i for r in whole)
    assert numbering.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_levels_and_numbers_of_values(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "b", "y"), (5, "é", "x")]
    df = spark.createDataFrame(rows, "k int, p string, q string")
    table = dictionary.levels(df, ["p", "q"], part_rows=2)
    assert sorted(map(tuple, table.collect())) == [("p", "a", 0), ("p", "b", 1), ("p", "é", 2), ("q", "x", 0), ("q", "y", 1)]
    numbers = {r.k: r.n for r in dictionary.with_level(df, "p", table, "n").collect()}
    assert numbers == {1: 1, 2: 0, 3: None, 4: 1, 5: 2}
    codes = {r.k: (r.width, r.columns) for r in dictionary.sparse_codes(df, "k", ["p", "q"]).collect()}
    assert codes == {1: (5, [1, 3]), 2: (5, [0]), 3: (5, [3]), 4: (5, [1, 4]), 5: (5, [2, 3])}
    vector = dictionary.model_vectors(dictionary.sparse_codes(df, "k", ["p", "q"])).where("k = 1").first().features
    assert (vector.size, vector.indices, vector["values"]) == (5, [1, 3], [1.0, 1.0])
    empty = dictionary.sparse_codes(spark.createDataFrame([(1, None)], "k int, p string"), "k", ["p"]).collect()
    assert [tuple(r) for r in empty] == [(1, 0, [])]


def test_sparse_rows_are_the_one_hot_columns(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice("abcd"), draw.choice(["u", "v", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, p string, q string")
    wide = encoding.one_hot(df, ["p", "q"], {"p": list("abcd"), "q": ["u", "v"]}, clean=False)
    want = {r["k"]: [i for i, c in enumerate(wide.columns[1:]) if r[c]] for r in wide.collect()}
    assert {r.k: r.columns for r in dictionary.sparse_codes(df, "k", ["p", "q"]).collect()} == want


def test_a_million_levels_encode(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    with pytest.raises(ValueError, match="sparse_codes"):
        encoding.levels_of(df, ["name"])
    table = dictionary.levels(df, ["name"])
    codes = dictionary.sparse_codes(df, "id", ["name"], table)
    seen = codes.agg(F.count("*"), F.max("width"), F.countDistinct(F.col("columns")[0]), F.max(F.col("columns")[0]), F.max(F.size("columns"))).first()
    assert tuple(seen) == (n, n, n, n - 1, 1)
    # numbers follow the names: neighbours by name are neighbours by number
    assert table.where("level IN (0, 999999)").orderBy("level").select("val").collect() == df.agg(F.min("name"), F.max("name")).select(F.explode(F.array("`min(name)`", "`max(name)`"))).collect()


def test_classes_are_numbered_without_an_indexer(spark):
    rows = [(i, f"class {i % 3}", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, size string, x double")
    table = forests.model_table(df, "id", "size", ["x"], True)
    assert {r.id: r.label for r in table.collect()} == {i: float(i % 3) for i in range(30)}
    broken = spark.createDataFrame([(1, None, 1.0)], "id long, size string, x double")
    with pytest.raises(Exception, match="a missing class in size"):
        forests.model_table(broken, "id", "size", ["x"], True).collect()


def test_merged_profiles_are_profiles_of_all(spark):
    rows = [(i, "old" if i < 700 else "new", i % 40, f"t{i}", None if i % 7 else float(-i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, part string, small int, name string, gaps double")
    fields = ["id", "small", "name", "gaps"]
    stored = profiles.profile(df, fields, by="part")
    assert stored.count() == 8
    whole = {r.field: r for r in profiles.estimates(profiles.profile(df, fields)).collect()}
    merged = profiles.merged(stored)
    again = profiles.merged(merged.unionByName(profiles.profile(df, fields)).where("field != 'id'").unionByName(merged.where("field = 'id'")))
    for r in profiles.estimates(merged).collect():
        w = whole[r.field]
        assert (r.rows, r.missing, r.least, r.most, r.first_text, r.last_text) == (1000, w.missing, w.least, w.most, w.first_text, w.last_text)
        assert r.distinct_estimate == pytest.approx(w.distinct_estimate, rel=0.03)
    assert {r.field: r.rows for r in again.collect()} == {"id": 1000, "small": 2000, "name": 2000, "gaps": 2000}
    assert {r.field for r in profiles.exceeds(merged, 100).collect()} == {"id", "name", "gaps"}
    assert profiles.merged(profiles.profile(df.limit(0), fields, by="part")).count() == 0
