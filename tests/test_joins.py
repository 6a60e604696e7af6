import pytest
from pyspark.sql import functions as F

from broadloom.operators import joins, ranking


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "c", 30)], "id int, k string, v int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, w int")


def test_natural_join_and_missing_keys(left, right):
    assert rows(joins.natural_join(left, right)) == [("a", 1, 10, 1)]
    safe = joins.natural_join(left, right, null_safe=True)
    assert safe.columns == ["id", "k", "v", "w"]
    assert rows(safe) == [(1, "a", 10, 1), (2, None, 20, 2)]
    assert rows(joins.natural_join(left, right, "left", True))[2] == (3, "c", 30, None)
    with pytest.raises(ValueError, match="no shared column"):
        joins.natural_join(left.select("id"), right)


def test_colliding_names_get_suffixes(spark, left):
    other = spark.createDataFrame([(1, 7)], "id int, v int")
    out = joins.keyed_join(left, other, ["id"])
    assert out.columns == ["id", "k", "v_x", "v_y"] and rows(out) == [(1, "a", 10, 7)]


def test_lookup_join(left, right):
    out = joins.lookup_join(left, right.withColumnRenamed("k", "name"), "k", "name")
    assert {r["id"]: r["w"] for r in out.collect()} == {1: 1, 2: None, 3: None}


def test_complement_restrict_and_flag(spark, left):
    taken = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert {r.id for r in joins.complement(left, taken, "id").collect()} == {2, 3}
    assert [r.id for r in joins.restrict(left, taken, "id").collect()] == [1]
    flagged = joins.membership_flag(left, taken, "id", "flg")
    assert {r.id: r.flg for r in flagged.collect()} == {1: 1, 2: 0, 3: 0}
    again = joins.membership_flag(flagged, spark.createDataFrame([(None,), (2,)], "id int"), "id", "flg")
    assert again.columns == flagged.columns and {r.id: r.flg for r in again.collect()} == {1: 0, 2: 1, 3: 0}


def test_replaced_columns(spark, left):
    fresh = spark.createDataFrame([("1", 11, 5), ("2", 22, 6)], "id string, v int, extra int")
    out = joins.replace_columns(left, fresh, "id")
    assert {r.id: (r.k, r.v, r.extra) for r in out.collect()} == {
        "1": ("a", 11, 5), "2": (None, 22, 6), "3": ("c", None, None),
    }
    plain = joins.replace_columns(left, fresh.selectExpr("int(id) id", "v"), "id")
    assert plain.schema["id"].dataType.simpleString() == "int" and plain.count() == 3
    stale = joins.replace_columns(left, fresh.select("id", "extra"), "id", stale=["k", "not_there"])
    assert stale.columns == ["id", "v", "extra"]


def test_unique_keys(spark, left):
    joins.assert_unique(left, "id")
    with pytest.raises(ValueError, match="not unique"):
        joins.assert_unique(left.union(left), "id")


def test_hot_keys_give_whole_results(spark):
    # one key holds a third of the rows, and so does the missing key
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string")))
    df = spark.range(n).select("id", key.alias("k"))
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = joins.natural_join(df, sizes, null_safe=True)
    assert joined.count() == n and joined.where("k = 'hot'").select("n").distinct().collect()[0].n == n // 3
    members = df.where("k = 'hot'").select("k")
    assert joins.membership_flag(df, members, "k", "f").agg(F.sum("f")).first()[0] == n // 3
    assert joins.complement(df, members, "k").count() == n - n // 3
    assert joins.restrict(df, members, "k").count() == n // 3
    assert ranking.top_per(df, ["k"], [F.desc("id")], 2).where("k = 'hot'").count() == 2
    assert ranking.first_per(df.where("k = 'hot'"), ["k"], ["id"]).first()["id"] == 0


# --- ranking ---


def test_first_row_by_order_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    out = ranking.first_per(df, ["k"], ["o"])
    assert out.columns == ["k", "o", "v"] and rows(out) == [("a", 1, "y"), ("b", 5, None)]


def test_missing_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert [r.v for r in ranking.ordered(df, up=["v"]).collect()] == [1, 2, None]
    assert [r.v for r in ranking.ordered(df, down=["v"]).collect()] == [2, 1, None]


def test_chunks_and_taxonomy(spark):
    fields = spark.createDataFrame([(i, f"F{i:02d}") for i in range(25)], "ordinal int, field string")
    typed = ranking.taxonomy(fields, [("starts", "F1", "TENS")], "OTHER")
    chunked = ranking.numbered_chunks(typed, ["type", "ordinal"], 10)
    sizes = {r.chunk: r["count"] for r in chunked.groupBy("chunk").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}
    # OTHER comes first by name and fills 15 places
    assert {r.field for r in chunked.where("chunk = 1 and type = 'TENS'").collect()} == {f"F1{i}" for i in range(5)}


def test_stacked_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "y int")
    assert rows(ranking.stacked([a, b])) == [(1, 2), (None, 3)]


def test_cardinality_ignores_missing(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", 2)], "s string, i int")
    for exact in (True, False):
        got = {r.field: r.levels for r in ranking.cardinality(df, ["s", "i"], exact).collect()}
        assert got == {"s": 2, "i": 2}


def test_rule_accuracy(spark):
    data = [("A", "A"), ("A", "B"), ("A", None), ("B", None)]
    df = spark.createDataFrame(data, "actual string, guess string")
    got = {r.actual: r.asDict() for r in ranking.rule_accuracy(df, "actual", "guess").collect()}
    assert got["A"]["prct"] == pytest.approx(1 / 3) and got["A"]["prct_pos"] == 0.5
    assert got["B"]["hits"] is None and got["B"]["prct"] is None and got["B"]["unknown"] == 1


def test_a_hot_key_is_split_at_run_time(spark):
    """Beyond the broadcast threshold the partition of a hot key is split, and no row is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 60_000
        facts = spark.range(n, numPartitions=8).select(
            "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("pad")
        )
        lookup = spark.range(n, numPartitions=8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = joins.natural_join(facts, lookup)
        got = joined.select(F.count("pad").alias("n"), F.sum("w").alias("w"), F.max("pad").isNull().alias("none"))
        want = n // 3 * 14 + 2 * sum(i for i in range(n) if i % 3)
        assert [tuple(r) for r in got.collect()] == [(n, want, False)]
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
