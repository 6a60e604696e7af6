import random

import pytest

from broadloom.operators import knockout, manifest


def pairs(spark, rows):
    return spark.createDataFrame(rows, "x string, x_ord int, y string, y_ord int, r double")


def catalog(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "ordinal int, field string")


def test_first_by_name_knocks_out_and_chains_are_kept(spark):
    table = pairs(
        spark,
        [
            ("z", 0, "m", 1, 0.9), ("z", 0, "a", 2, -0.95), ("m", 1, "a", 2, 0.99),
            ("z", 0, "b", 3, 0.5), ("m", 1, "b", 3, None), ("a", 2, "b", 3, float("nan")),
        ],
    )
    out = knockout.knock_outs(knockout.correlated(table))
    got = {r.field: (r.knocked_out_by, r.r) for r in out.collect()}
    # a is beaten by m although m itself is beaten by z
    assert got == {"m": ("z", 0.9), "a": ("m", 0.99)}
    words = {r.field: r.verdict for r in knockout.verdicts(catalog(spark, "zmabk"), out).collect()}
    assert words == {"z": "KEEP", "m": "DROP", "a": "DROP", "b": "KEEP", "k": "KEEP"}


def test_signed_threshold(spark):
    table = pairs(spark, [("a", 0, "b", 1, -0.999), ("a", 0, "c", 2, 0.995), ("b", 1, "c", 2, 0.9)])
    assert [(r.x, r.y) for r in knockout.correlated(table, 0.85, 0.99).collect()] == [("a", "c")]
    assert knockout.correlated(table).count() == 3


def test_names_that_paste_alike_stay_apart(spark):
    table = pairs(spark, [("Z_A", 0, "B", 3, 0.9), ("Z", 1, "A_B", 2, 0.9)])
    assert knockout.correlated(table).count() == 2


def test_drop_list_goes_before_keep_list(spark):
    table = knockout.verdicts(catalog(spark, "abcd"), spark.createDataFrame([("b", "a", 0.9)], "field string, knocked_out_by string, r double"))
    final = knockout.overridden(table, drop=["a", "c"], keep=["b", "c"])
    assert {r.field: r.final_verdict for r in final.collect()} == {"a": "DROP", "b": "KEEP", "c": "DROP", "d": "KEEP"}


def test_78_names_make_lines_of_14_15_and_4(spark):
    names = spark.createDataFrame([(f"F{i:03d}",) for i in range(78)], "field string")
    lines = manifest.chunked_list(names, 15)
    rows = lines.orderBy("line").collect()
    assert [r.code.count(",") + 1 for r in rows] == [14, 15, 15, 15, 15, 4]
    text = manifest.joined_lines(lines).first()[0]
    assert text.startswith("'F000', 'F001'") and text.count("\n") == 5 and text.endswith("'F077'")


def test_manifest_statement(spark):
    ids = catalog(spark, ["KEY_B", "KEY_A"])
    table = manifest.manifest(ids, catalog(spark, ["Z", "A"]), "LIB.TABLE")
    assert manifest.select_statement(table).first()[0] == "SELECT \nKEY_B,\nKEY_A,\nZ,\nA\nFROM LIB.TABLE"
    assert manifest.vector_text(catalog(spark, ["Z", "A"])).first()[0] == "c('Z','A')"


def test_relevance_leaves_dropped_fields_out(spark):
    table = pairs(spark, [("a", 0, "t", 2, -0.5), ("b", 1, "t", 2, 0.2), ("a", 0, "b", 1, 0.9)])
    dropped = spark.createDataFrame([("b",)], "field string")
    assert [tuple(r) for r in knockout.target_relevance(table, "t", dropped).collect()] == [("a", -0.5, 0.5)]


def greedy_by_hand(edges):
    fields = sorted({f for e in edges for f in e})
    standing, out = [], {}
    for y in fields:
        by = [x for x in standing if (x, y) in edges]
        if by:
            out[f"f{y}"] = f"f{by[0]}"
        else:
            standing.append(y)
    return out


@pytest.mark.parametrize("seed, width, share", [(1, 12, 0.3), (2, 30, 0.08), (3, 25, 0.6), (4, 3, 0.0)])
def test_greedy_knock_out_is_sequential(spark, seed, width, share):
    draw = random.Random(seed)
    edges = {(x, y) for x in range(width) for y in range(x + 1, width) if draw.random() < share}
    rows = [(f"f{x}", x, f"f{y}", y, 0.9) for x, y in sorted(edges)]
    cut = spark.createDataFrame(rows, "x string, x_ord int, y string, y_ord int, r double")
    got = {r.field: r.knocked_out_by for r in knockout.greedy_knock_outs(cut).collect()}
    assert got == greedy_by_hand(edges)
    fallen = set(got)
    # one of every pair falls, and what falls knocks nothing out
    assert all(f"f{x}" in fallen or f"f{y}" in fallen for x, y in edges) and not fallen & set(got.values())


def test_greedy_knock_out_along_a_chain(spark):
    rows = [(f"f{i}", i, f"f{i + 1}", i + 1, 0.9) for i in range(9)]
    cut = spark.createDataFrame(rows, "x string, x_ord int, y string, y_ord int, r double")
    assert {r.field for r in knockout.greedy_knock_outs(cut).collect()} == {f"f{i}" for i in range(1, 10, 2)}
    assert {r.field for r in knockout.knock_outs(cut).collect()} == {f"f{i}" for i in range(1, 10)}


def test_override_table(spark):
    table = spark.createDataFrame([("a", "KEEP"), ("b", "DROP"), ("c", "KEEP"), ("d", "DROP")], "field string, verdict string")
    lists = spark.createDataFrame([("a", "KEEP", 2), ("a", "DROP", 1), ("b", "KEEP", 1), ("c", "KEEP", 3), ("c", "DROP", 3), ("z", "DROP", 1)], "field string, verdict string, priority int")
    got = {r.field: r.final_verdict for r in knockout.overridden_by(table, lists).collect()}
    assert got == {"a": "DROP", "b": "KEEP", "c": "DROP", "d": "DROP"}
