import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from warehaul.operators import aggregates as agg
from warehaul.operators import joins, layout, projection
from warehaul.operators.sets import union_first


def test_not_in_and_not_exists_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,)], "k int")
    holed = spark.createDataFrame([(1,), (None,)], "k int")
    empty = spark.createDataFrame([], "k int")
    for other in (right, holed, empty):
        left.createOrReplaceTempView("nl")
        other.createOrReplaceTempView("nr")
        want = spark.sql("SELECT k FROM nl WHERE k NOT IN (SELECT k FROM nr)")
        assert sorted(map(str, rows(joins.anti_join(left, other, "k")))) == sorted(map(str, rows(want)))
    assert sorted(map(str, rows(joins.anti_join(left, holed, "k", null_aware=False)))) == ["(2,)", "(None,)"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
        F.col("id").alias("v"),
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), (None, 5)], "k string, w int")
    got = joins.join_skewed(left, right, ["k"], how, salt=4, max_rows=50)
    want = left.join(right, ["k"], how)
    assert sorted(map(str, rows(got, "k", "v", "w"))) == sorted(map(str, rows(want, "k", "v", "w")))


def test_lookup_takes_one_match_and_a_default(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "second", 2), ("a", "first", 1)], "k string, name string, pos int")
    assert rows(joins.lookup(facts, dim, "k", ["name"], ["pos"], "none"), "id", "name") == [
        (1, "first"), (2, "none"), (3, "none"),
    ]


def test_cascade_prefers_earlier_steps_then_order(spark):
    left = spark.createDataFrame([(1, "Ab"), (2, "zz"), (3, "q"), (4, None)], "id int, k string")
    right = spark.createDataFrame([("r1", "ab", 2), ("r2", "Ab", 3), ("r3", "Ab", 1), ("r4", "ZZ", 4)], "name string, k string, pos int")
    got = joins.match_cascade(
        left, right, "id", [(F.col("k"), F.col("k")), (F.lower("k"), F.lower("k"))], ["pos"], ["pos", "name"]
    )
    assert sorted(map(str, rows(got, "id", "match_step", "name"))) == [
        "(1, 1, 'r3')", "(2, 2, 'r4')", "(3, None, None)", "(4, None, None)",
    ]
    with pytest.raises(ValueError, match="repeats"):
        joins.match_cascade(left.unionByName(left), right, "id", [(F.col("k"), F.col("k"))], ["pos"], ["name"])


def test_hierarchy_depth_paths_and_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(joins.expand_hierarchy(edges, roots)) == [
        ("a", 0, "a", False), ("b", 1, "a/b", False), ("c", 2, "a/b/c", False), ("d", 1, "a/d", False),
    ]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert rows(joins.expand_hierarchy(loop, roots)) == [("a", 0, "a", False), ("a", 2, "a/b/a", True), ("b", 1, "a/b", False)]
    deep = spark.createDataFrame([(str(i), str(i + 1)) for i in range(30)], "parent string, child string")
    assert joins.expand_hierarchy(deep, spark.createDataFrame([("0",)], "node string")).count() == 31


def test_tier_bounds_and_nulls(spark):
    df = spark.createDataFrame([(1000.0,), (999.0,), (500.0,), (None,)], "v double")
    tier = projection.tiered(F.col("v"), [(1000, "GOLD"), (500, "SILVER")], "BRONZE")
    strict = projection.tiered(F.col("v"), [(1000, "GOLD"), (500, "SILVER")], "BRONZE", inclusive=False)
    got = [tuple(r) for r in df.select(tier, strict).collect()]
    assert got == [("GOLD", "SILVER"), ("SILVER", "SILVER"), ("SILVER", "BRONZE"), ("BRONZE", "BRONZE")]


def test_casts_give_null_or_fail(spark):
    df = spark.createDataFrame([("James", 34, "2006-01-01", "true"), ("Robert", 37, "06-01-1992", "false")], "n string, age int, d string, g string")
    got = projection.cast_columns(df, {"age": "string", "d": "date", "g": "boolean"})
    assert [str(r["d"]) for r in got.collect()] == ["2006-01-01", "None"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        projection.cast_columns(df, {"d": "date"}, strict=True).collect()


def test_query_without_from_and_function_casts(spark):
    assert [tuple(r) for r in projection.run(spark, "SELECT 5001, 101, STRING(7), :x", {"x": "y"}).collect()] == [(5001, 101, "7", "y")]


def test_variables(spark):
    names = projection.declare(spark, [("spark.x", "1"), ("hivevar:tst_a", "1"), ("tst_b", None), ("tst_a", "2")])
    assert names == ["tst_a", "tst_b"]
    assert tuple(spark.sql("SELECT tst_a, tst_b").first()) == ("2", "UNKNOWN")


def test_explode_drops_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, ""), (3, None)], "id int, items string")
    assert rows(projection.explode_delimited(df, "items", "|"), "id", "item") == [(1, "a"), (1, "b")]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "\n\n", "a\n\nb"])
def test_lines_are_those_of_splitlines(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = sorted(tuple(r) for r in projection.to_lines(df, "id", "text").collect())
    assert [r[2] for r in got] == text.splitlines()
    assert [r[1] for r in got] == list(range(1, len(got) + 1))


def test_array_functions_on_nested_rows(spark):
    data = [
        ("James,,Smith", ["Java", "Scala", "C++"], "OH", "CA"), ("Robert,,Williams", ["CSharp", "VB"], "UT", "NV"),
    ]
    df = spark.createDataFrame(data, "name string, school array<string>, now string, before string")
    assert df.select("name", F.explode("school")).count() == 5
    got = df.select(F.split("name", ","), F.array("now", "before"), F.array_contains("school", "Java")).collect()
    assert [tuple(r) for r in got] == [(["James", "", "Smith"], ["OH", "CA"], True), (["Robert", "", "Williams"], ["UT", "NV"], False)]


def test_long_lists_continue_in_chunks(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), (25 - F.col("id")).alias("v"))
    got = agg.collect_sorted(df, ["k"], "v", chunk=10).orderBy("chunk_no").collect()
    assert [r["items"] for r in got] == [list(range(1, 11)), list(range(11, 21)), list(range(21, 26))]


def test_profile_exact_and_approx(spark):
    df = spark.createDataFrame([(1, "aa"), (2, None), (2, "b")], "n int, s string")
    got = {r["column"]: r for r in agg.profile(df).collect()}
    assert (got["n"]["distinct"], got["n"]["smallest"], got["n"]["largest"]) == (2, "1", "2")
    assert (got["s"]["nulls"], got["s"]["distinct"], got["s"]["avg_length"], got["s"]["max_length"]) == (1, 2, 1.5, 2)
    assert {r["column"]: r["distinct"] for r in agg.profile(df, approx=True).collect()} == {"n": 2, "s": 2}


def test_usage_reports(spark):
    df = spark.createDataFrame([("f", "3"), ("g", "n/a"), ("h", "7"), (None, "9")], "fn string, calls string")
    assert [tuple(r) for r in agg.top_usage(df, "fn", "calls").collect()] == [("h", 7.0), ("f", 3.0)]
    assert [r["fn"] for r in agg.top_usage(df, "fn").collect()] == ["f", "g", "h"]
    assert agg.numeric_sum(df, "calls").first()[0] == 19.0


def test_order_helpers(spark):
    df = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert [r["k"] for r in layout.pinned_sort(df, "k", "b").collect()] == ["b", "a", "c"]
    assert [r["k"] for r in layout.top_n(df, ["-v"], 2).collect()] == ["b", "a"]
    assert layout.sample_rows(df, 2).count() == 2
    parts = layout.distribute(df, ["k"], ["v"], 3)
    assert parts.rdd.getNumPartitions() == 3


def test_union_keeps_the_first(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, pos int")
    b = spark.createDataFrame([("x", 3), ("z", 4)], "k string, pos int")
    assert rows(union_first([a, b], ["k"], ["pos"])) == [("x", 1), ("y", 2), ("z", 4)]
