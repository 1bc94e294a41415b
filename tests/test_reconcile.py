import math

from pyspark.sql import functions as F

from tests.conftest import rows
from warehaul.operators import reconcile as rec
from warehaul.operators import synthetic


def people(spark):
    spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(20)], "id int, name string, pay double").createOrReplaceTempView("people")


def verdict(spark, a, b):
    people(spark)
    return rec.reconcile_sql(spark, a, b).first()


def test_same_query_passes(spark):
    v = verdict(spark, "SELECT id, name FROM people", "SELECT name, id FROM people ORDER BY id DESC")
    assert v["passed"] and v["row_count_match"] and v["schema_match"] and v["data_match"] and v["error"] is None
    assert isinstance(v["report"], str)


def test_fewer_rows_fail(spark):
    v = verdict(spark, "SELECT * FROM people", "SELECT * FROM people WHERE id < 5")
    assert (v["passed"], v["row_count_match"], v["schema_match"], v["left_count"], v["right_count"]) == (False, False, True, 20, 5)
    assert v["data_match"] is None


def test_missing_column_fails(spark):
    v = verdict(spark, "SELECT id, name FROM people", "SELECT id FROM people")
    assert not v["passed"] and not v["schema_match"] and "only left: ['name']" in v["report"]


def test_other_values_fail_wherever_they_are(spark):
    v = verdict(spark, "SELECT id FROM people", "SELECT CASE WHEN id = 19 THEN -1 ELSE id END AS id FROM people")
    assert v["row_count_match"] and v["data_match"] is False and not v["passed"]


def test_bad_text_on_either_side(spark):
    first = verdict(spark, "SELECT nope FROM people", "SELECT also_nope FROM people")
    assert first["error"].startswith("Original SQL failed") and not first["passed"]
    second = verdict(spark, "SELECT id FROM people", "SELECT FROM WHERE")
    assert second["error"].startswith("Migrated SQL failed") and second["left_count"] == 20


def test_schema_difference(spark):
    a = spark.createDataFrame([], "x int, y string, z int")
    b = spark.createDataFrame([], "y string, z bigint, w int")
    assert rows(rec.schema_diff(a, b)) == [("w", "right"), ("x", "left")]
    assert ("z", "int <> bigint") in rows(rec.schema_diff(a, b, types=True))


def test_rows_are_compared_with_their_copies(spark):
    a = spark.createDataFrame([(1, "a")] * 3 + [(2, None)], "k int, s string")
    b = spark.createDataFrame([("a", 1), (None, 2), (None, 2)], "s string, k int")
    assert sorted(map(str, rows(rec.diff_rows(a, b), "side", "copies", "k", "s"))) == ["('left', 2, 1, 'a')", "('right', 1, 2, None)"]


def test_doubles_compare_by_value(spark):
    a = spark.createDataFrame([(1, 0.0), (2, float("nan")), (3, 0.1 + 0.2)], "k int, v double")
    b = spark.createDataFrame([(1, -0.0), (2, float("nan")), (3, 0.3)], "k int, v double")
    assert rec.diff_rows(a, b).isEmpty() and rec.diff_by_key(a, b, ["k"]).isEmpty()
    assert rows(rec.fingerprint(a).drop("table")) == rows(rec.fingerprint(b).drop("table"))
    assert math.isnan(a.collect()[1]["v"])


def test_types_do_not_matter_for_numbers_only(spark):
    a = spark.createDataFrame([(1, 2.0, "5")], "k int, v double, s string")
    assert rec.reconcile(a, a.selectExpr("CAST(k AS BIGINT) k", "CAST(v AS DECIMAL(5,1)) v", "s")).first()["passed"]
    other = rec.reconcile(a, a.selectExpr("k", "v", "CAST(s AS INT) s")).first()
    assert other["schema_match"] and other["data_match"] is False
    bad = spark.createDataFrame([(1, 2.0, "x")], "k int, v double, s string")
    assert rec.reconcile(bad, a.selectExpr("k", "v", "CAST(s AS INT) s")).first()["data_match"] is False


def test_keyed_difference(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (5, "d", 1), (5, "d", 2)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "a", 1), (2, None, None), (4, "x", 3), (5, "d", 1)], "k int, s string, n int")
    got = {r["k"]: (r["status"], r["changed"]) for r in rec.diff_by_key(a, b, ["k"]).collect()}
    assert got == {2: ("changed", ["s"]), 3: ("missing_right", []), 4: ("missing_left", []), 5: ("duplicate_key", [])}


def test_fingerprint_ignores_order_and_sees_swaps(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    assert rows(rec.fingerprint(df).drop("table")) == rows(rec.fingerprint(df.orderBy(F.desc("id")).repartition(7)).drop("table"))
    swapped = df.select(F.col("v").alias("id"), F.col("id").alias("v"))
    assert rows(rec.fingerprint(df).drop("table")) != rows(rec.fingerprint(swapped).drop("table"))


TYPES = {
    "i": "INT", "b": "BIGINT", "s": "SMALLINT", "t": "TINYINT", "f": "FLOAT", "d": "DOUBLE", "m": "DECIMAL(10,2)", "w": "STRING",
    "v": "VARCHAR(20)", "c": "CHAR(1)", "o": "BOOLEAN", "dt": "DATE", "ts": "TIMESTAMP", "x": "BINARY", "u": "UNKNOWN_TYPE",
}


def test_synthetic_types_and_ranges(spark):
    df = synthetic.synthesize(spark, TYPES, 300)
    assert [f.dataType for f in df.schema] == [f.dataType for f in synthetic.to_struct(TYPES)]
    data = df.collect()
    assert len(data) == 300
    assert all(1 <= r["i"] <= 100_000 and 0 <= r["t"] <= 127 and len(r["c"]) == 1 and bytes(r["x"]) == b"\x00" for r in data)
    assert all("2020-01-01" <= r["dt"] <= "2023-12-31" and len(r["ts"]) == 19 for r in data)
    assert {r["o"] for r in data} == {True, False} and len({r["i"] for r in data}) > 250


def test_synthetic_rows_repeat_and_do_not_depend_on_partitions(spark):
    a, b = synthetic.synthesize(spark, TYPES, 50), synthetic.synthesize(spark, TYPES, 50)
    assert rec.reconcile(a, b.repartition(7)).first()["passed"]
    assert not rec.reconcile(a, synthetic.synthesize(spark, TYPES, 50, seed=1)).first()["passed"]


def test_empty_schemas_are_skipped(spark):
    assert synthetic.register_all(spark, {"syn_a": {"x": "INT"}, "syn_b": {}}, 10) == ["syn_a"]
    assert spark.table("syn_a").count() == 10 and not spark.catalog.tableExists("syn_b")


def test_a_moved_null_is_a_difference(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, p string, q string")
    b = spark.createDataFrame([(1, "x", None)], "k int, p string, q string")
    v = rec.reconcile(a, b).first()
    assert v["data_match"] is False and not v["passed"]
    for shape in ("array(p, q)", "named_struct('p', p, 'q', q)", "array(named_struct('p', p, 'q', q))", "map('p', p, 'q', q)"):
        left, right = a.selectExpr("k", f"{shape} AS v"), b.selectExpr("k", f"{shape} AS v")
        assert rec.reconcile(left, right).first()["data_match"] is False
        assert rows(rec.fingerprint(left).drop("table")) != rows(rec.fingerprint(right).drop("table"))
        assert rec.diff_rows(left, right).count() == 2 and rec.diff_by_key(left, right, ["k"]).count() == 1
        assert rec.reconcile(left, left).first()["passed"]


def test_zeros_and_digits_at_any_depth_and_size(spark):
    base = [1234567.9, 12345678.9, 98765432109876.5, 1.5e-7, 3e300, 2e-290, 0.0]
    near = [math.nextafter(v, math.inf) if v else -0.0 for v in base]
    a, b = (spark.createDataFrame([(i, v, [v, None]) for i, v in enumerate(x)], "k int, v double, w array<double>") for x in (base, near))
    assert rec.reconcile(a, b).first()["passed"] and rec.diff_by_key(a, b, ["k"]).isEmpty()
    assert rows(rec.fingerprint(a).drop("table")) == rows(rec.fingerprint(b).drop("table"))
    far = spark.createDataFrame([(i, v * (1 + 1e-10), [v, None]) for i, v in enumerate(base)], "k int, v double, w array<double>")
    assert {r["k"] for r in rec.diff_by_key(a, far, ["k"]).collect()} == set(range(6))
    assert rec.diff_rows(a, far).count() == 12


def test_rows_on_both_sides_of_a_rounding_edge_are_equal(spark):
    base = spark.range(300_000).select((F.col("id") % 7).alias("k"), (F.rand(5) * 1000 - 500).alias("x"), (F.rand(6) * 1e-9).alias("y"))
    base = base.cache()
    ulps = F.lit(1 + 4 * 2.0**-52)
    moved = base.select("k", (F.col("x") * ulps).alias("x"), (F.col("y") / ulps).alias("y"))
    assert rec.diff_rows(base, moved).count() == 0 and rec.reconcile(base, moved).first()["passed"]
    changed = moved.withColumn("y", F.when(F.col("x") == moved.agg(F.max("x")).first()[0], F.col("y") * (1 + 1e-9)).otherwise(F.col("y")))
    assert rows(rec.diff_rows(base, changed), "side", "copies") == [("left", 1), ("right", 1)]
    assert not rec.reconcile(base, changed).first()["passed"]


def test_near_rows_are_counted_with_their_copies(spark):
    edge = 1.000000000005  # halfway between two values of twelve digits
    below, above = edge - 2e-15, edge + 2e-15
    odd = [(None, 2.0), (float("nan"), 2.0), (float("inf"), 2.0), (-0.0, 1.0)]
    a = spark.createDataFrame([(below, 5.0), (below, 7.0), (above, 5.0), *odd], "x double, y double")
    b = spark.createDataFrame([(above, 5.0), (above, 7.0), (below, 5.0), *odd[:3], (0.0, 1.0)], "x double, y double")
    assert rows(rec.diff_rows(a, b)) == []
    more = b.unionByName(spark.createDataFrame([(below, 7.0)] * 2, b.schema))
    assert rows(rec.diff_rows(a, more), "side", "copies", "y") == [("right", 2, 7.0)]
    other = spark.createDataFrame([(below, 7.0), (below, 7.0), (above, 5.0), *odd], a.schema)
    assert rows(rec.diff_rows(other, b), "side", "copies", "y") == [("left", 1, 7.0), ("right", 1, 5.0)]
    assert rows(rec.diff_rows(a.limit(0), b.limit(0))) == [] and rec.diff_rows(a.limit(0), b).count() > 4


def test_verdict_and_rows_come_from_one_comparison(spark, monkeypatch):
    left = spark.createDataFrame([(i, i * 0.1) for i in range(50)], "k int, v double")
    right = left.withColumn("v", F.when(F.col("k") == 7, 9.5).otherwise(F.col("v")))
    compared = []
    plain = rec.diff_rows
    monkeypatch.setattr(rec, "diff_rows", lambda *sides: compared.append(sides) or plain(*sides))
    verdict, diff = rec.reconcile_rows(left, right)
    assert len(compared) == 1
    assert verdict.collect() == rec.reconcile(left, right).collect() and not verdict.first()["passed"]
    assert sorted(tuple(r) for r in diff.collect()) == [("left", 1, 7, 0.7), ("right", 1, 7, 9.5)]
