"""Results for hot keys, computed piece by piece, equal those of plain window functions."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from warehaul.operators import windows as win
from warehaul.plans import QUERIES
from warehaul.plans.relational import _customer_windows
from warehaul.session import handed_on, shared_folder

HOT = 40  # rows per key from which on the piecewise way is taken


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = rng.choice(["a", "a", "a", "b", None, None, "c" + str(i % 40)])
        value = rng.choice([None, 1.0, 2.0, 2.0, float(rng.randint(0, 60))])
        data.append((i, key, value, rng.choice(["x", "y", None])))
    return spark.createDataFrame(data, "id int, key string, value double, name string").repartition(5).cache()


def test_there_are_hot_and_ordinary_keys(skewed):
    hot = win.hot_keys(skewed, ["key"], HOT).count()
    assert 0 < hot < skewed.select("key").distinct().count()


@pytest.mark.parametrize("order", [["-value", "id"], ["value", "-id"]])
def test_row_number(skewed, order):
    plain = skewed.withColumn(
        "rn", F.row_number().over(Window.partitionBy("key").orderBy(*win.sort_columns(order))).cast("bigint")
    )
    assert rows(win.with_row_number(skewed, ["key"], order, max_rows=HOT), "id", "rn") == rows(plain, "id", "rn")


@pytest.mark.parametrize("order", [["-value"], ["value", "name"]])
def test_ranks_with_ties_and_nulls(skewed, order):
    w = Window.partitionBy("key").orderBy(*win.sort_columns(order))
    assert rows(win.with_rank(skewed, ["key"], order, max_rows=HOT), "id", "rnk") == rows(
        skewed.withColumn("rnk", F.rank().over(w)), "id", "rnk"
    )
    assert rows(win.with_dense_rank(skewed, ["key"], order, max_rows=HOT), "id", "dense_rnk") == rows(
        skewed.withColumn("dense_rnk", F.dense_rank().over(w)), "id", "dense_rnk"
    )


def test_lag_and_lead_cross_the_pieces(skewed):
    def shown(df):
        return sorted(map(str, (tuple(r) for r in df.select("id", "prev", "next").collect())))

    w = Window.partitionBy("key").orderBy(F.col("value").desc(), "id")
    plain = skewed.withColumn("prev", F.lag("id", 1).over(w)).withColumn("next", F.lead("name", 1).over(w))
    got = win.with_neighbours(
        skewed, ["key"], ["-value", "id"], {"prev": ("lag", "id"), "next": ("lead", "name")}, max_rows=HOT
    )
    assert shown(got) == shown(plain)


def test_partition_sum(skewed):
    plain = skewed.withColumn("total", F.sum("value").over(Window.partitionBy("key")))
    got = win.with_partition_sum(skewed, ["key"], "value", max_rows=HOT)
    assert rows(got, "id", F.coalesce("total", F.lit(-1))) == rows(plain, "id", F.coalesce("total", F.lit(-1)))


def test_all_windows_together(skewed):
    base = skewed.withColumn("value", F.coalesce("value", F.lit(0.0)))
    args = dict(value="value", by_value=["-value"], ties=["id"], by_time=["id"])
    hot = win.window_tour(base, ["key"], max_rows=HOT, **args)
    plain = win.window_tour(base, ["key"], **args)
    columns = ["id", "rn", "rnk", "dense_rnk", "total_spent", F.coalesce("prev_amt", F.lit(-1)), F.coalesce("next_amt", F.lit(-1))]
    assert rows(hot, *columns) == rows(plain, *columns)


def test_top_n_beyond_the_rewrite_limit(spark, skewed):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        big = rows(win.top_n_per_key(skewed, ["key"], ["-value", "id"], 9), "id")
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert big == rows(win.top_n_per_key(skewed, ["key"], ["-value", "id"], 9), "id")


def brute_periods(data):
    merged = {}
    for key, start, end in sorted(data):
        spans = merged.setdefault(key, [])
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return sorted((k, s, e) for k, spans in merged.items() for s, e in spans)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_periods(spark, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(300):
        start = rng.randint(0, 900)
        data.append((rng.choice("aaab") if rng.random() < 0.8 else f"k{rng.randint(0, 9)}", start, start + rng.choice([0, 2, 5, 40])))
    df = spark.createDataFrame(data, "key string, start int, finish int")
    assert rows(win.merge_periods(df, ["key"], "start", "finish", max_rows=HOT)) == brute_periods(data)
    assert rows(win.merge_periods(df, ["key"], "start", "finish")) == brute_periods(data)


def test_row_ids_are_consecutive_over_the_order(spark):
    df = spark.range(500).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = win.with_row_id(df, ["-v", "id"], start=10, rows_per_piece=60).collect()
    got = sorted(got, key=lambda r: r["row_id"])
    assert [r["row_id"] for r in got] == list(range(10, 510))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda p: (-p[0], p[1]))


def test_latest_and_qualify(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, t int, v int")
    assert rows(win.latest_per_key(df, ["k"], ["-t"])) == [("a", 2, 20), ("b", 1, 5)]
    best = F.max("v").over(Window.partitionBy("k"))
    assert rows(win.qualify(df, best, lambda m: F.col("v") == m)) == [("a", 2, 20), ("b", 1, 5)]


def test_pieces_and_parts_follow_the_rows_and_not_the_threshold(spark, skewed, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert win.piece_count(skewed, 36_000_000, 1500) <= 36_000_000 // win.PIECE_ROWS + 3 * cores
    assert win.piece_count(skewed, 12_000_000, win.HOT_ROWS) == 6
    monkeypatch.setattr(win, "PIECE_ROWS", 10)
    cold, hot, _ = win._split(skewed, ["key"], 10**6)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert hot is None and cold.rdd.getNumPartitions() == 600 // 10 + 1 > int(parts)
    plain = skewed.withColumn("total", F.sum("value").over(Window.partitionBy("key")))
    got = win.with_partition_sum(skewed, ["key"], "value")
    assert rows(got, "id", F.coalesce("total", F.lit(-1))) == rows(plain, "id", F.coalesce("total", F.lit(-1)))


SIX = ["rn", "rnk", "dense_rnk", "total_spent", "prev_amt", "next_amt"]


@pytest.mark.parametrize("order", [["-value"], ["value", "name"]])
def test_tour_ties_that_fill_whole_pieces(spark, order):
    rng = random.Random(11)
    data = [(i, rng.choice(["a", None]), rng.choice([7.0] * 8 + [None, 1.0, 9.0, float("nan")]), rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(data, "id int, key string, value double, name string").repartition(3).cache()
    args = dict(value="value", by_value=order, ties=["id"], by_time=["name"])
    hot = win.window_tour(df, ["key"], max_rows=20, **args)
    plain = win.window_tour(df, ["key"], **args)
    assert hot.dtypes == plain.dtypes
    columns = ["id", *[F.col(c).cast("string") for c in SIX]]
    assert sorted(map(str, rows(hot, *columns))) == sorted(map(str, rows(plain, *columns)))


def test_tour_with_ordinary_rows_keeps_its_source(spark, skewed):
    base, at = handed_on(skewed.withColumn("value", F.coalesce("value", F.lit(0.0))), "given")
    args = dict(value="value", by_value=["-value"], ties=["id"], by_time=["name"])
    hot = win.window_tour(base, ["key"], max_rows=HOT, source=at, **args)
    columns = ["id", *[F.coalesce(c, F.lit(-1)) for c in SIX]]
    assert rows(hot, *columns) == rows(win.window_tour(base, ["key"], **args), *columns)


def test_hot_windows_leave_one_step_on_disk(spark, tmp_path):
    lines, orders = 6000, 600
    spark.range(orders).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 30).alias("o_custkey"),
        F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id % 50 as int))").alias("o_orderdate"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(lines).select(
        (F.col("id") % orders).alias("l_orderkey"), F.col("id").alias("l_partkey"),
        (F.xxhash64("id") % 50).cast("double").alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    place = Path(shared_folder(spark)) / "warehaul"
    old = set(place.glob("*"))
    got = QUERIES["customer_windows_hot"](spark, str(tmp_path))
    kept = {p.name: spark.read.parquet(str(p)).count() for p in set(place.glob("*")) - old}
    assert sum(kept.values()) < 2 * lines, kept
    assert got.count() == lines
    plain = _customer_windows(spark, str(tmp_path), win.HOT_ROWS, F.col("customer_id") % 3)
    columns = ["order_id", "product_id", *[F.coalesce(c, F.lit(-1)) for c in SIX]]
    assert rows(got, *columns) == rows(plain, *columns)


def test_a_step_handed_on_takes_the_place_of_its_source(spark):
    first, at = handed_on(spark.range(10), "first")
    other, at_other = handed_on(spark.range(5), "other")
    second, _ = handed_on(first.withColumn("x", F.col("id") + 1), "second", at)
    assert second.count() == 10 and other.count() == 5
    assert not Path(at).exists() and Path(at_other).exists()


@pytest.mark.parametrize("by_value", [["-value"], ["value"], ["name", "-value"]])
def test_tour_in_rounds(spark, monkeypatch, by_value):
    rng = random.Random(5)
    values = [None, float("nan"), -0.0, 0.0, *[7.0] * 9, *map(float, range(-20, 20))]
    data = [(i, rng.choice("ab"), rng.choice(values), rng.choice(["x", "y", None]), rng.choice([None, *range(30)])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, key string, value double, name string, day int")
    df = df.withColumn("day", F.date_add(F.lit("2020-01-01"), F.col("day"))).repartition(3).cache()
    args = dict(value="value", by_value=by_value, ties=["id"], by_time=["-day"])
    plain = win.window_tour(df, ["key"], **args)
    monkeypatch.setattr(win, "ROUND_PIECES", 8)
    ranges = win._range_numbers(df, ["-value", "day", "name"], 4)
    assert [df.select(r.alias("r")).distinct().count() for r in ranges] == [4, 4, 1]
    hot = win.window_tour(df, ["key"], max_rows=30, **args)
    columns = ["id", *[F.col(c).cast("string") for c in SIX]]
    assert sorted(map(str, rows(hot, *columns))) == sorted(map(str, rows(plain, *columns)))


def test_rounds_of_one_value(spark, monkeypatch):
    monkeypatch.setattr(win, "ROUND_PIECES", 3)
    df = spark.range(200).select("id", F.lit("a").alias("key"), F.lit(1.0).alias("value"), F.lit(None).cast("date").alias("day"))
    args = dict(value="value", by_value=["-value"], ties=["id"], by_time=["day"])
    columns = ["id", *[F.coalesce(c, F.lit(-1)) for c in SIX]]
    plain = rows(win.window_tour(df, ["key"], **args), *columns)
    assert rows(win.window_tour(df, ["key"], max_rows=20, **args), *columns) == plain


def test_tour_numbers_copies_of_a_row_backwards_in_time(spark):
    data = [("a", i, float(i % 7), i % 5) for i in [*range(60), *range(60)]]
    df = spark.createDataFrame(data, "key string, id int, value double, day int")
    args = dict(value="value", by_value=["-value"], ties=["id"], by_time=["day"])
    found = {}
    for r in win.window_tour(df, ["key"], max_rows=20, **args).collect():
        found.setdefault((r["id"], r["value"]), []).append((r["rn"], r["prev_amt"], r["next_amt"]))
    assert len(found) == 60 and sorted(n[0] for v in found.values() for n in v) == list(range(1, 121))
    for (_, value), copies in found.items():
        (low, before, _), (high, _, after) = sorted(copies)
        assert (high, before, after) == (low + 1, value, value)
