import os
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from warehaul.operators.upsert import upsert
from warehaul.session import fits, scratch_path, shared_folder, small
from warehaul.sources import tables as src


def new(spark, schema, fmt="parquet", partition_by=()):
    name = f"t_{uuid.uuid4().hex}"
    src.create_table(spark, name, schema, fmt, partition_by, scratch_path(spark, name))
    return name


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


def test_shared_folder_without_the_setting():
    class Context:
        applicationId = "a1"
        master = "local[2]"

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        sparkContext = Context()

    assert shared_folder(Session) == shared_folder(Session)
    Context.master = "spark://host"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_size_checks(spark):
    df = spark.range(100)
    assert fits(df, max_rows=100) and not fits(df, max_rows=99) and not fits(df, max_bytes=50)
    assert "broadcast" in df.join(small(df), "id")._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("headers", [0, 1, 3])
def test_delimited_with_header_lines(spark, tmp_path, headers):
    for part in ("a", "b"):
        lines = [f"header {i}" for i in range(headers)] + [f"{part}1;1.5", f"{part}2;bad", f"{part}3;"]
        (tmp_path / f"{part}.csv").write_text("\n".join(lines) + "\n")
    df = src.read_delimited(spark, str(tmp_path), "k STRING, v DOUBLE", ";", headers)
    assert rows(df) == [("a1", 1.5), ("a2", None), ("a3", None), ("b1", 1.5), ("b2", None), ("b3", None)]


def test_partitions_are_found_by_repair_only(spark):
    name = new(spark, "v INT, dt STRING", partition_by=["dt"])
    location = [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Location"][0]
    spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, dt string").write.mode("append").partitionBy("dt").parquet(location)
    src.recover_partitions(spark, name)
    assert rows(spark.table(name)) == [(1, "d1"), (2, "d2")]


def test_partition_overwrites_keep_other_partitions(spark):
    name = new(spark, "v INT, dt STRING", "orc", ["dt"])
    src.overwrite_dynamic(name, spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "dt string, v int"))
    src.overwrite_dynamic(name, spark.createDataFrame([("b", 20)], "dt string, v int"))
    src.overwrite_partition(name, spark.createDataFrame([(30,), (31,)], "v int"), {"dt": "c"})
    assert rows(spark.table(name), "dt", "v") == [("a", 1), ("b", 20), ("c", 30), ("c", 31)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    src.overwrite_partition(name, spark.createDataFrame([], "v int"), {"dt": "c"})
    src.overwrite_partition(name, spark.createDataFrame([(7,)], "v int"), {"dt": "it's"})
    assert rows(spark.table(name), "dt", "v") == [("a", 1), ("b", 20), ("it's", 7)]


def test_refresh_drops_partitions_that_vanish(spark):
    name = new(spark, "v INT, dt STRING", "parquet", ["dt"])
    src.overwrite_dynamic(name, spark.createDataFrame([("a", 1), ("b", 2)], "dt string, v int"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        src.delete_rows(spark, name, F.col("dt") == "b")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    assert rows(spark.table(name), "dt", "v") == [("a", 1)]


def test_full_refresh_update_and_delete(spark):
    name = new(spark, "k INT, s STRING")
    src.insert_values(spark, name, [(1, "a"), (2, None), (3, "c")])
    src.add_columns(spark, name, {"mail": "STRING"})
    src.refresh_in_place(spark, name, lambda t: t.withColumn("mail", F.concat("s", F.lit("@x"))))
    assert rows(spark.table(name)) == [(1, "a", "a@x"), (2, None, None), (3, "c", "c@x")]
    src.update_rows(spark, name, F.col("k") == 3, {"s": F.lit("z")})
    src.delete_rows(spark, name, F.col("s") == "a")
    assert rows(spark.table(name), "k", "s") == [(2, None), (3, "z")]
    src.delete_rows(spark, name)
    assert spark.table(name).count() == 0


def test_upsert_null_values_and_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    assert rows(upsert(target, source, ["k"], ["s"])) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    with pytest.raises(ValueError, match="repeat"):
        upsert(target, source.union(source), ["k"], ["s"])


def test_fan_out_sends_rows_to_all_or_no_targets(spark):
    df = spark.createDataFrame([(1, 5), (2, 15), (3, None)], "k int, v int")
    out = src.fan_out(df, {"high": F.col("v") > 10, "low": F.col("v") <= 10, "any": F.col("v") > 0}, scratch_path(spark, "fan"))
    assert {n: rows(d, "k") for n, d in out.items()} == {"high": [(2,)], "low": [(1,)], "any": [(1,), (2,)]}


def test_error_rows_are_kept_aside(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "k int, v string")
    good, bad = src.split_errors(df, "v", F.col("v").try_cast("int"), "n")
    assert rows(good, "k", "n") == [(1, 5), (3, None)] and rows(bad, "k", "v") == [(2, "x")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    names = []
    for _ in range(2):
        names.append(f"b_{uuid.uuid4().hex}")
        src.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), names[-1], 4, ["k"], ["k"], scratch_path(spark, "b"))
    joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "k")
    assert joined.count() == 100
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options_split_the_read(spark):
    class Reader:
        def format(self, name):
            self.name = name
            return self

        def options(self, **options):
            self.seen = options
            return self

        def load(self):
            return self

    class Session:
        read = Reader()

    got = src.read_jdbc(Session, "jdbc:x", "t", "id", 0, 1000, 8, fetchsize="10000")
    assert got.name == "jdbc" and got.seen["numPartitions"] == 8 and got.seen["partitionColumn"] == "id"


def test_rows_from_the_driver(spark):
    df = src.from_rows(spark, [("Finance", 10), ("IT", 40)], "dept_name string, dept_id int")
    assert rows(df) == [("Finance", 10), ("IT", 40)]


def test_script_files_by_suffix(spark, tmp_path):
    from warehaul.sources.corpora import read_scripts

    os.makedirs(tmp_path / "deep" / "er")
    (tmp_path / "a.hql").write_bytes(b"SELECT 1;\nSELECT \xff;")
    (tmp_path / "deep" / "er" / "b.SQL").write_text("SELECT 2")
    (tmp_path / "c.txt").write_text("no")
    got = {r["stem"]: r["text"] for r in read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"a": "SELECT 1;\nSELECT �;", "b": "SELECT 2"}


def test_changes_touch_only_partitions_with_changed_rows(spark, tmp_path):
    name = f"touched_{uuid.uuid4().hex}"
    src.create_table(spark, name, "k INT, v STRING, p STRING, q INT", "parquet", ["p", "q"], str(tmp_path / "t"))
    made = spark.range(60).selectExpr("CAST(id AS INT) AS k", "'old' AS v", "concat('it''s ', id % 3) AS p", "CAST(id % 2 AS INT) AS q")
    src.overwrite_dynamic(name, made)

    def files():
        return {(r.p, r.q): r.f for r in spark.table(name).groupBy("p", "q").agg(F.array_sort(F.collect_set("_metadata.file_path")).alias("f")).collect()}

    def times():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}

    first, at = files(), times()
    assert len(first) == 6
    src.update_rows(spark, name, F.col("k") == 7, {"v": F.lit("new")})
    now = files()
    assert {p for p in first if now[p] != first[p]} == {("it's 1", 1)}
    assert {f: t for f, t in times().items() if f in at} == {f: t for f, t in at.items() if f in times()}
    # a row that moves touches the partition it leaves and the one it enters, also a new one
    src.update_rows(spark, name, F.col("k") == 8, {"q": F.lit(9)})
    then = files()
    assert {p for p in then if then[p] != now.get(p)} == {("it's 2", 0), ("it's 2", 9)}
    assert rows(spark.table(name).filter("q = 9")) == [(8, "old", "it's 2", 9)]
    # a partition that loses its last row goes, the others stay
    src.delete_rows(spark, name, F.col("q") == 9)
    last = files()
    assert ("it's 2", 9) not in last and all(last[p] == then[p] for p in last)
    src.delete_rows(spark, name, F.col("k") > 1000)
    assert files() == last
    source = spark.createDataFrame([(0, "up", "it's 0", 0), (100, "added", "other", 1)], "k int, v string, p string, q int")
    src.upsert_table(spark, name, source, ["k"])
    end = files()
    assert {p for p in end if end[p] != last.get(p)} == {("it's 0", 0), ("other", 1)}
    assert spark.table(name).count() == 60 and rows(spark.table(name).filter("v in ('up', 'added', 'new')"), "k") == [(0,), (7,), (100,)]


def test_null_partitions_are_rewritten_whole(spark, tmp_path):
    name = f"nulls_{uuid.uuid4().hex}"
    src.create_table(spark, name, "k INT, p STRING", "parquet", ["p"], str(tmp_path / "t"))
    src.overwrite_dynamic(name, spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k int, p string"))
    src.update_rows(spark, name, F.col("k") == 2, {"k": F.lit(5)})
    assert rows(spark.table(name), "k", "p") == [(1, "a"), (3, None), (5, None)]
