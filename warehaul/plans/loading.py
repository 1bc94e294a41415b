"""Queries: scans, sinks, table loads and changes. Each call writes to fresh paths and tables
in the shared folder and returns the table as read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from warehaul.operators import layout, projection
from warehaul.plans.tables import AS_OF, average, customers, fact_orders, sales, table, with_cte
from warehaul.registry import query
from warehaul.session import balanced, materialised, scratch_path
from warehaul.sources import tables as src


def fresh(spark, name: str) -> tuple[str, str]:
    """(table name, location) that no other call uses."""
    return f"wh_{name}_{uuid.uuid4().hex}", scratch_path(spark, name)


def _new_table(spark, name, df, fmt="parquet", partition_by=()):
    """External table with the columns of ``df``, partition columns last, holding its rows."""
    table_name, path = fresh(spark, name)
    df = df.select(*[c for c in df.columns if c not in partition_by], *partition_by)
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    src.create_table(spark, table_name, schema, fmt, partition_by, path)
    if partition_by:
        src.overwrite_dynamic(table_name, balanced(df, *partition_by))
    else:
        df.write.insertInto(table_name)
    return table_name


def _orders(spark, sf, *extra):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", *extra
    )


ORDER_COLUMNS = "o_orderkey, o_custkey, o_totalprice, o_orderstatus"


@query(f"SELECT {ORDER_COLUMNS} FROM orders")
def scan_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    src.write_table(_orders(spark, sf), path)
    return src.read_table(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_delimited(spark, sf):
    path = scratch_path(spark, "delimited")
    src.write_delimited(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, sep="|", header=True)
    return src.read_delimited(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE", sep="|", header_lines=1)


@query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F'")
def scan_orc_partitioned(spark, sf):
    name = _new_table(spark, "orc", _orders(spark, sf), "orc", ["o_orderstatus"])
    return spark.table(name).filter("o_orderstatus = 'F'")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def recovered_partitions(spark, sf):
    name, path = fresh(spark, "recovered")
    src.create_table(
        spark, name, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING",
        "parquet", ["o_orderstatus"], path,
    )
    src.write_table(_orders(spark, sf), path, "parquet", ["o_orderstatus"])
    src.recover_partitions(spark, name)
    return spark.table(name).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, c_name FROM customer UNION ALL
    SELECT * FROM (VALUES (-101, 'NORTH'), (-102, 'SOUTH'), (-103, NULL)) v(c_custkey, c_name)"""
)
def insert_literal_rows(spark, sf):
    name = _new_table(spark, "literal", table(spark, sf, "customer").select("c_custkey", "c_name"))
    src.insert_values(spark, name, [(-101, "NORTH"), (-102, "SOUTH"), (-103, None)])
    return spark.table(name)


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def bulk_load_files(spark, sf):
    path = scratch_path(spark, "landing")
    src.write_delimited(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    name = _new_table(spark, "bulk", table(spark, sf, "customer").select("c_custkey", "c_name"))
    src.load_append(spark, path, "csv", name, sep=",")
    return spark.table(name)


@query("SELECT l_partkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_partkey")
def create_table_as_select(spark, sf):
    name, path = fresh(spark, "ctas")
    totals = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return src.ctas(totals, name, "parquet", path)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def convert_text_to_orc_to_parquet(spark, sf):
    text = scratch_path(spark, "text")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    src.write_delimited(part, text)
    rows = src.read_delimited(spark, text, "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE")
    orc = src.convert_format(spark, rows, scratch_path(spark, "orc"), "orc")
    return src.convert_format(spark, orc, scratch_path(spark, "parquet"), "parquet")


@query(
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, o_totalprice * 2, 'P' FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000"""
)
def overwrite_named_partition(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    name = _new_table(spark, "static", orders, "parquet", ["o_orderstatus"])
    part = orders.filter("o_orderstatus = 'P' AND o_totalprice > 250000").select(
        "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")
    )
    src.overwrite_partition(name, part, {"o_orderstatus": "P"})
    return spark.table(name)


@query(
    """SELECT event_id, value, day FROM (
        SELECT event_id, CASE WHEN d >= DATE '2024-01-20' THEN value + 1000 ELSE value END AS value,
            CAST(d AS VARCHAR) AS day, d, event_type FROM (SELECT *, CAST(ts AS DATE) AS d FROM events))
    WHERE d < DATE '2024-01-20' OR event_type <> 'view'"""
)
def overwrite_dynamic_partitions(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "value", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    name = _new_table(spark, "dynamic", events.drop("event_type"), "parquet", ["day"])
    again = events.filter("day >= '2024-01-20' AND event_type <> 'view'").withColumn("value", F.col("value") + 1000)
    src.overwrite_dynamic(name, again.drop("event_type"))
    return spark.table(name)


@query("SELECT c_custkey, c_name, lower(c_name) || '@email.com' AS email FROM customer")
def refresh_table_from_itself(spark, sf):
    name = _new_table(spark, "refresh", table(spark, sf, "customer").select("c_custkey", "c_name"))
    src.add_columns(spark, name, {"email": "STRING"})
    src.refresh_in_place(
        spark, name, lambda t: t.withColumn("email", F.concat(F.lower("c_name"), F.lit("@email.com")))
    )
    return spark.table(name)


@query(
    """SELECT 'high' AS target, l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000
    UNION ALL SELECT 'low', l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice <= 50000
    UNION ALL SELECT 'large', l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45"""
)
def one_scan_many_targets(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice")
    targets = src.fan_out(
        lines, {"high": price > 50000, "low": price <= 50000, "large": F.col("l_quantity") >= 45}, scratch_path(spark, "fan")
    )
    high, low, large = (
        df.select(F.lit(name).alias("target"), "l_orderkey", "l_extendedprice") for name, df in targets.items()
    )
    return high.unionByName(low).unionByName(large)


@query("SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def bucketed_join(spark, sf):
    """Two tables bucketed alike: the join and the aggregate need no shuffle of their own."""
    left, left_path = fresh(spark, "bucket_orders")
    right, right_path = fresh(spark, "bucket_customers")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    buckets = max(8, orders.count() // 1_000_000)
    src.write_bucketed(orders, left, buckets, ["c_custkey"], ["c_custkey"], left_path)
    src.write_bucketed(table(spark, sf, "customer").select("c_custkey", "c_name"), right, buckets, ["c_custkey"], ["c_custkey"], right_path)
    return (
        spark.table(left)
        .join(spark.table(right).hint("merge"), "c_custkey")
        .groupBy("c_custkey")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    """WITH source AS (SELECT c_custkey * 2 AS c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name || '-new' END AS c_name FROM customer)
    SELECT c.c_custkey, CASE WHEN s.c_custkey IS NULL THEN c.c_name ELSE s.c_name END AS c_name, c.c_acctbal
    FROM customer c LEFT JOIN source s USING (c_custkey)
    UNION ALL SELECT s.c_custkey, s.c_name, NULL FROM source s WHERE s.c_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def upsert_customers(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = target.select(
        (F.col("c_custkey") * 2).alias("c_custkey"),
        F.when(F.col("c_acctbal") >= 0, F.concat("c_name", F.lit("-new"))).alias("c_name"),
    )
    name = _new_table(spark, "upsert", target)
    src.upsert_table(spark, name, source, ["c_custkey"], ["c_name"])
    return spark.table(name)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_matching_rows(spark, sf):
    name = _new_table(spark, "update", table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"))
    src.update_rows(spark, name, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})
    return spark.table(name)


@query("SELECT k, seg FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer) WHERE seg IS NULL OR seg <> 'BUILDING'")
def delete_matching_rows(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg")
    )
    name = _new_table(spark, "delete", rows)
    src.delete_rows(spark, name, F.col("seg") == "BUILDING")
    return spark.table(name)


@query("SELECT (SELECT count(*) FROM supplier) AS before, CAST(0 AS BIGINT) AS after")
def truncate_table(spark, sf):
    name = _new_table(spark, "truncate", table(spark, sf, "supplier"))
    before = spark.table(name).count()
    src.delete_rows(spark, name)
    return spark.table(name).agg(F.lit(before).cast("bigint").alias("before"), F.count("*").alias("after"))


@query("SELECT c_custkey, c_name, NULL::VARCHAR AS note FROM customer UNION ALL SELECT -s_suppkey - 1, s_name, 'supplier' FROM supplier")
def add_column_to_table(spark, sf):
    name = _new_table(spark, "widen", table(spark, sf, "customer").select("c_custkey", "c_name"))
    src.add_columns(spark, name, {"note": "STRING"})
    added = table(spark, sf, "supplier").select(-F.col("s_suppkey") - 1, "s_name", F.lit("supplier"))
    added.write.insertInto(name)
    return spark.table(name)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def database_and_view(spark, sf):
    database = f"wh_db_{uuid.uuid4().hex}"
    current = spark.catalog.currentDatabase()
    src.use_database(spark, database, scratch_path(spark, "db"))
    try:
        table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").write.saveAsTable("retail_orders")
    finally:
        spark.catalog.setCurrentDatabase(current)
    spark.table(f"{database}.retail_orders").createOrReplaceTempView("wh_retail_orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM wh_retail_orders GROUP BY o_orderpriority")


@query(
    """SELECT 'good' AS side, doc_id, TRY_CAST(code AS BIGINT) AS code FROM
        (SELECT doc_id, CASE WHEN lang = 'de' THEN source ELSE substr(source, 4) END AS code FROM documents) WHERE TRY_CAST(code AS BIGINT) IS NOT NULL
    UNION ALL SELECT 'bad', doc_id, NULL FROM documents WHERE lang = 'de'"""
)
def split_bad_rows(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", F.col("source")).otherwise(F.substring("source", 4, 10)).alias("raw")
    )
    good, bad = src.split_errors(rows, "raw", F.col("raw").try_cast("bigint"), "code")
    return good.select(F.lit("good").alias("side"), "doc_id", "code").unionByName(
        bad.select(F.lit("bad").alias("side"), "doc_id", F.lit(None).cast("bigint").alias("code"))
    )


@query("SELECT l_shipdate, l_orderkey, l_extendedprice FROM lineitem")
def clustered_write(spark, sf):
    path = scratch_path(spark, "clustered")
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_extendedprice")
    layout.write_clustered(lines, path, ["l_shipdate", "l_orderkey"], max(8, lines.count() // 1_000_000))
    return spark.read.parquet(path)


# --- end-to-end loads -----------------------------------------------------------------------


def _retail_fact(spark, sf):
    """Orders of the last days with customer, tier and name, without returned priorities."""
    extract = (
        projection.since(fact_orders(spark, sf), "order_date", 30, AS_OF)
        .filter(~F.col("status").isin("CANCELLED", "RETURNED"))
        .join(customers(spark, sf), "customer_id")
    )
    named = extract.withColumn("full_name", F.concat("name", F.lit(" "), "city"))
    return projection.route(
        named,
        [("completed", F.col("status") == "COMPLETED"), ("pending", F.col("status") == "PENDING")],
        "default",
    )


_FACT = f"""SELECT order_id, customer_id, order_date, total_amount, status, discount_tier, region,
        name || ' ' || city AS full_name,
        CASE status WHEN 'COMPLETED' THEN 'completed' WHEN 'PENDING' THEN 'pending' ELSE 'default' END AS route
    FROM fact_orders JOIN customers USING (customer_id)
    WHERE order_date >= DATE '{AS_OF}' - INTERVAL 30 DAY AND status NOT IN ('CANCELLED', 'RETURNED')"""


@query(with_cte("fact_orders customers", _FACT))
def retail_fact_load(spark, sf):
    rows = _retail_fact(spark, sf).select(
        "order_id", "customer_id", "order_date", "total_amount", "status", "discount_tier", "region", "full_name", "route"
    )
    name = _new_table(spark, "fact", rows, "parquet", ["route"])
    return spark.table(name)


@query(
    with_cte(
        "fact_orders customers",
        f"""SELECT CAST(order_date AS DATE) AS order_day, region, count(*) AS order_count,
            round(sum(total_amount), 2) AS daily_revenue, round(avg(total_amount) + 1e-9, 6) AS avg_order_value
        FROM ({_FACT}) WHERE route = 'completed' GROUP BY 1, 2
        UNION ALL SELECT DATE '1990-01-01', r_name, CAST(0 AS BIGINT), 0.0, NULL FROM region""",
    )
)
def retail_daily_upsert(spark, sf):
    """Daily summary merged into a table that holds one old day and stale values of the new days."""
    fact = _retail_fact(spark, sf).filter("route = 'completed'")
    daily = fact.groupBy(F.to_date("order_date").alias("order_day"), "region").agg(
        F.count("*").alias("order_count"),
        F.round(F.sum("total_amount"), 2).alias("daily_revenue"),
        average("total_amount").alias("avg_order_value"),
    )
    zero = [F.lit(0).cast("bigint").alias("order_count"), F.lit(0.0).alias("daily_revenue"), F.lit(None).cast("double").alias("avg_order_value")]
    old = table(spark, sf, "region").select(F.to_date(F.lit("1990-01-01")).alias("order_day"), F.col("r_name").alias("region"), *zero)
    stale = daily.filter("region = 'ASIA'").select("order_day", "region", *zero)
    name = _new_table(spark, "daily", old.unionByName(stale))
    src.upsert_table(spark, name, daily, ["order_day", "region"])
    return spark.table(name)


@query(
    with_cte(
        "sales",
        """SELECT CAST(order_date AS VARCHAR) AS order_date, customer_id, count(*) AS n, round(sum(amount), 2) AS total
        FROM sales WHERE order_date >= DATE '1998-01-01' AND order_date < DATE '1998-04-01' GROUP BY ALL""",
    )
)
def text_to_partitioned_orc(spark, sf):
    """Delimited text to an ORC table partitioned by month, read back with partition pruning."""
    raw = scratch_path(spark, "raw-sales")
    src.write_delimited(
        sales(spark, sf).select("order_id", "customer_id", "product_id", "amount", "quantity", F.col("order_date").cast("string")), raw
    )
    rows = src.read_delimited(
        spark, raw, "order_id STRING, customer_id STRING, product_id STRING, amount DOUBLE, quantity INT, order_date STRING"
    )
    loaded = rows.withColumn("order_month", F.substring("order_date", 1, 7))
    name = _new_table(spark, "sales_orc", balanced(loaded, "order_month"), "orc", ["order_month"])
    return (
        spark.table(name)
        .filter("order_month >= '1998-01' AND order_month < '1998-04'")
        .groupBy("order_date", F.col("customer_id").cast("bigint").alias("customer_id"))
        .agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
    )


@query(
    f"""SELECT c_mktsegment || '|' || count(*) || '|' || CAST(CAST(round(sum(o_totalprice)) AS BIGINT) AS VARCHAR) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' GROUP BY c_mktsegment"""
)
def ingest_transform_export(spark, sf):
    """Four parameterised steps: ingest two text files, transform, export lines of text."""
    params = {"run_date": AS_OF}
    people, orders = scratch_path(spark, "ingest-customers"), scratch_path(spark, "ingest-orders")
    src.write_delimited(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), people)
    src.write_delimited(
        table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd")), orders
    )
    src.read_delimited(spark, people, "c_custkey BIGINT, c_mktsegment STRING").createOrReplaceTempView("wh_in_customers")
    src.read_delimited(spark, orders, "o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate DATE").createOrReplaceTempView("wh_in_orders")
    result = projection.run(
        spark,
        """SELECT c_mktsegment, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total
        FROM wh_in_orders JOIN wh_in_customers ON o_custkey = c_custkey
        WHERE o_orderdate >= CAST(:run_date AS DATE) GROUP BY c_mktsegment""",
        params,
    )
    out = scratch_path(spark, "export")
    result.select(F.concat_ws("|", "c_mktsegment", "n", "total").alias("value")).write.text(out)
    return spark.read.text(out)


@query(
    """WITH changed AS (
        SELECT o_orderpriority AS priority, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price
        FROM orders WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderkey % 3 = 0) AND o_orderpriority <> '5-LOW'
        UNION ALL SELECT '3-MEDIUM', 1.5 FROM region)
    SELECT priority, count(*) AS n, round(sum(price), 2) AS total, priority = '4-NOT SPECIFIED' AS same_files FROM changed GROUP BY priority"""
)
def change_touched_partitions(spark, sf):
    """Update, delete and upsert of a partitioned table: the files of partitions that hold no changed row stay as they are."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    name = _new_table(spark, "orders_by_priority", orders, partition_by=["priority"])
    files = lambda: spark.table(name).groupBy("priority").agg(F.array_sort(F.collect_set("_metadata.file_path")).alias("files"))
    before = materialised(files(), "files")
    src.update_rows(spark, name, F.expr("priority = '1-URGENT' AND o_orderkey % 2 = 0"), {"price": F.col("price") * 2})
    src.delete_rows(spark, name, F.expr("priority = '2-HIGH' AND o_orderkey % 3 = 0"))
    src.delete_rows(spark, name, F.col("priority") == "5-LOW")
    added = table(spark, sf, "region").select((-F.col("r_regionkey") - 1).cast("bigint").alias("o_orderkey"), F.lit(1.5).alias("price"), F.lit("3-MEDIUM").alias("priority"))
    src.upsert_table(spark, name, added, ["o_orderkey"])
    sums = spark.table(name).groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    after = files().withColumnRenamed("files", "now")
    same = (F.col("files") == F.col("now")).alias("same_files")
    return sums.join(after, "priority").join(before, "priority").select("priority", "n", "total", same)
