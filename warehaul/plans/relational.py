"""Queries: projections, filters, joins, aggregates, windows, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from warehaul.operators import aggregates as agg
from warehaul.operators import joins, layout, projection
from warehaul.operators import reconcile as rec
from warehaul.operators import synthetic
from warehaul.operators import windows as win
from warehaul.plans.tables import AS_OF, average, customers, fact_orders, products, sales, table, with_cte
from warehaul.registry import query
from warehaul.session import handed_on
from warehaul.sources import tables as src

# --- projections, filters, parameters -------------------------------------------------------


@query("SELECT s.*, n_name AS nation_name FROM supplier s JOIN nation ON s_nationkey = n_nationkey")
def project_all_columns(spark, sf):
    suppliers = table(spark, sf, "supplier").alias("s")
    return suppliers.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s.*", F.col("n_name").alias("nation_name")
    )


@query(
    """SELECT o_orderkey AS order_id,
        CASE WHEN o_totalprice >= 400000 THEN 'GOLD' WHEN o_totalprice >= 200000 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
        CASE WHEN o_totalprice > 400000 THEN 'HIGH' WHEN o_totalprice > 200000 THEN 'MEDIUM' ELSE 'LOW' END AS category
    FROM orders"""
)
def derive_tiers(spark, sf):
    price = F.col("o_totalprice")
    derived = projection.derive(
        table(spark, sf, "orders"),
        {
            "tier": projection.tiered(price, [(400000, "GOLD"), (200000, "SILVER")], "BRONZE"),
            "category": projection.tiered(price, [(400000, "HIGH"), (200000, "MEDIUM")], "LOW", inclusive=False),
        },
    )
    return derived.select(F.col("o_orderkey").alias("order_id"), "tier", "category")


@query(
    """SELECT c_custkey AS cust_id, c_name || ' ' || c_mktsegment AS full_name,
        lower(c_name) || '.' || lower(c_mktsegment) || '@email.com' AS email FROM customer"""
)
def derive_strings(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust_id"),
        F.concat("c_name", F.lit(" "), "c_mktsegment").alias("full_name"),
        F.concat(F.lower("c_name"), F.lit("."), F.lower("c_mktsegment"), F.lit("@email.com")).alias("email"),
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def filter_by_parameters(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("wh_orders")
    return projection.run(
        spark,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM wh_orders"
        " WHERE o_orderstatus = :status AND o_orderpriority = :priority",
        {"status": "P", "priority": "1-URGENT"},
    )


@query(
    with_cte(
        "customers",
        """SELECT 'ALL' AS choice, region, count(*) AS n FROM customers GROUP BY region
        UNION ALL SELECT 'ASIA', region, count(*) FROM customers WHERE region = 'ASIA' GROUP BY region""",
    )
)
def optional_parameter(spark, sf):
    base = customers(spark, sf)

    def report(choice):
        return (
            base.filter(projection.optional_eq(F.col("region"), choice))
            .groupBy("region")
            .agg(F.count("*").alias("n"))
            .select(F.lit(choice).alias("choice"), "region", "n")
        )

    return report("ALL").unionByName(report("ASIA"))


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def table_name_parameter(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("wh_lineitem_1998")
    return projection.run(
        spark,
        "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM IDENTIFIER('wh_lineitem_' || :suffix)",
        {"suffix": "1998"},
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) = DATE '1998-06-30'")
def session_variables(spark, sf):
    projection.declare(
        spark,
        [
            ("hive.exec.parallel", "true"),
            ("hivevar:wh_status", "P"),
            ("wh_run_dt", "1998-06-30"),
            ("hivevar:wh_status", "F"),
            ("wh_unset", None),
        ],
    )
    table(spark, sf, "orders").createOrReplaceTempView("wh_orders")
    return spark.sql(
        "SELECT o_orderkey FROM wh_orders WHERE o_orderstatus = wh_status"
        " AND to_date(o_orderdate) = CAST(wh_run_dt AS DATE) AND wh_unset = 'UNKNOWN'"
    )


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - INTERVAL 30 DAY")
def recent_days(spark, sf):
    return projection.since(table(spark, sf, "orders"), "o_orderdate", 30, AS_OF).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def not_in_literals(spark, sf):
    return table(spark, sf, "orders").filter(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query(
    """SELECT route, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
        SELECT *, CASE WHEN o_totalprice > 450000 THEN 'review' WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'default' END AS route FROM orders) GROUP BY route"""
)
def conditional_split(spark, sf):
    routed = projection.route(
        table(spark, sf, "orders"),
        [
            ("review", F.col("o_totalprice") > 450000),
            ("completed", F.col("o_orderstatus") == "F"),
            ("pending", F.col("o_orderstatus") == "P"),
        ],
        "default",
    )
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """SELECT doc_id, source, TRY_CAST(substr(source, 4) AS INTEGER) AS source_no, TRY_CAST(lang AS INTEGER) AS lang_no,
        CAST(n_chars AS VARCHAR) AS chars_text, CAST(n_chars AS DOUBLE) AS chars_double,
        CASE WHEN doc_id % 3 = 0 THEN DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) END AS first_date FROM documents"""
)
def cast_columns_lenient(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.substring("source", 4, 10).alias("source_no"),
        F.col("lang").alias("lang_no"),
        F.col("n_chars").alias("chars_text"),
        F.col("n_chars").alias("chars_double"),
        # two in three are no dates
        F.when(F.col("doc_id") % 3 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).cast("string"))
        .when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.lit("2020-13-45")).alias("first_date"),
    )
    return projection.cast_columns(
        docs, {"source_no": "int", "lang_no": "int", "chars_text": "string", "chars_double": "double", "first_date": "date"}
    )


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n >= 10")
def derived_table(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("wh_orders")
    return spark.sql(
        "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM wh_orders GROUP BY o_custkey) t WHERE n >= 10"
    )


@query(
    """SELECT p_partkey, p_name, round(p_retailprice * 1.1, 2) AS list_price,
        CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class
    FROM part WHERE p_size > 5"""
)
def reusable_transforms(spark, sf):
    def marked_up(df, rate):
        return df.withColumn("list_price", F.round(F.col("p_retailprice") * rate, 2))

    def classed(df, small_below, medium_below):
        size = F.col("p_size")
        return df.withColumn(
            "size_class",
            F.when(size < small_below, "small").when(size < medium_below, "medium").otherwise("large"),
        )

    return (
        table(spark, sf, "part")
        .filter("p_size > 5")
        .transform(marked_up, 1.1)
        .transform(classed, 10, 30)
        .select("p_partkey", "p_name", "list_price", "size_class")
    )


@query("SELECT * FROM supplier")
def table_full_scan(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("wh_supplier")
    return spark.table("wh_supplier")


@query(
    """WITH base AS (SELECT o_custkey, o_totalprice, o_orderdate, o_orderkey FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM base)
    SELECT o_custkey, o_totalprice FROM ranked WHERE rn = 1"""
)
def chained_ctes(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("wh_orders")
    return projection.run(
        spark,
        """WITH base AS (SELECT o_custkey, o_totalprice, o_orderdate, o_orderkey FROM wh_orders),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM base)
        SELECT o_custkey, o_totalprice FROM ranked WHERE rn = 1""",
    )


# --- joins ----------------------------------------------------------------------------------

RICH = "c_acctbal >= 0"


def _rich(spark, sf):
    return table(spark, sf, "customer").filter(RICH)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def join_inner(spark, sf):
    return (
        table(spark, sf, "orders")
        .join(_rich(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name")
    )


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def join_left(spark, sf):
    return (
        table(spark, sf, "orders")
        .join(_rich(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select("o_orderkey", "c_name")
    )


@query(
    """SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000)
    RIGHT JOIN customer ON o_custkey = c_custkey"""
)
def join_right(spark, sf):
    return (
        table(spark, sf, "orders")
        .filter("o_totalprice > 450000")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
        .select("o_orderkey", "c_custkey")
    )


@query(
    """SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000)
    FULL JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey"""
)
def join_full(spark, sf):
    return (
        table(spark, sf, "orders")
        .filter("o_totalprice > 450000")
        .join(_rich(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "full")
        .select("o_orderkey", "c_custkey")
    )


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def join_semi(spark, sf):
    return (
        table(spark, sf, "orders")
        .join(_rich(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .select("o_orderkey")
    )


@query(
    """SELECT 'clean' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN
        (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
    UNION ALL SELECT 'with null', c_custkey FROM customer WHERE c_custkey NOT IN
        (SELECT CASE WHEN o_totalprice > 499000 THEN NULL ELSE o_custkey END FROM orders WHERE o_totalprice > 300000)"""
)
def anti_join_null_aware(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    big = table(spark, sf, "orders").filter("o_totalprice > 300000")
    clean = big.select(F.col("o_custkey").alias("k"))
    holed = big.select(F.when(F.col("o_totalprice") <= 499000, F.col("o_custkey")).alias("k"))
    return (
        joins.anti_join(people, clean, "k")
        .select(F.lit("clean").alias("side"), "k")
        .unionByName(joins.anti_join(people, holed, "k").select(F.lit("with null").alias("side"), "k"))
    )


@query(
    """SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM
        (SELECT CASE WHEN o_totalprice > 499000 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_totalprice > 300000) b
        WHERE b.k = c_custkey)"""
)
def anti_join_not_exists(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    holed = (
        table(spark, sf, "orders")
        .filter("o_totalprice > 300000")
        .select(F.when(F.col("o_totalprice") <= 499000, F.col("o_custkey")).alias("k"))
    )
    return joins.anti_join(people, holed, "k", null_aware=False)


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, sf):
    return joins.join_small(
        table(spark, sf, "supplier"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"]
    ).select("s_suppkey", "s_name", "n_name")


@query(
    """SELECT e.event_type, count(*) AS n, round(sum(value), 2) AS total, count(n_name) AS named FROM events e
    LEFT JOIN (SELECT n_name, CASE n_nationkey WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase'
        WHEN 3 THEN 'error' END AS event_type FROM nation) n ON n.event_type = e.event_type GROUP BY e.event_type"""
)
def join_salted(spark, sf):
    # five event types: every key is hot at scale, whatever the table size
    key = F.col("n_nationkey")
    names = table(spark, sf, "nation").select(
        "n_name",
        F.when(key == 0, "view").when(key == 1, "click").when(key == 2, "purchase").when(key == 3, "error").alias("event_type"),
    )
    joined = joins.join_skewed(
        table(spark, sf, "events").select("event_type", "value", "event_id"), names, ["event_type"], "left", salt=16, max_rows=1000
    )
    return joined.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count("n_name").alias("named")
    )


@query("SELECT event_id, doc_id, quality FROM events JOIN labels ON user_id = doc_id")
def join_skewed_adaptive(spark, sf):
    """Hot users are left to the adaptive skew join."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), F.col("doc_id"), "quality")
    return joins.join_skewed(table(spark, sf, "events").select("event_id", "user_id"), labels, ["user_id"]).drop("user_id")


@query(
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0)
        ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000"""
)
def star_join(spark, sf):
    return (
        table(spark, sf, "orders")
        .filter("o_totalprice > 100000")
        .join(_rich(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query(
    with_cte("customers", "SELECT o_orderkey, o_totalprice FROM orders JOIN customers ON o_custkey = customer_id WHERE region = 'EUROPE'")
)
def join_dimension_filter(spark, sf):
    dim = customers(spark, sf)
    return (
        table(spark, sf, "orders")
        .join(dim, F.col("o_custkey") == dim.customer_id)
        .filter(F.col("region") == "EUROPE")
        .select("o_orderkey", "o_totalprice")
    )


@query(
    """SELECT o_orderkey, coalesce(segment, 'UNKNOWN') AS segment FROM orders LEFT JOIN
        (SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal > 1000) ON o_custkey = c_custkey"""
)
def lookup_default(spark, sf):
    dim = (
        table(spark, sf, "customer")
        .filter("c_acctbal > 1000")
        .select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.lookup(orders, dim, "o_custkey", ["segment"], ["segment"]).select("o_orderkey", "segment")


@query(
    """WITH RECURSIVE edges AS (
        SELECT 'R' || r_regionkey AS parent, 'N' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey
        UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
        UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders),
    tree AS (SELECT 'R' || r_regionkey AS node, CAST(0 AS BIGINT) AS depth, 'R' || r_regionkey AS path FROM region
        UNION ALL SELECT child, depth + 1, path || '/' || child FROM tree JOIN edges ON parent = node)
    SELECT node, depth, path, false AS cycle FROM tree"""
)
def hierarchy_expansion(spark, sf):
    def edge(name, p, parent, c, child):
        return table(spark, sf, name).select(
            F.concat(F.lit(p), parent).alias("parent"), F.concat(F.lit(c), child).alias("child")
        )

    edges = (
        edge("nation", "R", "n_regionkey", "N", "n_nationkey")
        .unionByName(edge("customer", "N", "c_nationkey", "C", "c_custkey"))
        .unionByName(edge("orders", "C", "o_custkey", "O", "o_orderkey"))
    )
    roots = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return joins.expand_hierarchy(edges, roots)


@query(
    """WITH RECURSIVE edges AS (SELECT c_custkey AS parent, (c_custkey // 10) * 10 + (c_custkey + 1) % 10 AS child FROM customer),
    tree AS (SELECT c_custkey AS node, CAST(0 AS BIGINT) AS depth, [c_custkey] AS held, false AS cycle FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT child, depth + 1, list_append(held, child), list_contains(held, child) FROM tree JOIN edges ON parent = node WHERE NOT cycle)
    SELECT node, depth, cycle FROM tree"""
)
def hierarchy_with_cycles(spark, sf):
    """Rings of ten customers: each path ends where it meets itself."""
    key = F.col("c_custkey")
    people = table(spark, sf, "customer")
    ring = (F.floor(key / 10) * 10 + (key + 1) % 10).cast("bigint")
    edges = people.select(key.alias("parent"), ring.alias("child"))
    return joins.expand_hierarchy(edges, people.filter(key % 10 == 0).select(key.alias("node"))).drop("path")


# --- aggregates -----------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total,
        round(avg(l_quantity) + 1e-9, 6) AS avg_quantity, count(shipped) AS n_shipped, round(avg(shipped) + 1e-9, 6) AS avg_shipped
    FROM (SELECT *, CASE WHEN l_shipdate < DATE '1996-01-01' THEN l_extendedprice END AS shipped FROM lineitem) GROUP BY l_returnflag, l_linestatus"""
)
def group_totals(spark, sf):
    """Totals and averages per group; the prices of later shipments are NULL and count for no average."""
    shipped = F.when(F.col("l_shipdate") < "1996-01-01", F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        average("l_quantity").alias("avg_quantity"),
        F.count(shipped).alias("n_shipped"),
        average(shipped).alias("avg_shipped"),
    )


@query(
    """SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f_count,
        sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o_count,
        sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p_count FROM orders GROUP BY o_orderpriority"""
)
def conditional_counts(spark, sf):
    return agg.count_by_value(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def group_by_day(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("SELECT count(*) AS n FROM lineitem")
def global_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 15")
def value_counts_top(spark, sf):
    return agg.value_counts(table(spark, sf, "documents"), "source", 15)


@query("SELECT sum(TRY_CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE)) AS total FROM events WHERE event_type <> 'error'")
def numeric_sum_of_text(spark, sf):
    # errors keep their JSON text, which is no number and drops out
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.regexp_replace("props", r'\{"k": |\}', ""))
    return agg.numeric_sum(table(spark, sf, "events").select(text.alias("v")), "v")


@query(
    """SELECT user_id, bool_or(event_type = 'error') AS has_error, bool_or(value > 95) AS has_large,
        count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id"""
)
def any_and_count_if(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    return agg.flags_and_counts(
        table(spark, sf, "events"),
        ["user_id"],
        {"has_error": kind == "error", "has_large": value > 95},
        {"purchases": kind == "purchase"},
    )


@query(
    """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS items
    FROM lineitem GROUP BY l_orderkey"""
)
def collect_sorted_lists(spark, sf):
    return agg.collect_sorted(table(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey").withColumn(
        "items", F.concat_ws(",", "items")
    )


@query(
    """SELECT l_returnflag, chunk_no, count(*) AS n, min(l_partkey) AS first, max(l_partkey) AS last FROM
        (SELECT l_returnflag, l_partkey, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) - 1) // 1000 AS chunk_no FROM lineitem)
    GROUP BY l_returnflag, chunk_no"""
)
def collect_sorted_chunks(spark, sf):
    """Lists of hot keys in rows of a thousand items."""
    lists = agg.collect_sorted(table(spark, sf, "lineitem"), ["l_returnflag"], "l_partkey", chunk=1000)
    return lists.select(
        "l_returnflag", "chunk_no", F.size("items").cast("bigint").alias("n"),
        F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"),
    )


@query(
    """SELECT user_id, event_type, event_id AS first_event FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""
)
def distinct_first_seen(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return agg.distinct_first(events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", F.col("event_id").alias("first_event")
    )


@query(
    """SELECT user_id, event_type AS last_type, value AS last_value FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def last_value_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return agg.last_by(events, ["user_id"], ["ts", "event_id"]).select(
        "user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value")
    )


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
        count(DISTINCT {c}) AS "distinct", CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest,
        avg(length(CAST({c} AS VARCHAR))) AS avg_length, max(length(CAST({c} AS VARCHAR))) AS max_length FROM t"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "segment_if_rich")
    ).join(
        [
            "WITH t AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment,"
            " CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment_if_rich FROM customer) ",
            "",
        ]
    )
)
def column_profile(spark, sf):
    people = table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        "c_mktsegment",
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment_if_rich"),
    )
    return agg.profile(people)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
        true AS near_exact FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    )
)
def column_profile_approx(spark, sf):
    """The sketch-based profile, with its distinct counts held against exact ones (within 15 %)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    exact = agg.profile(lines).select("column", F.col("distinct").alias("_exact"))
    near = F.abs(F.col("distinct") - F.col("_exact")) <= 0.15 * F.col("_exact")
    return agg.profile(lines, approx=True).join(exact, "column").select("column", "rows", "nulls", near.alias("near_exact"))


# --- windows --------------------------------------------------------------------------------


@query(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events"""
)
def window_row_number(spark, sf):
    return win.with_row_number(
        table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["-value", "event_id"]
    ).drop("value")


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS rnk FROM events")
def window_rank(spark, sf):
    return win.with_rank(
        table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], ["-value"], max_rows=1_000_000
    ).select("event_id", "rnk")


@query("SELECT event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS dense_rnk FROM events")
def window_dense_rank(spark, sf):
    return win.with_dense_rank(
        table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], ["-value"], max_rows=1_000_000
    ).select("event_id", "dense_rnk")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total_spent FROM orders")
def window_partition_sum(spark, sf):
    return win.with_partition_sum(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "total_spent"
    ).select("o_orderkey", F.round("total_spent", 2).alias("total_spent"))


@query("SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events")
def window_lag(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return win.with_lag(events, ["user_id"], ["ts", "event_id"], "value", "prev_value").select("event_id", "prev_value")


@query("SELECT event_id, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def window_lead(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return win.with_lead(events, ["user_id"], ["ts", "event_id"], "event_type", "next_type").select("event_id", "next_type")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def latest_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return win.latest_per_key(orders, ["o_custkey"], ["-o_orderdate", "-o_orderkey"]).drop("o_orderdate")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"""
)
def top_orders_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return win.top_n_per_key(orders, ["o_custkey"], ["-o_totalprice", "o_orderkey"], 3)


@query("SELECT event_id, event_type FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY value DESC) <= 2")
def qualify_rank(spark, sf):
    from pyspark.sql import Window

    events = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    ranked = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value")))
    return win.qualify(events, ranked, lambda r: r <= 2).select("event_id", "event_type")


_PERIODS = """WITH p AS (SELECT DISTINCT o_custkey AS customer, CAST(o_orderdate AS DATE) AS start,
        CAST(o_orderdate AS DATE) + 60 AS finish FROM orders),
    f AS (SELECT *, max(finish) OVER (PARTITION BY customer ORDER BY start, finish
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
    g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER
        (PARTITION BY customer ORDER BY start, finish ROWS UNBOUNDED PRECEDING) AS grp FROM f)
    SELECT customer, min(start) AS start, max(finish) AS finish FROM g GROUP BY customer, grp"""


@query(_PERIODS)
def merge_order_periods(spark, sf):
    start = F.to_date("o_orderdate")
    periods = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), start.alias("start"), F.date_add(start, 60).alias("finish")
    )
    return win.merge_periods(periods, ["customer"], "start", "finish")


@query(_PERIODS.replace("o_custkey AS customer", "o_custkey % 3 AS customer").replace("+ 60", "+ 1"))
def merge_order_periods_hot(spark, sf):
    """Periods of three groups of customers, taken as hot keys."""
    start = F.to_date("o_orderdate")
    periods = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 3).alias("customer"), start.alias("start"), F.date_add(start, 1).alias("finish")
    )
    return win.merge_periods(periods, ["customer"], "start", "finish", max_rows=300)


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS surrogate FROM orders")
def surrogate_keys(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return win.with_row_id(orders, ["o_orderdate", "o_orderkey"], "surrogate", start=1001).drop("o_orderdate")


@query("SELECT 1 AS one, 'x' AS letter, count(*) AS orders FROM orders")
def query_without_from(spark, sf):
    """A query with no table, whose parameters are a text and the count of one."""
    count = table(spark, sf, "orders").count()
    return projection.run(spark, "SELECT 1 AS one, :letter AS letter, :orders AS orders", {"letter": "x", "orders": count})


@query("SELECT n_nationkey, n_name, n_regionkey, c FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def rows_from_the_driver(spark, sf):
    """The 25 nations as rows of the driver, joined with the customers per nation."""
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = src.from_rows(spark, [tuple(r) for r in nations.collect()], nations.schema)
    people = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return people.join(F.broadcast(rows), F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey")


@query(
    """SELECT p_type AS declared, CASE WHEN p_type LIKE '%STEEL%' THEN 'decimal(10,2)' WHEN p_type LIKE '%BRASS%' THEN 'int' ELSE 'string' END AS spark_type,
    count(*) AS n FROM part GROUP BY ALL"""
)
def schema_from_type_names(spark, sf):
    """Spark types of declared type names, one per part type: decimals, integers and unknown ones."""
    kinds = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    # the part types are a fixed set of names
    names = {r["p_type"]: "DECIMAL(18, 4)" if "STEEL" in r["p_type"] else "int" if "BRASS" in r["p_type"] else "Geometry" for r in kinds.collect()}
    struct = synthetic.to_struct({n.replace(" ", "_"): t for n, t in names.items()})
    types = spark.createDataFrame([(n, f.dataType.simpleString()) for n, f in zip(names, struct.fields, strict=True)], "declared string, spark_type string")
    return kinds.join(F.broadcast(types), F.col("p_type") == F.col("declared")).select("declared", "spark_type", "n")


# --- sorting, top-N, layout -----------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def global_sort(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten_orders(spark, sf):
    return layout.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 10)


@query(
    """SELECT name, n FROM (SELECT event_type || '-' || user_id AS name,
        sum(CASE WHEN event_type = 'error' THEN NULL ELSE 1 END)::DOUBLE AS n FROM events GROUP BY 1)
    WHERE n IS NOT NULL ORDER BY n DESC, name LIMIT 15"""
)
def top_usage_by_count(spark, sf):
    usage = (
        table(spark, sf, "events")
        .groupBy(F.concat("event_type", F.lit("-"), "user_id").alias("name"), "event_type")
        .agg(F.count("*").alias("calls"))
        .select("name", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("calls").cast("string")).alias("calls"))
    )
    return agg.top_usage(usage, "name", "calls")


@query("SELECT lang || '/' || source AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY min(doc_id) LIMIT 12")
def first_categories(spark, sf):
    categories = (
        table(spark, sf, "documents")
        .groupBy(F.concat("lang", F.lit("/"), "source").alias("category"))
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    )
    return agg.first_n(categories, ["first_doc"]).select("category", "n")


@query("SELECT o_custkey, o_orderkey FROM orders")
def distribute_and_sort(spark, sf):
    return layout.distribute(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_custkey", "-o_orderkey"])


@query("SELECT s_name FROM supplier ORDER BY s_name <> 'Supplier#000000007', s_name")
def pinned_first_row(spark, sf):
    return layout.pinned_sort(table(spark, sf, "supplier").select("s_name"), "s_name", "Supplier#000000007")


@query("SELECT * FROM supplier ORDER BY s_suppkey, s_name LIMIT 5")
def bounded_sample(spark, sf):
    return layout.sample_rows(table(spark, sf, "supplier"), 5)


# --- sets -----------------------------------------------------------------------------------


@query(
    """SELECT side, copies, o_orderkey, o_totalprice FROM (
        (SELECT 'left' AS side, CAST(1 AS BIGINT) AS copies, o_orderkey, o_totalprice FROM orders
            WHERE o_orderstatus = 'P' AND o_totalprice > 100000)
        UNION ALL (SELECT 'right', CAST(1 AS BIGINT), o_orderkey, o_totalprice + 1 FROM orders
            WHERE o_orderstatus = 'P' AND o_totalprice > 100000))"""
)
def row_difference(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)
    new = old.withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rec.diff_rows(old, new).drop("o_orderstatus")


@query(
    """SELECT k, min(pos) AS pos FROM (SELECT o_custkey AS k, 1 AS pos FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal < 1000) GROUP BY k"""
)
def ordered_union(spark, sf):
    from warehaul.operators.sets import union_first

    rich = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), F.lit(1).alias("pos"))
    poor = table(spark, sf, "customer").filter("c_acctbal < 1000").select(F.col("c_custkey").alias("k"), F.lit(2).alias("pos"))
    return union_first([rich, poor], ["k"], ["pos"])


# --- row generation -------------------------------------------------------------------------


@query("SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS item FROM lineitem")
def explode_item_list(spark, sf):
    lists = (
        agg.collect_sorted(table(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey")
        .select(F.col("l_orderkey").alias("order_id"), F.concat_ws(",", "items").alias("items"))
    )
    return projection.explode_delimited(lists, "items").select("order_id", "item")


@query("SELECT vec_id, pos, CAST(embedding[pos] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)")
def explode_array_column(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("x").cast("double").alias("x"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, field, value FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS field, l_quantity AS value FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'price', l_extendedprice FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem)"""
)
def flatten_repeated_fields(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
    )
    return projection.flatten(rows, ["quantity", "price", "tax"])


@query(
    """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, parts[line_no] AS line FROM (
        SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line_no FROM (
            SELECT doc_id, CASE WHEN all_parts[-1] = '' THEN all_parts[:-2] ELSE all_parts END AS parts FROM (
                SELECT doc_id, string_split(text, chr(10)) AS all_parts FROM documents)))"""
)
def text_lines(spark, sf):
    return projection.to_lines(table(spark, sf, "documents"), "doc_id", "text")


@query(with_cte("sales customers products", """SELECT category, city, round(sum(amount), 2) AS total_sales,
    count(*) AS total_orders, round(avg(amount) + 1e-9, 6) AS avg_sales
    FROM sales LEFT JOIN customers USING (customer_id) JOIN products USING (product_id) GROUP BY category, city"""))
def sales_by_category_city(spark, sf):
    base = (
        sales(spark, sf)
        .join(customers(spark, sf).select("customer_id", "city"), "customer_id", "left")
        .join(products(spark, sf).select("product_id", "category"), "product_id")
    )
    return base.groupBy("category", "city").agg(
        F.round(F.sum("amount"), 2).alias("total_sales"),
        F.count("*").alias("total_orders"),
        average("amount").alias("avg_sales"),
    )


REPORT_DAYS = ("1998-01-01", "1998-12-31")


@query(
    with_cte(
        "fact_orders customers",
        f"""SELECT CAST(order_date AS DATE) AS order_day, region, count(order_id) AS order_count,
        round(sum(total_amount), 2) AS total_revenue, round(avg(total_amount) + 1e-9, 6) AS avg_order_value,
        count(*) FILTER (WHERE discount_tier = 'GOLD') AS gold_count,
        count(*) FILTER (WHERE discount_tier = 'SILVER') AS silver_count,
        count(*) FILTER (WHERE discount_tier = 'BRONZE') AS bronze_count
    FROM fact_orders JOIN customers USING (customer_id)
    WHERE CAST(order_date AS DATE) BETWEEN DATE '{REPORT_DAYS[0]}' AND DATE '{REPORT_DAYS[1]}'
    GROUP BY 1, 2 ORDER BY region""",
    )
)
def report_order_summary(spark, sf):
    """Orders, revenue and tiers per day and region for a span of report days, region parameter ALL."""
    fact_orders(spark, sf).createOrReplaceTempView("wh_fact_orders")
    customers(spark, sf).createOrReplaceTempView("wh_customers")
    return projection.run(
        spark,
        """SELECT CAST(o.order_date AS DATE) AS order_day, c.region, count(o.order_id) AS order_count,
            round(sum(o.total_amount), 2) AS total_revenue, round(avg(o.total_amount) + 1e-9, 6) AS avg_order_value,
            count_if(o.discount_tier = 'GOLD') AS gold_count,
            count_if(o.discount_tier = 'SILVER') AS silver_count,
            count_if(o.discount_tier = 'BRONZE') AS bronze_count
        FROM wh_fact_orders o JOIN wh_customers c ON o.customer_id = c.customer_id
        WHERE o.order_date >= CAST(:first AS DATE) AND o.order_date < date_add(CAST(:last AS DATE), 1)
          AND (:region = 'ALL' OR c.region = :region)
        GROUP BY 1, 2 ORDER BY region, order_day""",
        {"first": REPORT_DAYS[0], "last": REPORT_DAYS[1], "region": "ALL"},
    )


@query(
    with_cte(
        "fact_orders customers",
        f"""SELECT order_id, order_date, name || ' ' || city AS customer_name, region, total_amount, discount_tier, status
    FROM fact_orders JOIN customers USING (customer_id) WHERE CAST(order_date AS DATE) >= DATE '{AS_OF}'
    ORDER BY total_amount DESC, order_id LIMIT 10""",
    )
)
def report_top_orders(spark, sf):
    """The ten largest orders from a report day on, cut to ten rows before the customer join."""
    first = F.to_date(F.lit(AS_OF))
    best = layout.top_n(fact_orders(spark, sf).filter(F.col("order_date") >= first), ["-total_amount", "order_id"], 10)
    # ten rows: a proven bound for the broadcast
    return (
        customers(spark, sf)
        .join(F.broadcast(best), "customer_id")
        .select(
            "order_id", "order_date", F.concat("name", F.lit(" "), "city").alias("customer_name"),
            "region", "total_amount", "discount_tier", "status",
        )
        .orderBy(F.desc("total_amount"), "order_id")
    )


_CUSTOMER_WINDOWS = with_cte(
        "sales",
        """SELECT customer_id, order_id, product_id, amount,
        row_number() OVER w AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS dense_rnk,
        round(sum(amount) OVER (PARTITION BY customer_id), 2) AS total_spent,
        lag(amount, 1) OVER d AS prev_amt, lead(amount, 1) OVER d AS next_amt
    FROM sales
    WINDOW w AS (PARTITION BY customer_id ORDER BY amount DESC, order_id, product_id, quantity),
        v AS (PARTITION BY customer_id ORDER BY amount DESC),
        d AS (PARTITION BY customer_id ORDER BY order_date, order_id, product_id, quantity, amount)""",
    )


@query(_CUSTOMER_WINDOWS)
def customer_windows(spark, sf):
    """Six window results per order line of a customer."""
    return _customer_windows(spark, sf, win.HOT_ROWS)


@query(_CUSTOMER_WINDOWS.replace("FROM sales\n", "FROM (SELECT * REPLACE (customer_id % 3 AS customer_id) FROM sales)\n"))
def customer_windows_hot(spark, sf):
    """The same over three groups of customers, taken as hot keys, whose rows are cut into pieces."""
    return _customer_windows(spark, sf, 1500, F.col("customer_id") % 3)


def _customer_windows(spark, sf, max_rows, key="customer_id"):
    # the windows read their input more than once, so the join is written out first
    base, at = handed_on(sales(spark, sf).withColumn("customer_id", F.col(key) if isinstance(key, str) else key), "sales")
    ties = ["order_id", "product_id", "quantity", "amount"]
    return win.window_tour(
        base, ["customer_id"], value="amount", by_value=["-amount"], ties=ties, by_time=["order_date"], max_rows=max_rows, source=at
    ).select(
        "customer_id", "order_id", "product_id", "amount", "rn", "rnk", "dense_rnk",
        F.round("total_spent", 2).alias("total_spent"), "prev_amt", "next_amt",
    )
