"""Queries: scalar functions and user functions over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from warehaul.functions import scalar, udfs
from warehaul.plans.tables import AS_OF, sales, table, with_cte
from warehaul.registry import query


@query(
    with_cte(
        "sales",
        f"""SELECT order_id, product_id, 'C' || customer_id AS key_upper, 'c' || customer_id AS key_lower, substr('C' || customer_id, 1, 3) AS key_start,
        CAST(length('C' || customer_id) AS INTEGER) AS key_length, customer_id || '_' || product_id AS customer_product,
        round(amount, 2) AS amount_rounded, CAST(ceil(amount) AS BIGINT) AS amount_up, CAST(floor(amount) AS BIGINT) AS amount_down,
        strftime(order_date, '%Y-%m-%d') || ' 00:00:00' AS ordered_at, CAST(DATE '{AS_OF}' - order_date AS BIGINT) AS age_days,
        CASE WHEN amount > 60000 THEN 'HIGH' WHEN amount > 30000 THEN 'MEDIUM' ELSE 'LOW' END AS band,
        CASE WHEN quantity < 10 THEN 'UNKNOWN' ELSE CAST(customer_id AS VARCHAR) END AS bulk_customer,
        CAST(trunc(amount) AS INTEGER) AS amount_whole FROM sales""",
    )
)
def function_tour(spark, sf):
    """String, number, date, conditional, NULL and cast functions on every order line."""
    lines = sales(spark, sf).withColumn("key", F.concat(F.lit("C"), "customer_id"))
    amount, day = F.col("amount"), F.col("order_date")
    return lines.select(
        "order_id",
        "product_id",
        F.upper("key").alias("key_upper"),
        F.lower("key").alias("key_lower"),
        F.substring("key", 1, 3).alias("key_start"),
        F.length("key").alias("key_length"),
        F.concat_ws("_", "customer_id", "product_id").alias("customer_product"),
        F.round(amount, 2).alias("amount_rounded"),
        F.ceil(amount).alias("amount_up"),
        F.floor(amount).alias("amount_down"),
        F.from_unixtime(F.unix_timestamp(day.cast("string"), "yyyy-MM-dd")).alias("ordered_at"),
        F.datediff(F.lit(AS_OF).cast("date"), day).cast("bigint").alias("age_days"),
        F.when(amount > 60000, "HIGH").when(amount > 30000, "MEDIUM").otherwise("LOW").alias("band"),
        F.nvl(F.when(F.col("quantity") >= 10, F.col("customer_id").cast("string")), F.lit("UNKNOWN")).alias("bulk_customer"),
        amount.cast("int").alias("amount_whole"),
    )


@query(
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS unix_seconds,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_text, strftime(o_orderdate, '%Y%m%d') AS compact,
        CAST(o_orderdate AS DATE) + 30 AS due, CAST(o_orderdate AS DATE) - 1 AS day_before,
        strftime(o_orderdate, '%m/%d/%Y') AS shown, o_orderdate AS as_timestamp,
        CAST(epoch(o_orderdate) * 1000 AS BIGINT) AS millis, NULL::BIGINT AS bad_millis FROM orders"""
)
def date_functions(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    seconds = F.unix_timestamp(day, "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        seconds.alias("unix_seconds"),
        F.from_unixtime(seconds).alias("as_text"),
        F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd").alias("compact"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("due"),
        F.date_sub(F.to_date("o_orderdate"), 1).alias("day_before"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("shown"),
        F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("as_timestamp"),
        scalar.epoch_millis(F.concat(day, F.lit("T00:00Z"))).alias("millis"),
        scalar.epoch_millis(F.concat(day, F.lit(" noon"))).alias("bad_millis"),
    )


@query(
    """SELECT o_orderkey, true AS after_order, true AS same_day, 'bigint' AS kind FROM orders"""
)
def current_time_functions(spark, sf):
    """Current date, time and seconds beside every order; shown as facts that hold on any day."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (F.current_date() > F.to_date("o_orderdate")).alias("after_order"),
        (F.to_date(F.current_timestamp()) == F.current_date()).alias("same_day"),
        F.typeof(F.unix_timestamp()).alias("kind"),
    )


@query(
    """SELECT c_custkey, coalesce(seg, 'NONE') AS nvl_seg, CASE WHEN seg IS NOT NULL THEN 'known' ELSE 'missing' END AS nvl2_seg,
        CASE seg WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS decoded,
        coalesce(bal, 0) AS zero_if_null, nullif(c_nationkey, 0) AS null_if_zero, nullif(c_mktsegment, 'HOUSEHOLD') AS nulled,
        CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side FROM (
        SELECT *, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer)"""
)
def null_functions(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("wh_customer")
    return spark.sql(
        """SELECT c_custkey, nvl(seg, 'NONE') AS nvl_seg, nvl2(seg, 'known', 'missing') AS nvl2_seg,
            decode(seg, 'BUILDING', 'B', 'MACHINERY', 'M', '?') AS decoded, zeroifnull(bal) AS zero_if_null,
            nullifzero(c_nationkey) AS null_if_zero, nullif(c_mktsegment, 'HOUSEHOLD') AS nulled,
            if(c_acctbal < 0, 'debit', 'credit') AS side
        FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg,
                CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM wh_customer)"""
    )


@query(
    """SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS base,
        regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
        regexp_replace(lower(url), '[-_]+', '_', 'g') AS normal, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS key,
        replace(url, '//', '/') AS replaced, regexp_matches(url, '(?i)EXAMPLE\\.(COM|ORG)') AS known_host,
        array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers, regexp_extract(url, '://([^/]+)', 1) AS host,
        split_part(url, '/', 3) AS third, len(string_split(url, '/')) AS n_parts FROM pages"""
)
def path_functions(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        scalar.parent_path(url).alias("parent"),
        scalar.base_name(url).alias("base"),
        scalar.file_stem(url).alias("stem"),
        scalar.normal_name(url).alias("normal"),
        scalar.task_key(url).alias("key"),
        F.replace(url, F.lit("//"), F.lit("/")).alias("replaced"),
        url.rlike(r"(?i)EXAMPLE\.(COM|ORG)").alias("known_host"),
        F.concat_ws(",", F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0))).alias("numbers"),
        F.regexp_extract(url, "://([^/]+)", 1).alias("host"),
        F.split(url, "/")[2].alias("third"),
        F.size(F.split(url, "/")).alias("n_parts"),
    )


@query(
    """SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS price, round(p_retailprice * 1.075, 4) AS rounded,
        CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down,
        TRY_CAST(p_name AS DOUBLE) AS name_number, CAST(p_size AS VARCHAR) AS size_text FROM part"""
)
def number_functions(spark, sf):
    price = F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey",
        scalar.currency(price).alias("price"),
        F.round(price * 1.075, 4).alias("rounded"),
        F.ceil(price).alias("up"),
        F.floor(price).alias("down"),
        F.col("p_name").try_cast("double").alias("name_number"),
        F.col("p_size").cast("string").alias("size_text"),
    )


@query(
    """SELECT event_id, user_id || ',' || event_type AS joined, list_contains([event_type, lang], 'view') AS has_view,
        event_type AS first_item, NULL::VARCHAR AS missing_item, k AS map_value, NULL::VARCHAR AS missing_key,
        event_type AS effective_kind, 'base' AS effective_env, event_type || ',base' AS distinct_items,
        upper(event_type) AS loud, '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS json_text
    FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'other' END AS lang,
        regexp_extract(props, '([0-9]+)', 1) AS k FROM events)"""
)
def nested_value_functions(spark, sf):
    """Arrays, maps, structs and JSON per event."""
    base = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.array("event_type", F.when(F.col("user_id") % 2 == 0, "view").otherwise("other")).alias("items"),
        F.from_json("props", "map<string,string>").alias("props"),
        F.from_json("props", "struct<k:int>").alias("parsed"),
        F.create_map(F.lit("kind"), F.lit("none"), F.lit("env"), F.lit("base"), F.lit("_note"), F.lit("x")).alias("defaults"),
        F.array(F.concat(F.lit("kind = "), "event_type"), F.lit("flag")).alias("params"),
    )
    effective = scalar.overlay(scalar.without_private(F.col("defaults")), scalar.key_values(F.col("params")))
    return base.withColumn("effective", effective).select(
        "event_id",
        scalar.joined(F.array(F.col("user_id").cast("string"), "event_type")).alias("joined"),
        F.array_contains("items", "view").alias("has_view"),
        F.get("items", F.lit(0)).alias("first_item"),
        F.get("items", F.lit(9)).alias("missing_item"),
        F.coalesce(F.try_element_at("props", F.lit("k")), F.col("parsed.k").cast("string")).alias("map_value"),
        F.try_element_at("props", F.lit("none")).alias("missing_key"),
        F.try_element_at("effective", F.lit("kind")).alias("effective_kind"),
        F.try_element_at("effective", F.lit("env")).alias("effective_env"),
        F.concat_ws(
            ",", F.array_distinct(F.array("event_type", F.try_element_at("effective", F.lit("env")), "event_type"))
        ).alias("distinct_items"),
        F.get(F.transform("items", lambda x: F.upper(x)), F.lit(0)).alias("loud"),
        F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("json_text"),
    )


@query(
    """SELECT p_partkey AS sku, CASE WHEN q = 0 THEN 'OUT OF STOCK' WHEN q < 10 THEN 'LOW (' || q || ')'
        ELSE 'OK (' || q || ')' END AS stock_level, CASE WHEN q <= 12 THEN 'REORDER NOW' ELSE '' END AS reorder
    FROM (SELECT p_partkey, p_size - 1 AS q FROM part)"""
)
def inventory_status(spark, sf):
    """Stock texts and reorder alerts from SQL functions."""
    udfs.create_stock_functions(spark)
    table(spark, sf, "part").select(
        F.col("p_partkey").alias("sku"), (F.col("p_size") - 1).alias("quantity_on_hand"), F.lit(12).alias("reorder_point")
    ).createOrReplaceTempView("wh_inventory")
    return spark.sql(
        """SELECT sku, stock_level(quantity_on_hand) AS stock_level,
            if(reorder_alert(quantity_on_hand, reorder_point), 'REORDER NOW', '') AS reorder FROM wh_inventory"""
    )


@query("SELECT c_custkey, 'X-' || upper(c_name) AS tagged FROM customer")
def named_scalar_function(spark, sf):
    """A Python function called by name from SQL, on Arrow batches."""

    def tagged(names: pd.Series) -> pd.Series:
        return "X-" + names.str.upper()

    udfs.register_function(spark, "wh_tagged", tagged, "string")
    table(spark, sf, "customer").createOrReplaceTempView("wh_customer")
    return spark.sql("SELECT c_custkey, wh_tagged(c_name) AS tagged FROM wh_customer")


@query("SELECT event_id, event_type || ':' || regexp_extract(props, '([0-9]+)', 1) AS result FROM events")
def function_on_nested_values(spark, sf):
    """A function over a map element and an array element, called from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION wh_pair(m MAP<STRING,STRING>, a ARRAY<STRING>)"
        " RETURNS STRING RETURN get(a, 0) || ':' || try_element_at(m, 'k')"
    )
    table(spark, sf, "events").select(
        "event_id", F.from_json("props", "map<string,string>").alias("map_col"), F.array("event_type").alias("array_col")
    ).createOrReplaceTempView("wh_complex")
    return spark.sql("SELECT event_id, wh_pair(map_col, array_col) AS result FROM wh_complex")


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def vectorised_batches(spark, sf):
    """Row norms computed on Arrow batches."""
    import numpy as np

    def norms(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = frame["embedding"].map(lambda v: np.asarray(v, dtype="float64"))
        return pd.DataFrame(
            {"vec_id": frame["vec_id"], "label": frame["label"], "norm": [round(float(np.sqrt(v @ v)), 4) for v in vectors]}
        )

    return udfs.map_partitions(table(spark, sf, "embeddings"), norms, "vec_id bigint, label int, norm double")
