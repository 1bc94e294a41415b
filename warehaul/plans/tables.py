"""The driver's tables and the warehouse-shaped tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD, SILVER = 400_000, 200_000
AS_OF = "1998-06-30"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """customer_id, name, city, region; nation and region are fixed 25- and 5-row tables."""
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
        )
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    )


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """order_id, customer_id, product_id, amount, quantity, order_date per order line."""
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.to_date("o_orderdate").alias("order_date"),
        )
    )


def tier(amount: str = "total_amount") -> Column:
    return (
        F.when(F.col(amount) >= GOLD, "GOLD").when(F.col(amount) >= SILVER, "SILVER").otherwise("BRONZE")
    )


def fact_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with status names and discount tier."""
    status = F.col("o_orderstatus")
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("total_amount"),
            F.when(status == "F", "COMPLETED").when(status == "P", "PENDING").otherwise("OPEN").alias("status"),
        )
        .withColumn("discount_tier", tier())
    )


def average(value: Column | str) -> Column:
    """The average in six digits. The small addend keeps a tie at the last digit from hanging on the order of addition."""
    return F.round(F.avg(value) + F.lit(1e-9), 6)


# The same derived tables as DuckDB common table expressions.
CTE = {
    "customers": """customers AS (
        SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "products": """products AS (
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category FROM part)""",
    "sales": """sales AS (
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
               l_extendedprice AS amount, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(o_orderdate AS DATE) AS order_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "fact_orders": f"""fact_orders AS (
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
               o_totalprice AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PENDING' ELSE 'OPEN' END AS status,
               CASE WHEN o_totalprice >= {GOLD} THEN 'GOLD' WHEN o_totalprice >= {SILVER} THEN 'SILVER'
                    ELSE 'BRONZE' END AS discount_tier
        FROM orders)""",
}


def with_cte(names: str, body: str) -> str:
    """DuckDB text: the named derived tables, then ``body``."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + " " + body
