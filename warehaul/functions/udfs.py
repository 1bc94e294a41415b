"""User functions: SQL functions that stay in the JVM, and Arrow-batched functions where they must be Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv


def register_function(spark: SparkSession, name: str, fn: Callable[..., pd.Series], return_type: str) -> None:
    """Make a pandas function callable by name from SQL; it gets Arrow batches, not rows."""
    spark.udf.register(name, F.pandas_udf(fn, return_type))


def create_stock_functions(spark: SparkSession) -> None:
    """``stock_level(qty)`` and ``reorder_alert(qty, point)`` as SQL functions."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION stock_level(qty INT) RETURNS STRING RETURN CASE
            WHEN qty = 0 THEN '{fv.STOCK_OUT}' WHEN qty < {fv.STOCK_BOUND} THEN '{fv.STOCK_LOW} (' || qty || ')'
            ELSE '{fv.STOCK_OK} (' || qty || ')' END"""
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION reorder_alert(qty INT, point INT) RETURNS BOOLEAN RETURN qty <= point"
    )


def stock_level(qty: Column) -> Column:
    """The same as a column expression."""
    shown = qty.cast("string")
    return (
        F.when(qty == 0, fv.STOCK_OUT)
        .when(qty < fv.STOCK_BOUND, F.concat(F.lit(f"{fv.STOCK_LOW} ("), shown, F.lit(")")))
        .otherwise(F.concat(F.lit(f"{fv.STOCK_OK} ("), shown, F.lit(")")))
    )


def reorder_alert(qty: Column, point: Column) -> Column:
    return qty <= point


def map_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches; a batch is bounded, a partition or group is never held whole."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)
