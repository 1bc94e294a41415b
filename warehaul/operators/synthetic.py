"""Synthetic tables from ``{column: type}``: every value is a hash of row id, column and seed.

The same id always gives the same row, whatever the number of partitions, and no row passes the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warehaul.functions.fixed_values import SYNTHETIC_TYPES

log = logging.getLogger(__name__)

WORD_LETTERS = "etaoinshrdlu"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST_MOMENT = 1_700_000_000  # end of the three years that timestamps cover
THREE_YEARS = 3 * 365 * 86_400


def base_type(declared: str) -> str:
    """Type name without precision; unknown types read as STRING, with a warning."""
    name = declared.split("(")[0].strip().upper()
    if name not in SYNTHETIC_TYPES:
        log.warning("unknown type %r, using STRING", declared)
        return "STRING"
    return name


def to_struct(schema: Mapping[str, str]) -> StructType:
    """Spark schema of a synthetic table."""
    return StructType.fromDDL(", ".join(f"`{n}` {SYNTHETIC_TYPES[base_type(t)][0]}" for n, t in schema.items()))


def _value(row: Column, column: str, declared: str, seed: int) -> Column:
    name = base_type(declared)
    spark_type, low, high = SYNTHETIC_TYPES[name]

    def draw(n: int, salt: int = 0) -> Column:
        return F.pmod(F.xxhash64(row, F.lit(column), F.lit(seed), F.lit(salt)), F.lit(n))

    if name in ("INT", "BIGINT", "SMALLINT", "TINYINT"):
        return (draw(high - low + 1) + low).cast(spark_type)
    if name == "FLOAT":
        return (draw(high * 10_000 + 1) / 10_000).cast(spark_type)
    if name == "DOUBLE":
        return (draw(high * 1_000_000 + 1) / 1_000_000).cast(spark_type)
    if name == "DECIMAL":
        return (draw(round(high * 100) + 1).cast("decimal(18,0)") / F.lit(100)).cast(spark_type)
    if name == "BOOLEAN":
        return draw(2) == 1
    if name == "DATE":
        return F.date_add(F.to_date(F.lit(low)), draw(high + 1).cast("int")).cast("string")
    if name == "TIMESTAMP":
        return F.date_format(F.timestamp_seconds(F.lit(LAST_MOMENT) - draw(THREE_YEARS)), "yyyy-MM-dd HH:mm:ss")
    if name == "BINARY":
        return F.unhex(F.lit("00"))
    if name == "CHAR":
        return F.substring(F.lit(LETTERS), (draw(len(LETTERS)) + 1).cast("int"), F.lit(1))
    letters = [
        F.substring(F.lit(WORD_LETTERS), (draw(len(WORD_LETTERS), i) + 1).cast("int"), F.lit(1)) for i in range(5)
    ]
    return F.concat(*letters)


def synthesize_for(df: DataFrame, id_col: str, schema: Mapping[str, str], seed: int = 42) -> DataFrame:
    """Synthetic columns beside the ids of an existing table."""
    return df.select(id_col, *[_value(F.col(id_col), c, t, seed).alias(c) for c, t in schema.items()])


def synthesize(spark: SparkSession, schema: Mapping[str, str], n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` synthetic rows, made on the executors."""
    return synthesize_for(spark.range(n).withColumnRenamed("id", "_row"), "_row", schema, seed).drop("_row")


def register_all(spark: SparkSession, tables: Mapping[str, Mapping[str, str]], n: int = 100, seed: int = 42) -> list[str]:
    """Register one synthetic view per table; tables without columns are skipped."""
    made = [name for name, schema in tables.items() if schema]
    for name in made:
        synthesize(spark, tables[name], n, seed).createOrReplaceTempView(name)
    return made
