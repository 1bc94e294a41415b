"""Aggregates. All of them combine on the map side, so hot groups shrink before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.operators.windows import sort_columns, top_n_per_key, with_row_number


def count_by_value(df: DataFrame, keys: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """One count column per value: the conditional aggregate that pivots a tier to columns."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(col) == v).alias(f"{v.lower()}_count") for v in values])


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts per value, most frequent first, ties by value; NULLs are not counted."""
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), col)
    )
    return counts if n is None else counts.limit(n)


def numeric_sum(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    """Sum of a text column read as numbers; NULL and non-numeric values drop."""
    return df.agg(F.sum(F.col(col).try_cast("double")).alias(name))


def flags_and_counts(
    df: DataFrame, keys: Sequence[str], any_of: Mapping[str, Column], count_of: Mapping[str, Column]
) -> DataFrame:
    """Per group: does any row satisfy a test (never NULL), and how many rows satisfy a test."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in any_of.items()],
        *[F.count_if(test).alias(name) for name, test in count_of.items()],
    )


def collect_sorted(
    df: DataFrame, keys: Sequence[str], col: str, name: str = "items", chunk: int | None = None
) -> DataFrame:
    """Ordered list per key, one row each.

    With ``chunk`` a list is cut into rows of so many items, numbered by ``chunk_no``: no single row
    or task then has to hold a whole hot group.
    """
    items = df.filter(F.col(col).isNotNull()).select(*keys, col)
    if chunk is None:
        return items.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias(name))
    numbered = with_row_number(items, keys, [col], "_rn")
    return (
        numbered.withColumn("chunk_no", F.floor((F.col("_rn") - 1) / chunk))
        .groupBy(*keys, "chunk_no")
        .agg(F.sort_array(F.collect_list(col)).alias(name))
    )


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first appearance of every key, in order of appearance."""
    return top_n_per_key(df, keys, order, 1).orderBy(*sort_columns(order))


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``: the last value wins."""
    flipped = [c[1:] if c.startswith("-") else f"-{c}" for c in order]
    return top_n_per_key(df, keys, flipped, 1)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Column statistics: rows, NULLs, distinct values, smallest, largest, average and longest length.

    One aggregate over the table. Exact distinct counts come from (column, value) pairs that are
    combined on the map side; ``approx`` uses a sketch in the first aggregate instead.
    """
    names = df.columns
    text = {c: F.col(c).cast("string") for c in names}
    aggs = []
    for c in names:
        aggs += [
            F.count("*").alias(f"{c}|rows"),
            F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"),
            F.min(c).cast("string").alias(f"{c}|smallest"),
            F.max(c).cast("string").alias(f"{c}|largest"),
            F.avg(F.length(text[c])).alias(f"{c}|avg_length"),
            F.max(F.length(text[c])).cast("bigint").alias(f"{c}|max_length"),
        ]
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"{c}|distinct"))
    fields = ["rows", "nulls", "smallest", "largest", "avg_length", "max_length"] + ["distinct"] * approx
    wide = df.agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{f}`").alias(f) for f in fields]) for c in names
    ]
    stats = wide.select(F.inline(F.array(*entries)))
    if approx:
        return stats
    pairs = df.select(*[text[c].alias(c) for c in names]).unpivot([], names, "column", "_value")
    distinct = (
        pairs.filter(F.col("_value").isNotNull())
        .groupBy("column", "_value")
        .agg(F.lit(1).alias("_one"))
        .groupBy("column")
        .agg(F.count("*").alias("distinct"))
    )
    return stats.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def top_usage(df: DataFrame, name: str, count: str | None = None, n: int = 15) -> DataFrame:
    """Top ``n`` names by a usage column (non-numeric dropped), or by how often they occur."""
    if count is None:
        return value_counts(df, name, n)
    return (
        df.select(F.col(name), F.col(count).cast("string").try_cast("double").alias("n"))
        .dropna()
        .orderBy(F.desc("n"), name)
        .limit(n)
    )


def first_n(df: DataFrame, order: Sequence[str], n: int = 12) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*sort_columns(order)).limit(n)
