"""Sorting, top-N and physical layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warehaul.operators.windows import sort_columns


def top_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Top rows by order: every task keeps n rows, the driver merges them."""
    return df.orderBy(*sort_columns(order)).limit(n)


def distribute(df: DataFrame, keys: Sequence[str], sort: Sequence[str], n: int | None = None) -> DataFrame:
    """DISTRIBUTE BY keys SORT BY sort: equal keys meet in one partition, sorted inside it."""
    parts = df.repartition(n, *keys) if n else df.repartition(*keys)
    return parts.sortWithinPartitions(*sort_columns(sort))


def pinned_sort(df: DataFrame, key: str, first: str) -> DataFrame:
    """Sort by key with one key pinned to the top."""
    return df.orderBy(F.col(key) != first, key)


def sample_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """A repeatable bounded sample: the first ``k`` rows in the order of all columns."""
    return df.orderBy(*df.columns).limit(k)


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], n: int, fmt: str = "parquet") -> None:
    """Write in ranges of ``columns``, sorted inside each file, so that scans can skip row groups."""
    df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).write.format(fmt).save(path)
