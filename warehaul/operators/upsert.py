"""Changes to tables that have no row-level update: build the new content, then swap it in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.session import checkpointed, small


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], set_cols: Sequence[str] | None = None
) -> DataFrame:
    """The content of ``target`` after a merge: matched rows take ``set_cols`` from the source,
    source rows without a match are added, all other rows stay.

    A presence column tells a matched NULL from no match. Repeated source keys are an error.
    The source is materialised, as it is read several times. When it is small, nothing of the target is
    shuffled: its keys are first cut to those of the source.
    """
    keys = list(keys)
    source = checkpointed(source)
    columns = target.columns
    set_cols = [c for c in columns if c not in keys] if set_cols is None else list(set_cols)
    repeated = source.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"source keys repeat: {[tuple(r)[:-1] for r in repeated]}")
    patch = source.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in set_cols]
    )
    updated = target.join(small(patch), keys, "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
            for c in columns
        ]
    )
    known = target.select(*keys).join(small(source.select(*keys)), keys, "left_semi")
    added = source.join(known, keys, "left_anti").select(
        *[F.col(c) if c in source.columns else F.lit(None).cast(dict(target.dtypes)[c]).alias(c) for c in columns]
    )
    return updated.unionByName(added)


def updated(df: DataFrame, pred: Column, values: Mapping[str, Column]) -> DataFrame:
    """The content after an update: rows where ``pred`` is true take the new values."""
    return df.withColumns({c: F.when(pred, v).otherwise(F.col(c)) for c, v in values.items()})


def without(df: DataFrame, pred: Column) -> DataFrame:
    """The content after a delete: rows where ``pred`` is false or NULL stay."""
    return df.filter(~F.coalesce(pred, F.lit(False)))
