"""Joins: null-aware, size-checked, skew-proof, lookups, cascades and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.operators.windows import HOT_ROWS, hot_keys, top_n_per_key
from warehaul.session import checkpointed, fits, small


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def anti_join(df: DataFrame, other: DataFrame, on: str, null_aware: bool = True) -> DataFrame:
    """Rows of ``df`` without a partner.

    Null-aware is ``NOT IN``: one NULL on the right empties the result, and a NULL on the left
    stays only when the right is empty. Otherwise it is ``NOT EXISTS``. Both run as an equi anti join,
    which needs no distinct keys; NULLs are counted by one aggregate that shuffles a row per task.
    """
    keys = other.select(on)
    if not null_aware:
        return df.join(keys, on, "left_anti")
    facts = keys.agg(F.count("*").alias("n"), F.count_if(F.col(on).isNull()).alias("holes")).first()
    if facts["n"] == 0:
        return df
    if facts["holes"]:
        return df.filter(F.lit(False))
    return df.filter(F.col(on).isNotNull()).join(keys, on, "left_anti")


def join_small(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a broadcast hint on ``other`` if its size allows one."""
    return df.join(small(other), on, how)


def join_skewed(
    df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner", salt: int = 0, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner or left join that survives hot keys on the left.

    With ``salt`` = 0 the adaptive skew join does the work. With ``salt`` > 0 only the keys with
    more than ``max_rows`` rows are salted: their right rows are repeated once per salt value,
    all other rows are shuffled as usual.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_skewed supports inner and left joins")
    on = list(on)
    if salt <= 0:
        return df.join(other, on, how)
    hot = hot_keys(df, on, max_rows).dropna().select(*on, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return df.join(other, on, how)
    hot = small(hot)
    others = [c for c in df.columns if c not in on]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in others]), F.lit(salt)) if others else F.lit(0).cast("bigint")
    left = df.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    right = (
        other.join(hot, on, "left")
        .withColumn("_salt", F.explode_outer(salts.cast("array<bigint>")))
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [*on, "_salt"], how).drop("_salt")


def lookup(
    df: DataFrame, dim: DataFrame, on: str, columns: Sequence[str], order: Sequence[str], default: str = "UNKNOWN"
) -> DataFrame:
    """Left join to one row per key of ``dim`` (the first by ``order``); ``default`` when missing."""
    one = top_n_per_key(dim, [on], order, 1).select(on, *columns)
    # the size check reads the table itself and not its windowed form, which has no more rows
    one = F.broadcast(one) if fits(dim.select(on, *columns)) else one
    return df.join(one, on, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(default)) for c in columns}
    )


def match_cascade(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    keys: Sequence[tuple[Column, Column]],
    order: Sequence[str],
    payload: Sequence[str],
) -> DataFrame:
    """For each left row the right row of the first key pair that matches, ties by ``order``.

    The right side is cut to its best row per (step, key) before the join, so that a left row
    meets at most one partner per step, however many copies of a key there are. ``left_id`` must name a row:
    a repeated one is an error, as its rows would share their partners; one row may have a NULL there.
    """
    repeated = left.groupBy(left_id).agg(F.count("*").alias("_n")).filter("_n > 1").select(left_id).limit(3).collect()
    if repeated:
        raise ValueError(f"{left_id} repeats: {[r[0] for r in repeated]}")
    steps = range(1, len(keys) + 1)
    candidates = right.select(
        "*",
        F.explode_outer(
            F.array(*[F.struct(F.lit(i).alias("step"), k.alias("key")) for i, (_, k) in zip(steps, keys)])
        ).alias("_c"),
    ).select(*payload, *[c.lstrip("-") for c in order if c.lstrip("-") not in payload], "_c.step", "_c.key")
    best = top_n_per_key(candidates.dropna(subset=["key"]), ["step", "key"], order, 1).select("step", "key", *payload)
    probes = left.select(
        left_id,
        F.explode_outer(
            F.array(*[F.struct(F.lit(i).alias("step"), k.alias("key")) for i, (k, _) in zip(steps, keys)])
        ).alias("_p"),
    ).select(left_id, "_p.step", "_p.key")
    hits = probes.join(best, ["step", "key"]).groupBy(left_id).agg(
        F.min(F.struct("step", *payload)).alias("_hit")
    )
    hits = hits.withColumnRenamed(left_id, "_of")
    return left.join(hits, F.col(left_id).eqNullSafe(F.col("_of")), "left").select(
        left["*"], F.col("_hit.step").alias("match_step"), *[F.col(f"_hit.{p}").alias(p) for p in payload]
    )


def link_or_placeholder(
    df: DataFrame, linked: str, target: Column, placeholder: Column, warning: Column
) -> DataFrame:
    """``target`` and no warning where ``linked`` is known, else the placeholder and a warning."""
    known = F.col(linked).isNotNull()
    return df.withColumns(
        {
            "target": F.when(known, target).otherwise(placeholder),
            "warning": F.when(~known, warning),
        }
    )


def expand_hierarchy(
    edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child"
) -> DataFrame:
    """Nodes reached from the roots with their depth and path, level by level, however deep.

    ``roots`` has one column ``node``. A path ends at the first node that it already holds; that row is
    given too, marked in ``cycle``. Every level is checkpointed, so the lineage stays short.
    """
    step = edges.select(F.col(parent).alias("node"), F.col(child).alias("_next"))
    level = roots.select(
        F.col("node"),
        F.lit(0).cast("bigint").alias("depth"),
        F.col("node").cast("string").alias("path"),
        F.lit(False).alias("cycle"),
        F.array("node").alias("_held"),
    )
    levels = [level]
    depth = 0
    while depth == 0 or not level.isEmpty():
        depth += 1
        level = checkpointed(
            level.filter(~F.col("cycle")).join(step, "node").select(
                F.col("_next").alias("node"),
                F.lit(depth).cast("bigint").alias("depth"),
                F.concat_ws("/", "path", F.col("_next").cast("string")).alias("path"),
                F.array_contains("_held", F.col("_next")).alias("cycle"),
                F.array_append("_held", F.col("_next")).alias("_held"),
            )
        )
        levels.append(level)
    return reduce(DataFrame.unionByName, levels[:-1]).drop("_held")
