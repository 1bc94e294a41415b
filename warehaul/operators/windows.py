"""Window results that hold when one key owns a large part of all rows.

Keys with up to ``max_rows`` rows use Spark's window functions. The rows of larger (hot) keys are
range-partitioned by key and order, materialised, computed piece by piece, and joined to the
totals of the pieces before them. An order is a list of column names, ``-name`` for descending.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warehaul.session import fits, handed_on, materialised

HOT_ROWS = 5_000_000
#: Rows that a task of a window should hold, so that its memory does not grow with the table.
PIECE_ROWS = 500_000
#: Pieces that a round of the tour should hold, and the most rounds, as each reads the rows of the hot keys again.
ROUND_PIECES, MOST_ROUNDS = 50, 4


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Sort keys, NULLs first when ascending and last when descending (Spark's defaults)."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def plain_names(order: Sequence[str]) -> list[str]:
    return [c.lstrip("-") for c in order]


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``max_rows`` rows: one partial aggregate over the key columns."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max_rows)


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (df[k].eqNullSafe(other[f"_{k}"]) for k in keys))


def _split(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of hot keys or None, number of pieces for the hot rows).

    The ordinary rows are dealt out by key in more parts than the session's if these would be too large for a task.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    is_hot = F.col("_rows") > max_rows
    every, total = counts.agg(F.sum("_rows"), F.sum(F.when(is_hot, F.col("_rows")))).first()
    cold, hot, pieces = df, None, 0
    if total and total == every:  # no row has to be looked for
        return df.filter(F.lit(False)), df, piece_count(df, total, max_rows)
    if total:
        named = counts.filter(is_hot).select(*[F.col(k).alias(f"_{k}") for k in keys])
        named = F.broadcast(named) if fits(named) else named
        match = _null_safe(df, named, keys)
        cold, hot = df.join(named, match, "left_anti"), df.join(named, match, "left_semi")
        pieces = piece_count(df, total, max_rows)
    parts = ((every or 0) - (total or 0)) // PIECE_ROWS + 1
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        cold = cold.repartition(parts, *keys)
    return cold, hot, pieces


def piece_count(df: DataFrame, rows: int, max_rows: int) -> int:
    """Pieces for the rows of hot keys: at most two for each ``max_rows``, and no more than keep all cores busy with
    tasks of ``PIECE_ROWS``, as every piece is a task, a file and a block of every task of the shuffle before it."""
    return min(2 * (rows // max_rows) + 2, rows // PIECE_ROWS + 3 * df.sparkSession.sparkContext.defaultParallelism)


def _cut(df: DataFrame, columns: Sequence[Column], pieces: int, first: int = 0) -> DataFrame:
    return df.repartitionByRange(pieces, *columns).withColumn("_piece", F.spark_partition_id() + first)


def ranged_pieces(df: DataFrame, columns: Sequence[Column], pieces: int) -> DataFrame:
    """``df`` cut into ``pieces`` ranges, numbered in ``_piece`` and materialised so that the cut stays."""
    return materialised(_cut(df, columns, pieces), "pieces")


def _by_piece(cut: DataFrame, keys: Sequence[str], pieces: int) -> DataFrame:
    """Pieces dealt out in as many parts as there are pieces if the session has fewer, so that a task holds one or a few."""
    more = pieces > int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(pieces, *keys, "_piece") if more else cut


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_piece").alias("_p"),
        *[c for c in totals.columns if c not in (*keys, "_piece")],
    )
    totals = F.broadcast(totals) if fits(totals) else totals
    match = (df["_piece"] == totals["_p"]) & (_null_safe(df, totals, keys) if keys else F.lit(True))
    return df.join(totals, match, "left").drop("_p", *[f"_{k}" for k in keys])


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", max_rows: int = HOT_ROWS
) -> DataFrame:
    """ROW_NUMBER per key; the order should be total."""
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    cold, hot, pieces = _split(df, keys, max_rows)
    result = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    return result if hot is None else result.unionByName(_hot_row_number(hot, keys, order, name, pieces))


def _hot_row_number(hot: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, pieces: int) -> DataFrame:
    cut = ranged_pieces(hot, [*[F.col(k) for k in keys], *sort_columns(order), F.xxhash64(*_all(hot))], pieces)
    local = _by_piece(cut, keys, pieces).withColumn(
        name, F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*sort_columns(order)))
    )
    totals = (
        cut.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_n"))
        .withColumn("_n", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
    )
    return _attach(local, totals, keys).withColumn(name, F.col(name) + F.col("_n")).drop("_n", "_piece")


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]


def _with_ranks(df, keys, order, names: Mapping[str, str], max_rows: int) -> DataFrame:
    """rank and/or dense_rank; for hot keys over the distinct order values with their counts."""
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    calls = {"rank": F.rank, "dense_rank": F.dense_rank}
    cold, hot, pieces = _split(df, keys, max_rows)
    result = cold.withColumns({n: calls[k]().over(window).cast("bigint") for k, n in names.items()})
    return result if hot is None else result.unionByName(_hot_ranks(hot, keys, order, names, pieces))


def _hot_ranks(hot: DataFrame, keys: Sequence[str], order: Sequence[str], names: Mapping[str, str], pieces: int) -> DataFrame:
    columns = plain_names(order)
    values = hot.groupBy(*keys, *columns).agg(F.count("*").alias("_c"))
    cut = ranged_pieces(values, [*[F.col(k) for k in keys], *sort_columns(order)], pieces)
    inside = Window.partitionBy(*keys, "_piece").orderBy(*sort_columns(order))
    local = _by_piece(cut, keys, pieces).withColumns(
        {
            "_below": F.coalesce(
                F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_dense": F.row_number().over(inside).cast("bigint"),
        }
    )
    totals = (
        cut.groupBy(*keys, "_piece")
        .agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
        .withColumns(
            {
                "_n": F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)),
                "_d": F.coalesce(F.sum("_d").over(_before(keys)), F.lit(0)),
            }
        )
    )
    exprs = {"rank": F.col("_below") + F.col("_n") + 1, "dense_rank": F.col("_dense") + F.col("_d")}
    ranks = _attach(local, totals, keys).select(
        *[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*keys, *columns])],
        *[exprs[k].alias(n) for k, n in names.items()],
    )
    match = _null_safe(hot, ranks, list(dict.fromkeys([*keys, *columns])))
    return hot.join(ranks, match).select(hot["*"], *names.values())


def with_rank(df, keys, order, name: str = "rnk", max_rows: int = HOT_ROWS) -> DataFrame:
    """RANK per key."""
    return _with_ranks(df, keys, order, {"rank": name}, max_rows)


def with_dense_rank(df, keys, order, name: str = "dense_rnk", max_rows: int = HOT_ROWS) -> DataFrame:
    """DENSE_RANK per key."""
    return _with_ranks(df, keys, order, {"dense_rank": name}, max_rows)


def with_partition_sum(
    df: DataFrame, keys: Sequence[str], col: str, name: str = "total", max_rows: int = HOT_ROWS
) -> DataFrame:
    """Sum of the whole group on every row; hot groups are summed first and joined back."""
    cold, hot, _ = _split(df, keys, max_rows)
    result = cold.withColumn(name, F.sum(col).over(Window.partitionBy(*keys)))
    return result if hot is None else result.unionByName(_hot_sum(hot, keys, col, name))


def _hot_sum(hot: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    totals = hot.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(col).alias(name))
    totals = F.broadcast(totals) if fits(totals) else totals
    return hot.join(totals, _null_safe(hot, totals, keys)).select(hot["*"], name)


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, str]],
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """LAG(x, 1) and LEAD(x, 1): ``columns`` maps a new name to ("lag" | "lead", column)."""
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    cold, hot, pieces = _split(df, keys, max_rows)
    result = cold.withColumns({n: _BESIDE[kind](c, 1).over(window) for n, (kind, c) in columns.items()})
    return result if hot is None else result.unionByName(_hot_neighbours(hot, keys, order, columns, pieces))


_BESIDE = {"lag": F.lag, "lead": F.lead}


def _hot_neighbours(
    hot: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, str]], pieces: int
) -> DataFrame:
    cut = ranged_pieces(hot, [*[F.col(k) for k in keys], *sort_columns(order), F.xxhash64(*_all(hot))], pieces)
    local = _beside(_by_piece(cut, keys, pieces), keys, order, columns)
    return _over_edges(local, _edges(local, keys, columns), keys, columns).select(*hot.columns, *columns)


def _beside(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """The neighbours inside a piece, and which rows are its ends."""
    inside = Window.partitionBy(*keys, "_piece").orderBy(*sort_columns(order))
    return parts.withColumns(
        {
            "_first": F.lag(F.lit(1), 1).over(inside).isNull(),
            "_last": F.lead(F.lit(1), 1).over(inside).isNull(),
            **{n: _BESIDE[kind](c, 1).over(inside) for n, (kind, c) in columns.items()},
        }
    )


def _edges(local: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """What the rows at the ends of a piece have beside them, in the pieces before and after it."""
    sources = list(dict.fromkeys(c for _, c in columns.values()))
    ends = local.filter(F.col("_first") | F.col("_last")).groupBy(*keys, "_piece").agg(
        *[F.max_by(c, "_first").alias(f"_first_{c}") for c in sources],
        *[F.max_by(c, "_last").alias(f"_last_{c}") for c in sources],
    )
    by_piece = Window.partitionBy(*keys).orderBy("_piece")
    return ends.select(
        *keys,
        "_piece",
        *[F.lag(f"_last_{c}", 1).over(by_piece).alias(f"_lag_{c}") for c in sources],
        *[F.lead(f"_first_{c}", 1).over(by_piece).alias(f"_lead_{c}") for c in sources],
    )


def _over_edges(
    local: DataFrame, edges: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]]
) -> DataFrame:
    end = {"lag": F.col("_first"), "lead": F.col("_last")}
    return _attach(local, edges, keys).withColumns(
        {
            n: F.when(end[kind], F.col(f"_{kind}_{c}")).otherwise(F.col(n))
            for n, (kind, c) in columns.items()
        }
    )


def with_lag(df, keys, order, col, name="prev", max_rows: int = HOT_ROWS) -> DataFrame:
    return with_neighbours(df, keys, order, {name: ("lag", col)}, max_rows)


def with_lead(df, keys, order, col, name="next", max_rows: int = HOT_ROWS) -> DataFrame:
    return with_neighbours(df, keys, order, {name: ("lead", col)}, max_rows)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    ``row_number() <= n`` lets Spark keep only n rows per key and task before the shuffle, so hot
    keys are cut down on the map side. Beyond that rewrite's limit the skew-proof numbering is used.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        return with_row_number(df, keys, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key, e.g. by ``["-order_date", "order_id"]``."""
    return top_n_per_key(df, keys, order, 1)


def qualify(df: DataFrame, expr: Column, pred) -> DataFrame:
    """Keep rows whose window value satisfies ``pred(value)``; the value itself is dropped."""
    return df.withColumn("_q", expr).filter(pred(F.col("_q"))).drop("_q")


def merge_periods(
    df: DataFrame, keys: Sequence[str], start: str, end: str, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Merge overlapping or meeting periods per key.

    A period opens a new group when it starts after the highest end seen before it. For hot keys
    the highest end and the number of groups are carried from piece to piece.
    """
    keys = list(keys)
    order = [start, end]
    cold, hot, pieces = _split(df.select(*keys, start, end), keys, max_rows)

    def opens(before: Column) -> Column:
        return F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)

    running = Window.partitionBy(*keys).orderBy(start, end)
    past = running.rowsBetween(Window.unboundedPreceding, -1)
    grouped = cold.withColumn("_open", opens(F.max(end).over(past))).withColumn(
        "_group", F.sum("_open").over(running.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = [grouped.select(*keys, start, end, "_group")]
    if hot is not None:
        # copies of a period say nothing new, and would all fall into one piece
        cut = ranged_pieces(hot.distinct(), [*[F.col(k) for k in keys], *sort_columns(order)], pieces)
        inside = Window.partitionBy(*keys, "_piece").orderBy(start, end)
        ends = (
            cut.groupBy(*keys, "_piece")
            .agg(F.max(end).alias("_top"))
            .withColumn("_top", F.max("_top").over(_before(keys)))
        )
        seen = F.greatest(
            F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top")
        )
        flagged = _attach(cut, ends, keys).withColumn("_open", opens(seen))
        opened = (
            flagged.groupBy(*keys, "_piece")
            .agg(F.sum("_open").alias("_o"))
            .withColumn("_o", F.coalesce(F.sum("_o").over(_before(keys)), F.lit(0)))
        )
        local = flagged.withColumn(
            "_group", F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
        parts.append(
            _attach(local, opened, keys).select(*keys, start, end, (F.col("_group") + F.col("_o")).alias("_group"))
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*keys, "_group")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_group")
    )


def with_row_id(
    df: DataFrame, order: Sequence[str], name: str = "row_id", start: int = 1, rows_per_piece: int = HOT_ROWS
) -> DataFrame:
    """Consecutive numbers over a total order, without ever bringing all rows to one task."""
    pieces = df.count() // rows_per_piece + 2
    cut = ranged_pieces(df, sort_columns(order), pieces)
    totals = cut.groupBy("_piece").agg(F.count("*").alias("_n"))
    # One row per piece: few enough for a window without a key.
    totals = totals.withColumn(
        "_n",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    local = cut.withColumn(name, F.row_number().over(Window.partitionBy("_piece").orderBy(*sort_columns(order))))
    return (
        _attach(local, totals, [])
        .withColumn(name, F.col(name) + F.col("_n") + (start - 1))
        .drop("_n", "_piece")
    )


def window_tour(
    df: DataFrame, keys: Sequence[str], value: str, by_value: Sequence[str], ties: Sequence[str],
    by_time: Sequence[str], max_rows: int = HOT_ROWS, source: str | None = None,
) -> DataFrame:
    """row_number, rank, dense_rank, group sum, lag and lead of one value per key.

    Ordinary keys get all six from one shuffle; the rows of hot keys take the piecewise way. ``source`` is the scratch
    path of ``df`` if nothing else reads it; if all its rows are of hot keys, it goes as soon as they are cut into pieces.
    """
    value_order, time_order = [*by_value, *ties], [*by_time, *ties]
    cold, hot, pieces = _split(df, keys, max_rows)
    by_rank = Window.partitionBy(*keys).orderBy(*sort_columns(value_order))
    by_tied = Window.partitionBy(*keys).orderBy(*sort_columns(by_value))
    by_date = Window.partitionBy(*keys).orderBy(*sort_columns(time_order))
    result = cold.withColumns(
        {
            "rn": F.row_number().over(by_rank).cast("bigint"),
            "rnk": F.rank().over(by_tied).cast("bigint"),
            "dense_rnk": F.dense_rank().over(by_tied).cast("bigint"),
            "total_spent": F.sum(value).over(Window.partitionBy(*keys)),
            "prev_amt": F.lag(value, 1).over(by_date),
            "next_amt": F.lead(value, 1).over(by_date),
        }
    )
    if hot is None:
        return result
    if hot is not df or source is None:
        hot, source = handed_on(hot, "hot")
    step = _hot_tour(hot, source, keys, value, by_value, value_order, time_order, pieces)
    return result.unionByName(step.select(*result.columns))


def _hot_tour(
    hot: DataFrame, source: str, keys: Sequence[str], value: str, by_value: Sequence[str], value_order: Sequence[str],
    time_order: Sequence[str], pieces: int,
) -> DataFrame:
    """The six results over hot keys: all rows are cut once by value and once by time, in rounds over ranges of that order.

    What a step has read is deleted once it is written, so the disk holds all rows once or twice, and the pieces and the
    shuffle of one round.
    """
    rounds = min(pieces // ROUND_PIECES + 1, MOST_ROUNDS)
    each = max(pieces // rounds + 1, min(pieces, 2 * hot.sparkSession.sparkContext.defaultParallelism))
    value_range, time_range = _range_numbers(hot, [value_order[0], time_order[0]], rounds)
    given = [F.col(k) for k in keys]
    parts, paths = [], []
    for i in range(rounds):
        some = [*given, *sort_columns(value_order), F.xxhash64(*_all(hot))]
        done = [source] if i == rounds - 1 else []
        cut, at = handed_on(_cut(hot.filter(value_range == i), some, each, i * each), "pieces", *done)
        placed = _placed(_by_piece(cut, keys, each), keys, value_order, by_value).withColumn("_range", time_range)
        part, at = handed_on(placed, "hot", at, by="_range")
        parts.append(part)
        paths.append(at)
    step = _after_pieces(reduce(DataFrame.unionByName, parts), keys, by_value)
    columns, parts = {"prev_amt": ("lag", value), "next_amt": ("lead", value)}, []
    by_rows = [*time_order, "-rn"]  # copies of a row too have one order
    for i in range(rounds):
        some = [*given, *sort_columns(by_rows)]
        done = paths if i == rounds - 1 else [f"{at}/_range={i}" for at in paths]
        cut, at = handed_on(_cut(step.filter(F.col("_range") == i).drop("_range"), some, each, i * each), "pieces", *done)
        part, _ = handed_on(_beside(_by_piece(cut, keys, each), keys, by_rows, columns), "hot", at)
        parts.append(part)
    step = reduce(DataFrame.unionByName, parts)
    edges = materialised(_edges(step, keys, columns), "edges")
    return _over_edges(_hot_sum(step, keys, value, "total_spent"), edges, keys, columns)


def _range_numbers(df: DataFrame, order: Sequence[str], ranges: int) -> list[Column]:
    """For each name of ``order`` the number of the range a row lies in: rows of a range come before those of the next.

    The bounds are rough, as only the size of a range hangs on them. Types that are no numbers, dates or times stay in one range.
    """
    kinds, plain = dict(df.dtypes), plain_names(order)
    numbers = {c: F.unix_date(c) if kinds[c] == "date" else F.col(c) for c in plain}
    numbers = {c: n.cast("double") for c, n in numbers.items() if kinds[c].split("(")[0] in _RANGED} if ranges > 1 else {}
    if not numbers:
        return [F.lit(0) for _ in order]
    shares = [i / ranges for i in range(1, ranges)]
    bounds = df.agg(*[F.percentile_approx(n, shares, 1000).alias(c) for c, n in numbers.items()]).first()
    found = []
    for name, c in zip(order, plain):
        # NULL comes first when ascending, NaN is the highest, as in the sort
        above = [F.when(numbers[c] > F.lit(b), 1).otherwise(0) for b in (bounds[c] if c in numbers else None) or []]
        number = reduce(Column.__add__, above, F.lit(0))
        found.append(F.lit(len(above)) - number if name.startswith("-") else number)
    return found


_RANGED = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"}


def _placed(parts: DataFrame, keys: Sequence[str], value_order: Sequence[str], by_value: Sequence[str]) -> DataFrame:
    """row_number, rank and dense_rank inside a piece; the ranks find the rows in order."""
    inside = Window.partitionBy(*keys, "_piece")
    tied = inside.orderBy(*sort_columns(by_value))
    return parts.withColumn("rn", F.row_number().over(inside.orderBy(*sort_columns(value_order)))).withColumns(
        {"rnk": F.rank().over(tied), "dense_rnk": F.dense_rank().over(tied)}
    )


def _after_pieces(local: DataFrame, keys: Sequence[str], by_value: Sequence[str]) -> DataFrame:
    """``_placed`` with what the pieces before hold; the first rows of a piece may be tied with the last ones before it."""
    tie = F.struct(*plain_names(by_value))
    totals = local.groupBy(*keys, "_piece").agg(
        F.count("*").alias("_n"), F.max("rnk").alias("_r"), F.max("dense_rnk").alias("_d"),
        F.min_by(tie, "rn").alias("_head"), F.max_by(tie, "rn").alias("_tail"),
    )
    by_piece = Window.partitionBy(*keys).orderBy("_piece")
    totals = totals.select(
        *keys, "_piece", "_r", "_d",
        F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_n"),
        F.col("_head").eqNullSafe(F.lag("_tail", 1).over(by_piece)).alias("_on"),
    )
    # a piece of nothing but rows tied with those before it opens no rank
    opened = F.when(~F.col("_on") | (F.col("_d") > 1), F.col("_n") + F.col("_r"))
    totals = totals.select(
        *keys, "_piece", "_n", "_on",
        F.last(opened, ignorenulls=True).over(_before(keys)).alias("_r"),
        (
            F.coalesce(F.sum(F.col("_d") - F.col("_on").cast("int")).over(_before(keys)), F.lit(0))
            - F.col("_on").cast("int")
        ).alias("_d"),
    )
    placed = _attach(local, materialised(totals, "totals"), keys)
    return placed.withColumns(
        {
            "rn": F.col("rn") + F.col("_n"),
            "rnk": F.when(F.col("_on") & (F.col("dense_rnk") == 1), F.col("_r")).otherwise(F.col("rnk") + F.col("_n")),
            "dense_rnk": F.col("dense_rnk") + F.col("_d"),
        }
    ).drop("_piece", "_n", "_on", "_r", "_d")
