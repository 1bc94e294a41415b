"""Comparison of two results: counts, names, rows, keyed values, fingerprints and a verdict.

All comparisons run on the executors. The driver sees counts, column names and at most a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warehaul.session import materialised

SAMPLE_ROWS = 5
#: Significant digits in which doubles are compared. Sums that were added in another order agree in about 13;
#: amounts with cents stay apart up to 10^10.
DOUBLE_DIGITS = 12


def _rounded(c: Column, kind: T.DataType, digits: int | None) -> Column:
    """A double in ``digits`` significant digits at every magnitude, -0.0 as 0.0; a float by its printed value."""
    c = c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c
    if digits is None:
        return c + F.lit(0.0)
    # the exponent is bounded so that the unit stays a finite double; only the tiniest values lose digits by that
    exponent = F.greatest(F.floor(F.log10(F.abs(c))), F.lit(digits - 308))
    unit = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - exponent)
    scaled = F.rint(c * unit) / unit
    odd = (c == 0) | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, c).otherwise(F.coalesce(F.when(F.abs(scaled) < float("inf"), scaled), c)) + F.lit(0.0)


def _plain(c: Column, kind: T.DataType, digits: int | None) -> Column:
    """A value with all doubles in it rounded; maps as sorted entries, so that their order does not matter."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _rounded(c, kind, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        fields = [_plain(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            F.to_json(F.struct(e["key"].alias("key"))).alias("key"), _plain(e["value"], kind.valueType, digits).alias("value")
        )
        return F.sort_array(F.transform(F.map_entries(c), entry))
    return c


def comparable(df: DataFrame, digits: int = DOUBLE_DIGITS, round_columns: bool = True) -> DataFrame:
    """Columns by name in sorted order, doubles rounded to ``digits`` significant digits at any depth and -0.0 as 0.0.

    Arrays, structs and maps become JSON texts that keep NULL fields and elements, so that equal values group and
    a moved NULL shows. Without ``round_columns`` columns of doubles stay as they are, and only those within others are rounded.
    """

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(_plain(c, f.dataType, digits), {"ignoreNullFields": "false"}).alias(f.name)
        if isinstance(f.dataType, T.VariantType):
            return F.to_json(c).alias(f.name)
        return _plain(c, f.dataType, digits if round_columns else None).alias(f.name)

    return df.select(*[value(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _same_types(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns that can meet: numbers of different types compare as numbers, any
    other two types are told apart by their names, so that a text never equals a number."""
    types_a, types_b = dict(a.dtypes), dict(b.dtypes)

    def number(t: str) -> bool:
        return t.split("(")[0] in _NUMBERS

    mixed = [
        c for c in types_a.keys() & types_b.keys()
        if types_a[c] != types_b[c] and not (number(types_a[c]) and number(types_b[c])) and c not in keep
    ]

    def named(df: DataFrame, types: dict[str, str]) -> DataFrame:
        return df.withColumns({c: F.concat(F.lit(f"{types[c]}:"), F.col(f"`{c}`").cast("string")) for c in mixed})

    return named(a, types_a), named(b, types_b)


def schema_diff(left: DataFrame, right: DataFrame, types: bool = False) -> DataFrame:
    """Columns found on one side only, sorted; with ``types`` also those whose type differs."""
    spark = left.sparkSession
    a, b = dict(left.dtypes), dict(right.dtypes)
    rows = [(c, "left") for c in sorted(a.keys() - b.keys())]
    rows += [(c, "right") for c in sorted(b.keys() - a.keys())]
    if types:
        rows += [(c, f"{a[c]} <> {b[c]}") for c in sorted(a.keys() & b.keys()) if a[c] != b[c]]
    return spark.createDataFrame(rows, "column string, side string")


def _settled(diff: DataFrame, exact: Sequence[str], doubles: Sequence[str], shift: float) -> DataFrame:
    """``diff`` with ``_total``, the balance of each group of rows that are near each other, and the columns of the group's key.

    Rows are near if they agree in ``exact`` and lead to each other by steps of one unit in the last digit in every one of
    ``doubles``. They are sought in cells of about a millionth of a value, so that groups stay small; ``shift`` moves the cells' edges.
    """
    cells = {}
    for i, c in enumerate(doubles):
        value = F.col(f"`{c}`")
        plain = (value != 0) & ~F.isnan(value) & (F.abs(value) < float("inf"))
        place = F.floor(F.log10(F.abs(value)) * 1_000_000 + F.lit(shift)).cast("string")
        cells[f"_cell{i}"] = F.when(plain, F.concat(F.signum(value).cast("string"), place)).otherwise(value.cast("string"))
    keys = [F.col(f"`{c}`") for c in exact] + [F.col(c) for c in cells]
    rows = diff.withColumns(cells)
    for i, c in enumerate(doubles):
        value, order = F.col(f"`{c}`"), Window.partitionBy(*keys).orderBy(f"`{c}`")
        last = F.lag(value).over(order)
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(value), F.abs(last)))) + F.lit(1.0 - DOUBLE_DIGITS))
        # equal, also if both are infinite or no numbers, or one step of rounding apart
        near = value.eqNullSafe(last) | F.coalesce(F.abs(value - last) <= unit * 1.5, F.lit(False))
        apart = rows.withColumn("_apart", F.when(near, 0).otherwise(1))
        rows = apart.withColumn(f"_step{i}", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")
        keys.append(F.col(f"_step{i}"))
    return rows.withColumn("_key", F.struct(*keys)).withColumn("_total", F.sum("_balance").over(Window.partitionBy("_key")))


def diff_rows(left: DataFrame, right: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose number of copies differs, with the side that has more and the surplus.

    Columns are matched by name. Copies are counted before the shuffle, so many equal rows are cheap. Doubles are compared in
    DOUBLE_DIGITS significant digits; rows that are then left on both sides of an edge of the rounding, one unit apart, count as equal
    too. Only rows that rounding leaves unequal are looked at again, first in cells, then in cells shifted by half.
    """
    a, b = _same_types(comparable(left), comparable(right))
    both = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    columns = [F.col(f"`{c}`") for c in a.columns]
    diff = both.groupBy(*columns).agg(F.sum("_sign").alias("_balance")).filter("_balance != 0")
    doubles = [c for c, t in both.dtypes if t == "double"]
    if doubles:
        exact = [c for c in a.columns if c not in doubles]
        diff = _settled(diff, exact, doubles, 0.0).filter("_total <> 0").select(*diff.columns)
        again = _settled(diff, exact, doubles, 0.5).filter("_total <> 0")
        # of a group the surplus, shown by its least row on that side
        own = F.when(F.signum("_balance") == F.signum("_total"), F.struct(*columns))
        diff = again.groupBy("_key").agg(F.first("_total").alias("_balance"), F.min(own).alias("_row")).select("_row.*", "_balance")
    diff = diff.select(
        F.when(F.col("_balance") > 0, "left").otherwise("right").alias("side"), F.abs("_balance").alias("copies"), *columns
    )
    return diff if limit is None else _first(diff, limit)


def _first(diff: DataFrame, limit: int) -> DataFrame:
    return diff.orderBy("side", *[f"`{c}`" for c in diff.columns if c not in ("side", "copies")]).limit(limit)


def diff_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that differ: ``status`` is missing_left, missing_right, changed or duplicate_key,
    with the names of the changed columns.

    Both sides are grouped by key in one pass and nothing is joined, so repeated keys produce
    one row with status duplicate_key and not their combinations. Top-level doubles differ if they are further
    apart than one unit in the last of DOUBLE_DIGITS significant digits.
    """
    doubles = {n for df in (left, right) for n, t in df.dtypes if t in ("double", "float") and n not in keys}
    a, b = _same_types(*[comparable(df, round_columns=False) for df in (left, right)], keys)
    values = [c for c in a.columns if c not in set(keys) and c in set(b.columns)]
    tagged = [
        side.select(*keys, *values, F.lit(tag).alias("_side")) for side, tag in ((a, "l"), (b, "r"))
    ]

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(f"`{col}`")))

    grouped = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(
        F.count_if(F.col("_side") == "l").alias("_nl"),
        F.count_if(F.col("_side") == "r").alias("_nr"),
        *[of("l", c).alias(f"_l_{c}") for c in values],
        *[of("r", c).alias(f"_r_{c}") for c in values],
    )
    def differs(c: str) -> Column:
        l, r = F.col(f"_l_{c}"), F.col(f"_r_{c}")  # noqa: E741
        near = F.lit(False)
        if c in doubles and {t for d in (a, b) for n, t in d.dtypes if n == c} <= set(_NUMBERS):
            near = F.abs(l - r) <= F.greatest(F.abs(l), F.abs(r)) * F.lit(10.0 ** (1 - DOUBLE_DIGITS))
        return ~(l.eqNullSafe(r) | F.coalesce(near, F.lit(False)))

    changed = [F.when(differs(c), F.lit(c)) for c in values]
    once = (F.col("_nl") == 1) & (F.col("_nr") == 1)
    return (
        grouped.withColumn(
            "changed", F.when(once, F.array_compact(F.array(*changed))).otherwise(F.array().cast("array<string>"))
        )
        .withColumn(
            "status",
            F.when((F.col("_nl") > 1) | (F.col("_nr") > 1), "duplicate_key")
            .when(F.col("_nl") == 0, "missing_left")
            .when(F.col("_nr") == 0, "missing_right")
            .when(F.size("changed") > 0, "changed"),
        )
        .filter(F.col("status").isNotNull())
        .select(*keys, "status", "changed")
    )


def fingerprint(df: DataFrame, table: str | None = None) -> DataFrame:
    """Row count and one order-free hash sum per column, in long form: (table, rows, column, hash_sum).

    A cheap first comparison of many table pairs: only numbers are shuffled.
    """
    plain = comparable(df)
    # the sum of DECIMAL(28,0) is a DECIMAL(38,0), which holds 10^19 hashes of 64 bits
    sums = [
        F.sum(F.xxhash64(F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`")).cast("decimal(28,0)")).alias(c)
        for c in plain.columns
    ]
    wide = plain.agg(F.count("*").alias("_rows"), *sums)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("hash_sum")) for c in plain.columns])
    return wide.select(
        F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(entries)
    )


def _digest(df: DataFrame) -> Row:
    """Count and order-free digest of all rows: two sums of independent 64-bit row hashes.

    The hash passes over NULLs, so each value goes with a flag: a value that moves to a column that was NULL shows.
    """
    rows = comparable(df)
    columns = [x for c in rows.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashes = (F.xxhash64(*columns), F.xxhash64(F.lit("second"), *reversed(columns)))
    sums = [F.sum(h.cast("decimal(28,0)")).alias(f"s{i}") for i, h in enumerate(hashes)]
    return rows.agg(F.count("*").alias("n"), *sums).first()


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-row verdict: counts, schema match, data match, passed and a short report.

    Names are compared without order and types. The rows are compared only if counts and names
    agree: first by digests, which shuffle nothing, and row by row only if the digests differ, with the tolerance of ``diff_rows``.
    """
    return _verdict(left, right, _digest(left), _digest(right))


def reconcile_rows(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdict of ``reconcile`` and all rows of ``diff_rows``, which are compared once for both and need no digests.

    The names must agree.
    """
    diff = materialised(diff_rows(left, right), "difference")
    counts = [df.agg(F.count("*").alias("n")).first() for df in (left, right)]
    return _verdict(left, right, *counts, diff), diff


def _verdict(left: DataFrame, right: DataFrame, a: Row, b: Row, diff: DataFrame | None = None) -> DataFrame:
    n_left, n_right = a["n"], b["n"]
    spark = left.sparkSession
    only_left = sorted(set(left.columns) - set(right.columns))
    only_right = sorted(set(right.columns) - set(left.columns))
    schema_match = sorted(left.columns) == sorted(right.columns)
    count_match = n_left == n_right
    data_match = None
    lines = [f"rows: {n_left} / {n_right}", f"schema match: {schema_match}"]
    if only_left:
        lines.append(f"only left: {only_left}")
    if only_right:
        lines.append(f"only right: {only_right}")
    if schema_match and count_match:
        if diff is None:
            sample = [] if a == b else diff_rows(left, right, SAMPLE_ROWS).collect()
        else:
            sample = _first(diff, SAMPLE_ROWS).collect()
        data_match = not sample
        lines += [f"{r['side']} x{r['copies']}: {r.asDict()}" for r in sample]
    passed = bool(schema_match and count_match and data_match)
    return _record(
        spark, passed, count_match, schema_match, data_match, n_left, n_right, left.columns, right.columns, lines, None
    )


def _record(spark, passed, count_match, schema_match, data_match, n_left, n_right, left, right, lines, error):
    schema = (
        "passed boolean, row_count_match boolean, schema_match boolean, data_match boolean, left_count bigint, "
        "right_count bigint, left_columns array<string>, right_columns array<string>, report string, error string"
    )
    row = (
        passed, count_match, schema_match, data_match, n_left, n_right, list(left), list(right),
        "\n".join(lines), error,
    )
    return spark.createDataFrame([row], schema)


def reconcile_sql(spark: SparkSession, original: str, migrated: str) -> DataFrame:
    """Run both texts and compare; the error names the side that failed, and the second text
    is not run if the first one fails."""
    frames = []
    digests = []
    for label, text in (("Original", original), ("Migrated", migrated)):
        try:
            df = spark.sql(text)
            digests.append(_digest(df))
            frames.append(df)
        except Exception as exc:
            first = digests[0]["n"] if digests else 0
            left = frames[0].columns if frames else []
            error = f"{label} SQL failed: {str(exc).splitlines()[0]}"
            return _record(spark, False, False, False, None, first, 0, left, [], [], error)
    return _verdict(*frames, *digests)
