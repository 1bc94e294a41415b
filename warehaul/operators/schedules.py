"""Schedules as rows: expected run times and the runs that are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warehaul.functions.scalar import epoch_millis, frequency

SLOTS_PER_ROW = 50_000
BAD_FREQUENCY = "frequency '%s' cannot be read"
SHORTEST_MONTH, SHORTEST_DAY = 28 * 24, 23  # hours


#: Offsets that stand for a zone, up to 18 hours.
_OFFSET = r"^(Z|(UTC|GMT|UT)?[+-]((0?[0-9]|1[0-7])(:[0-5][0-9])?|18(:00)?))$"


def _known_zone(df: DataFrame) -> Column:
    """True for the time zones that this Java knows, by name or as an offset; false for others and NULL."""
    names = sorted(map(str, df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()))
    return F.coalesce(F.col("timezone").isin(names) | F.col("timezone").rlike(_OFFSET), F.lit(False))


def _names(df: DataFrame) -> list[str]:
    """What tells schedules apart: their names, and the files they stand in where ``df`` has them, as names may repeat."""
    return [*(["file"] if "file" in df.columns else []), "schedule"]


def rejected_schedules(df: DataFrame) -> DataFrame:
    """Schedules that give no slots, with the reason: (file if there is one, schedule, frequency, reason)."""
    unit, amount = frequency(F.col("frequency"))
    starts, ends = epoch_millis(F.col("start")), epoch_millis(F.col("end"))
    unknown = unit.isNull() | amount.isNull() | (amount <= 0) | ~unit.isin("minutes", "hours", "days", "months")
    reason = (
        F.when(unknown, F.format_string(BAD_FREQUENCY, F.coalesce("frequency", F.lit(""))))
        .when(starts.isNull(), "start cannot be read")
        .when(ends.isNull(), "end cannot be read")
        .when(starts >= ends, "start is not before end")
    )
    if "timezone" in df.columns:
        reason = reason.when(~_known_zone(df), F.format_string("unknown time zone '%s'", F.coalesce("timezone", F.lit(""))))
    return df.select(*_names(df), "frequency", reason.alias("reason")).filter("reason IS NOT NULL")


def schedule_slots(df: DataFrame, chunk: int = SLOTS_PER_ROW) -> DataFrame:
    """Expected run times of every schedule: (schedule, slot_no, slot), the end excluded; with file, if ``df`` has it.

    ``df`` has schedule, frequency, start, end (ISO texts) and timezone. Days and months are
    calendar steps in the schedule's own time zone, minutes and hours are exact. Schedules that cannot be read are
    listed by ``rejected_schedules``. A long schedule
    is generated in chunks spread over tasks, so no row has to hold all of its slots.
    """
    unit, amount = frequency(F.col("frequency"))
    starts = F.timestamp_millis(epoch_millis(F.col("start")))
    ends = F.timestamp_millis(epoch_millis(F.col("end")))
    base = df.filter(_known_zone(df)).select(
        *_names(df), "timezone", unit.alias("_unit"), amount.alias("_n"), starts.alias("_start"), ends.alias("_end")
    ).filter("_n > 0 AND _start < _end")
    calendar = F.col("_unit").isin("days", "months")
    hours = (
        F.when(F.col("_unit") == "minutes", F.col("_n") / 60)
        .when(F.col("_unit") == "hours", F.col("_n"))
        .when(F.col("_unit") == "days", F.col("_n") * SHORTEST_DAY)
        .otherwise(F.col("_n") * SHORTEST_MONTH)
    )
    # enough steps to pass the end whatever the lengths of days and months; the surplus is filtered
    steps = F.ceil((F.unix_seconds("_end") - F.unix_seconds("_start")) / 3600 / hours) + 1
    spread = base.withColumn("_steps", steps).withColumn(
        "_chunk", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_steps") / chunk)))
    )
    first = F.col("_chunk") * chunk
    rows = spread.withColumn(
        "slot_no", F.explode_outer(F.sequence(first, F.least(first + chunk - 1, F.col("_steps"))))
    )
    k = (F.col("slot_no") * F.col("_n")).cast("int")
    local = F.from_utc_timestamp("_start", F.col("timezone")).cast("timestamp_ntz")
    none = F.lit(0)
    moved = F.when(
        F.col("_unit") == "months", local + F.make_interval(years=none, months=k)
    ).otherwise(local + F.make_interval(years=none, days=k))
    exact = F.col("_start") + F.make_dt_interval(
        mins=F.when(F.col("_unit") == "minutes", k).otherwise(none),
        hours=F.when(F.col("_unit") == "hours", k).otherwise(none),
    )
    slot = F.when(calendar, F.to_utc_timestamp(moved.cast("timestamp"), F.col("timezone"))).otherwise(exact)
    return (
        rows.withColumn("slot", slot)
        .filter(F.col("slot") < F.col("_end"))
        .select(*_names(df), "slot_no", F.col("slot").cast("timestamp_ntz").alias("slot"))
    )


def missing_slots(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Slots without a run; ``runs`` has schedule and slot, and file where ``slots`` has it."""
    keys = [*_names(slots), "slot"]
    return slots.join(runs.select(*keys).distinct(), keys, "left_anti")


def runs_by_slot(slots: DataFrame, runs: DataFrame, tolerance_seconds: int, piece_seconds: int = 7 * 86_400) -> DataFrame:
    """Every slot with the first run that belongs to it: the columns of ``slots``, ``started`` and ``late_seconds``.

    A run (``started``, keyed as ``slots`` are) belongs to the latest slot of its schedule at or before it, if it starts less than
    ``tolerance_seconds`` after it. Slots without a run have NULLs. Slots and runs are one union, ordered by time, in which each run takes the last slot
    before it. The union is cut by schedule and ``piece_seconds`` of time, so that a schedule with any number of slots is no single task; a slot also goes to
    the later pieces that a run within the tolerance can fall into. A NULL start is no run.
    """
    names = _names(slots)
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    exact = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.lit(max(1, piece_seconds))
    own = F.floor(at("slot") / width)
    reached = F.floor((at("slot") + F.lit(tolerance_seconds)) / width)
    times = slots.select(
        *names, exact("slot").alias("_at"), F.lit(0).alias("_kind"), exact("slot").alias("_slot"), F.explode(F.sequence(own, reached)).alias("_piece")
    )
    started = runs.filter("started IS NOT NULL").select(
        *names, exact("started").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_slot"),
        F.floor(at("started") / width).alias("_piece"),
    )
    order = Window.partitionBy(*names, "_piece").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = times.unionByName(started).withColumn("_of", F.last("_slot", ignorenulls=True).over(order))
    late = F.col("_at") - F.col("_of")
    hits = both.filter((F.col("_kind") == 1) & (late < F.lit(tolerance_seconds * 1_000_000))).groupBy(*names, "_of").agg(F.min("_at").alias("_first"))
    hits = hits.select(*[F.col(n).alias(f"_of_{n}") for n in names], "_of", "_first")
    same = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]
    joined = slots.join(hits, reduce(lambda a, b: a & b, [*same, exact("slot") == F.col("_of")]), "left")
    return joined.select(
        *slots.columns,
        F.timestamp_micros("_first").cast("timestamp_ntz").alias("started"),
        ((F.col("_first") - F.col("_of")) / 1_000_000).alias("late_seconds"),
    )
