"""Column functions with the meaning that migrated scripts expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.functions.fixed_values import FREQUENCY


def joined(col: Column, sep: str = ",") -> Column:
    """List to text; NULL gives the empty text."""
    return F.coalesce(F.concat_ws(sep, col), F.lit(""))


def parent_path(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    """The last path segment."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last suffix; both kinds of slashes separate."""
    return F.regexp_replace(base_name(F.replace(path, F.lit("\\"), F.lit("/"))), r"\.[^.]*$", "")


def app_name(path: Column) -> Column:
    """Last segment of an application path, without scheme, host, leading variable or end slash."""
    bare = F.regexp_replace(F.regexp_replace(path, fv.LEADING_VARIABLE, ""), fv.PATH_HOST, "")
    return base_name(F.regexp_replace(bare, "/+$", ""))


def normal_name(name: Column) -> Column:
    """Lower case, runs of hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(name), fv.NAME_BREAKS, "_")


def task_key(name: Column) -> Column:
    """Characters that are not allowed in a task key become underscores."""
    return F.regexp_replace(name, fv.KEY_BREAKS, "_")


def currency(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def epoch_millis(iso: Column) -> Column:
    """ISO time with zone to milliseconds; bad text gives NULL."""
    spaced = F.regexp_replace(iso, r"Z$", "+00:00")
    return F.coalesce(
        *[F.unix_millis(F.try_to_timestamp(spaced, F.lit(p))) for p in (
            "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
        )]
    )


def key_values(entries: Column) -> Column:
    """``key=value`` list to a map: split at the first ``=``, trimmed, the last value of a key wins."""
    pairs = F.transform(
        F.filter(entries, lambda e: e.contains("=")),
        lambda e: F.struct(
            F.trim(F.regexp_extract(e, "(?s)^([^=]*)=", 1)).alias("key"),
            F.trim(F.regexp_extract(e, "(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """Array of (key, value) to a map in which later pairs replace earlier ones."""
    later = F.transform(
        pairs,
        lambda p, i: F.struct(
            p["key"].alias("key"),
            p["value"].alias("value"),
            F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]).alias("replaced"),
        ),
    )
    return F.map_from_entries(
        F.transform(F.filter(later, lambda p: ~p["replaced"]), lambda p: F.struct(p["key"], p["value"]))
    )


def overlay(*maps: Column) -> Column:
    """Later maps win over earlier ones; NULL maps count as empty."""
    entries = [F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]
    return last_wins(F.concat(*entries))


def without_private(m: Column) -> Column:
    """Map without the keys that start with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def frequency(text: Column) -> tuple[Column, Column]:
    """(unit, count) of a schedule frequency: ``${coord:hours(2)}`` or a number of minutes."""
    pattern = "(?i)^" + FREQUENCY
    text = F.trim(text)
    named = F.lower(F.regexp_extract(text, pattern, 1))
    unit = F.when(named != "", named).when(text.rlike("^[0-9]+$"), "minutes")
    amount = F.when(named != "", F.regexp_extract(text, pattern, 2)).otherwise(text)
    return unit, amount.try_cast("int")


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Array of the patterns found in the text, in the given order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in patterns]))
