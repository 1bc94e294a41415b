"""Incremental daily summaries.

``stream_daily_totals`` adds up what can be added up and reads every row once. ``stream_daily_summary`` takes any
summary and computes the touched days again from the source.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warehaul.session import small
from warehaul.sources.tables import overwrite_dynamic


def stream_daily_summary(
    stream: DataFrame,
    source: Callable[[], DataFrame],
    summarise: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    ts: str = "ts",
    day: str = "day",
) -> None:
    """Drain ``stream`` into the table ``target``, partitioned by ``day``.

    A batch only says which days have new rows; those days are summarised again from ``source()``
    and replace their partitions. So late rows count, and a batch that is run twice gives the same table.
    A source partitioned by ``day`` is read only for the touched days.
    """

    def merge(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date(ts).alias(day)).distinct()
        full = source()
        if day not in full.columns:
            full = full.withColumn(day, F.to_date(ts))
        touched = full.join(small(days), day, "left_semi")
        overwrite_dynamic(target, summarise(touched))

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_daily_totals(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], totals: Mapping[str, Column],
    ts: str = "ts", day: str = "day", batch_column: str = "batch",
) -> None:
    """Drain ``stream`` into ``target``, a table of partial sums partitioned by ``batch_column``.

    Each batch is read once: its rows are summed per day and ``keys`` and written as the partition of that
    batch, so nothing that came before is read again, late rows count, and a batch that is run twice
    replaces its own partition. ``totals`` are aggregates that add up (counts and sums); see ``daily_totals``.
    """

    def add(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy(F.to_date(ts).alias(day), *keys).agg(*[c.alias(n) for n, c in totals.items()])
        overwrite_dynamic(target, partial.withColumn(batch_column, F.lit(number)))

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def daily_totals(partials: DataFrame, keys: Sequence[str], totals: Sequence[str], day: str = "day") -> DataFrame:
    """The partial sums of all batches added up."""
    return partials.groupBy(day, *keys).agg(*[F.sum(t).alias(t) for t in totals])


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Files that arrive at ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
