"""Tables: scans, loads, partition and bucket writes, full refreshes.

Writes that replace a table never read and write the same files: the new content is written to the
shared folder first and swapped in afterwards, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warehaul.operators.upsert import updated, upsert, without
from warehaul.session import remove_scratch, scratch_path, small


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Columnar or text files at a path."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header_lines: int = 0
) -> DataFrame:
    """Delimited text with a declared schema.

    The reader itself skips one header line. Of more header lines the first ``header_lines`` positions of each
    file are found by a group limit, which keeps that many rows per task and file, and those lines are left out.
    """
    options = {"sep": sep, "mode": "PERMISSIVE", "enforceSchema": "true"}
    if header_lines <= 1:
        return spark.read.schema(schema).options(**options, header=str(header_lines == 1).lower()).csv(path)
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    in_file = Window.partitionBy("_file").orderBy("_pos")
    first = lines.filter("_start = 0").select("_file", "_pos").withColumn("_line", F.row_number().over(in_file))
    heads = first.filter(F.col("_line") <= header_lines).groupBy("_file").agg(F.max("_pos").alias("_last"))
    heads = small(heads.withColumnRenamed("_file", "_headed"))
    same = (F.col("_file") == F.col("_headed")) & (F.col("_start") == 0) & (F.col("_pos") <= F.col("_last"))
    fields = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
    )
    rows = lines.join(heads, same, "left_anti").filter("value != ''")
    return rows.select(F.from_csv("value", F.lit(fields), options).alias("row")).select("row.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    df.write.format(fmt).partitionBy(*partition_by).mode("overwrite").save(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    df.write.mode("overwrite").options(sep=sep, header=str(header).lower()).csv(path)


def convert_format(spark: SparkSession, source: DataFrame, path: str, fmt: str) -> DataFrame:
    """Rewrite a table in another file format and read it from there."""
    write_table(source, path, fmt)
    return read_table(spark, path, fmt, source.schema)


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{at}")
    spark.catalog.setCurrentDatabase(name)


def create_table(
    spark: SparkSession, name: str, schema: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
    location: str | None = None,
) -> None:
    """Declared table, optionally partitioned and at a location of its own (external)."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING {fmt}{parts}{at}")


def recover_partitions(spark: SparkSession, name: str) -> None:
    """Add partition directories that were written past the catalog."""
    spark.sql(f"MSCK REPAIR TABLE {name}")


def insert_values(spark: SparkSession, name: str, rows: Sequence[tuple]) -> None:
    """Append literal rows; for a handful of rows, as in hand-written INSERT … VALUES."""
    spark.createDataFrame(list(rows), spark.table(name).schema).write.insertInto(name)


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def load_append(spark: SparkSession, path: str, fmt: str, name: str, **options: str) -> None:
    """Append files at ``path`` to a table, read with the table's schema (LOAD DATA … INTO TABLE)."""
    schema = spark.table(name).schema
    spark.read.format(fmt).schema(schema).options(**options).load(path).write.insertInto(name)


def ctas(df: DataFrame, name: str, fmt: str = "parquet", location: str | None = None) -> DataFrame:
    writer = df.write.format(fmt)
    (writer.option("path", location) if location else writer).saveAsTable(name)
    return df.sparkSession.table(name)


#: Partitions that one change names; a change that touches more rewrites the table.
MOST_PARTITIONS = 1000


def _partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _spec(values: Mapping[str, object]) -> str:
    quoted = {c: str(v).replace("\\", "\\\\").replace("'", "\\'") for c, v in values.items()}
    return ", ".join(f"`{c}` = '{v}'" for c, v in quoted.items())


def _overwrite(df: DataFrame, name: str, mode: str) -> None:
    """Replace the whole table (static) or only the partitions written (dynamic); columns are matched by name.

    The mode is an option of this one write and no setting of the session, so loads that run at once do not change
    each other's. The writer takes it for files only, so they are written to the table's place. Of a dynamic write the partitions are
    observed as they are written and added by name, so the table's other partitions are not listed; only partitions that are NULL or more
    than MOST_PARTITIONS, and a static write, bring all in line.
    """
    spark = df.sparkSession
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    parts = _partition_columns(spark, name)
    rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in spark.table(name).schema.fields])
    seen = Observation()
    if parts and mode == "dynamic":
        rows = rows.observe(seen, F.collect_set(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in parts])).alias("parts"))
    writer = rows.write.format(told["Provider"]).mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(*parts).save(told["Location"])
    if parts:
        written = [r.asDict() for r in seen.get["parts"]] if mode == "dynamic" else None
        if written is None or len(written) > MOST_PARTITIONS or any(v is None or v == "" for r in written for v in r.values()):
            spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        elif written:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({_spec(r)})" for r in written))
    spark.catalog.refreshTable(name)


def overwrite_partition(name: str, df: DataFrame, partition: Mapping[str, str]) -> None:
    """Replace one named partition and keep the others; an empty input empties the partition.

    All partition columns must be named, so that the statement means the same in either overwrite mode.
    """
    spark = df.sparkSession
    wanted = {c.name for c in spark.catalog.listColumns(name) if c.isPartition}
    if wanted != set(partition):
        raise ValueError(f"{name} is partitioned by {sorted(wanted)}")
    columns = [c for c in spark.table(name).columns if c not in partition]
    view = f"part_{uuid.uuid4().hex}"
    df.select(*columns).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({_spec(partition)}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def overwrite_dynamic(name: str, df: DataFrame) -> None:
    """Replace only the partitions present in the input; columns are matched by name."""
    _overwrite(df, name, "dynamic")


def refresh_in_place(spark: SparkSession, name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a table by a transform of itself: stage the result, then overwrite from the stage.

    A failure before the last step leaves the table as it was. The stage keeps the new content until the
    last step has succeeded, so that this can be repeated from it; then it goes.
    """
    table = spark.table(name)
    stage = scratch_path(spark, f"stage-{name.replace('.', '-')}")
    transform(table).select(*table.columns).write.parquet(stage)
    _overwrite(spark.read.schema(table.schema).parquet(stage), name, "static")
    remove_scratch(spark, stage)


def refresh_partitions(spark: SparkSession, name: str, touched: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> None:
    """As ``refresh_in_place``, but only the partitions in ``touched`` are read, transformed and written; the files of others stay.

    ``touched`` has the partition columns and must name every partition that the transform takes rows from or puts rows into. A change that touches
    a NULL partition or more than MOST_PARTITIONS, and a table without partitions, is rewritten whole.
    """
    table, parts = spark.table(name), _partition_columns(spark, name)
    named = touched.select(*parts).distinct().limit(MOST_PARTITIONS + 1).collect() if parts else []
    if not parts or len(named) > MOST_PARTITIONS or any(v is None for r in named for v in r):
        refresh_in_place(spark, name, transform)
        return
    if not named:
        return
    inside = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.lit(r[c]) for c in parts]) for r in named])
    stage = scratch_path(spark, f"stage-{name.replace('.', '-')}")
    transform(table.filter(inside)).select(*table.columns).write.parquet(stage)
    staged = spark.read.schema(table.schema).parquet(stage)
    left = set(map(tuple, staged.select(*parts).distinct().collect()))
    _overwrite(staged, name, "dynamic")
    for r in named:
        if tuple(r) not in left:
            overwrite_partition(name, staged.limit(0), r.asDict())
    remove_scratch(spark, stage)


def upsert_table(spark: SparkSession, name: str, source: DataFrame, keys: Sequence[str], set_cols=None) -> None:
    """Merge ``source`` into a table; of a partitioned one the partitions of matched rows and of source rows are rewritten."""
    table, parts = spark.table(name), _partition_columns(spark, name)
    merge = lambda t: upsert(t, source, keys, set_cols)
    if not parts or not set(parts) <= set(source.columns):
        refresh_in_place(spark, name, merge)
        return
    matched = table.join(small(source.select(*keys).distinct()), list(keys), "left_semi").select(*parts)
    kinds = dict(table.dtypes)
    refresh_partitions(spark, name, matched.unionByName(source.select(*[F.col(c).cast(kinds[c]).alias(c) for c in parts])), merge)


def update_rows(spark: SparkSession, name: str, pred: Column, values: Mapping[str, Column]) -> None:
    """Change rows where the predicate is true; only partitions that hold such rows, or get them, are rewritten."""
    hit, parts = spark.table(name).filter(pred), _partition_columns(spark, name)
    touched = hit.select(*parts)
    if set(parts) & set(values):
        touched = touched.unionByName(hit.withColumns(dict(values)).select(*[F.col(c).cast(dict(hit.dtypes)[c]).alias(c) for c in parts]))
    refresh_partitions(spark, name, touched, lambda t: updated(t, pred, values))


def delete_rows(spark: SparkSession, name: str, pred: Column | None = None) -> None:
    """Delete rows where the predicate is true; without a predicate, all rows. Only partitions that hold such rows are rewritten."""
    if pred is None and spark.catalog.getTable(name).tableType == "MANAGED":
        spark.sql(f"TRUNCATE TABLE {name}")
    elif pred is None:  # Spark does not truncate tables at a location of their own
        _overwrite(spark.createDataFrame([], spark.table(name).schema), name, "static")
    else:
        refresh_partitions(spark, name, spark.table(name).filter(pred), lambda t: without(t, pred))


def add_columns(spark: SparkSession, name: str, columns: Mapping[str, str]) -> None:
    """New columns; rows written before read NULL there."""
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{c} {t}' for c, t in columns.items())})")


def fan_out(df: DataFrame, targets: Mapping[str, Column], base: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """One scan, many targets: a row goes to every target whose predicate is true, or to none.

    All targets are written by one job, as partitions of ``base``.
    """
    routes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in targets.items()]))
    df.withColumn("_target", F.explode(routes)).write.format(fmt).partitionBy("_target").mode("overwrite").save(base)
    spark = df.sparkSession
    tagged = StructType([*df.schema.fields]).add("_target", "string")
    whole = spark.read.format(fmt).schema(tagged).load(base)
    return {name: whole.filter(F.col("_target") == name).drop("_target") for name in targets}


def write_bucketed(
    df: DataFrame, name: str, n: int, columns: Sequence[str], sort: Sequence[str] = (), location: str | None = None,
    fmt: str = "parquet",
) -> None:
    """Bucketed and sorted table. Rows are shuffled to their bucket first, so each bucket is one file."""
    writer = df.repartition(n, *columns).write.format(fmt).bucketBy(n, *columns)
    if sort:
        writer = writer.sortBy(*sort)
    if location:
        writer = writer.option("path", location)
    writer.mode("overwrite").saveAsTable(name)


def split_errors(df: DataFrame, col: str, expr: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that converted, rows that failed): ``expr`` gives NULL where the value of ``col`` is bad."""
    done = df.withColumn(name, expr)
    failed = F.col(name).isNull() & F.col(col).isNotNull()
    return done.filter(~failed), done.filter(failed).drop(name)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, n: int, **options: str
) -> DataFrame:
    """Table read in ``n`` parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n, **options
    ).load()


def write_jdbc(df: DataFrame, url: str, table: str, n: int, **options: str) -> None:
    """Append with at most ``n`` connections."""
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=n, **options).mode("append").save()
