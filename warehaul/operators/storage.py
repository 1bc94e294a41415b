"""Storage listings as tables: entries, copy manifests, volumes, rewritten locations, usage by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.functions.scalar import parent_path


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing text at ``path`` as entries."""
    return parse_listing(spark.read.text(path))


def parse_listing(df: DataFrame, line: str = "value") -> DataFrame:
    """Listing lines to entries; other lines (headers, counts) drop."""
    names = ("kind", "replication", "owner", "group", "size", "date", "time", "path")
    text = F.trim(F.col(line))
    parts = {n: F.regexp_extract(text, fv.LISTING_LINE, i + 1) for i, n in enumerate(names)}
    return df.filter(text.rlike(fv.LISTING_LINE)).select(
        F.when(parts["kind"] == "d", "dir").otherwise("file").alias("entry_type"),
        F.trim(parts["path"]).alias("path"),
        parts["replication"].try_cast("int").alias("replication"),
        parts["owner"].alias("owner"),
        parts["group"].alias("group"),
        parts["size"].try_cast("bigint").alias("size"),
        F.try_to_timestamp(F.concat_ws(" ", parts["date"], parts["time"]), F.lit("yyyy-MM-dd HH:mm"))
        .cast("timestamp_ntz")
        .alias("modified"),
    )


def files_only(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("entry_type") == "file")


def target_path(path: Column, host: str = "") -> Column:
    """``dbfs:`` path of a storage path, without the host."""
    bare = F.when(path.startswith(host), F.substring(path, F.lit(len(host) + 1), F.length(path))).otherwise(path) if host else path
    return F.when(bare.startswith("dbfs:"), bare).otherwise(F.concat(F.lit("dbfs:"), bare))


def copy_manifest(entries: DataFrame, host: str = fv.NAME_NODE) -> DataFrame:
    """Source and target of every file to copy."""
    return files_only(entries).select(
        F.concat(F.lit(host), "path").alias("source"), target_path(F.col("path")).alias("target"), "size"
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One text line per file: source, tab, target."""
    manifest.select(F.concat_ws("\t", "source", "target").alias("value")).write.text(path)


def volume_plan(
    entries: DataFrame, catalog: str = fv.VOLUME_CATALOG, schema: str = fv.VOLUME_SCHEMA,
    base: str = f"abfss://{fv.LAKE_CONTAINER}@{fv.LAKE_ACCOUNT}.dfs.core.windows.net",
) -> DataFrame:
    """One volume per distinct parent directory of all entries; entries at the top have none."""
    parents = entries.select(parent_path(F.col("path")).alias("directory")).filter("directory != ''").distinct()
    name = F.replace(F.trim(F.col("directory"), F.lit("/")), F.lit("/"), F.lit("_"))
    return parents.select(
        "directory",
        F.concat(F.lit(f"{catalog}.{schema}."), name).alias("volume"),
        F.concat(F.lit(base), "directory").alias("location"),
    )


def rewrite_locations(
    df: DataFrame, col: str, target: str = "dbfs", container: str = fv.LAKE_CONTAINER, account: str = fv.LAKE_ACCOUNT
) -> DataFrame:
    """Rewrite ``LOCATION 'hdfs://host/p'`` clauses inside texts to the target store; others stay."""
    prefix = "dbfs:" if target == "dbfs" else f"abfss://{container}@{account}.dfs.core.windows.net"
    return df.withColumn(col, F.regexp_replace(col, "(?iU)" + fv.LOCATION_CLAUSE, f"LOCATION '{prefix}$1'"))


def usage_by_dir(entries: DataFrame, depth: int | None = None) -> DataFrame:
    """Files and bytes under every directory, down to ``depth`` levels.

    Each file adds to all directories above it; the sums combine on the map side, so the root,
    which holds everything, is no bottleneck.
    """
    segments = F.filter(F.split(parent_path(F.col("path")), "/"), lambda s: s != "")
    levels = F.size(segments) if depth is None else F.least(F.size(segments), F.lit(depth))
    prefixes = F.transform(
        F.sequence(F.lit(0), levels), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/"))
    )
    return (
        files_only(entries)
        .select(F.explode_outer(prefixes).alias("directory"), "size")
        .groupBy("directory")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Number and total size of the files under ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("length")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )
