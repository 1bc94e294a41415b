"""Session helpers: shared folder, checkpoints and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("warehaul")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="warehaul-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/warehaul/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this library, in whatever store the shared folder is."""
    if not path.startswith(f"{shared_folder(spark)}/warehaul/"):
        raise ValueError(f"{path} is no scratch path")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, column by column as needed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handed_on(df: DataFrame, name: str, *sources: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``materialised``, packed tighter, with its path and a folder for each value of ``by``: a step that only the next one reads.

    Once ``df`` is written, the scratch paths ``sources`` that it was computed from go, and so do the shuffle files of the
    write: Spark's cleaner deletes them after a collection of the driver, which else may come late.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    for source in sources:
        remove_scratch(spark, source)
    spark._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Reads no more than ``max_rows + 1`` rows.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its size allows it, else ``df`` as it is."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer files or partitions than cores, hashed over all cores by ``keys``.

    For work that is heavy per row, as on texts. Splits of a file count for nothing here, as a file may hold one row group,
    which one task reads. Inputs of many files stay as they are.
    Only the planned number of partitions is asked for; nothing runs.
    """
    cores, parts, files = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), len(df.inputFiles())
    return df.repartition(max(3 * cores, parts), *keys) if min(parts, files or parts) < cores else df


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal ``columns`` together for a partitioned write: the adaptive engine splits large
    groups and merges small ones, so files have a sensible size whatever the skew."""
    return df.hint("rebalance", *columns)
