"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warehaul.llm import decontaminate, personal, pieces, resample, similar
from warehaul.llm.common import fresh, quoted
from warehaul.session import materialised


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling leaves out go."""
    kept = fresh(docs.columns, "kept")
    found = resample.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=kept)
    return found.filter(quoted(kept)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id, a null one only if there is no other.

    Texts with a five-word Jaccard similarity of at least 0.8 are linked, texts without words are alike. Rows are
    told apart by id and text, so different texts stay whether their ids are null, repeated or neither.
    """
    named, place = (fresh(docs.columns, n) for n in ("text_class", "place"))
    told = docs.withColumn(named, similar.text_class(F.col("text")))
    slim = told.select(F.col(quoted(named)).alias("class"), F.col("doc_id").alias("id"), "text")
    roots = similar.linked(slim.select("class", "text"))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "class", "copies")
    firsts = slim.groupBy("class", "id").agg(F.count("*").alias("copies")).groupBy("class").agg(F.min(order).alias("first"))
    rooted = firsts.join(roots, F.col("class") == F.col("node"), "left")
    least = rooted.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("first").alias("first"))
    kept_id, kept_class = (fresh(told.columns, n) for n in ("kept_id", "kept_class"))
    kept = materialised(
        least.select(F.col("first.id").alias(kept_id), F.col("first.class").alias(kept_class), "first.copies"), "kept"
    )
    same = F.col(quoted(named)).eqNullSafe(F.col(kept_class)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    rows = told.join(kept.select(kept_id, kept_class), same, "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        # of rows alike in id and text one stays, whatever their other columns
        hashed = [quoted(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        window = Window.partitionBy(quoted(named), "doc_id").orderBy(F.xxhash64(*hashed))
        rows = rows.withColumn(place, F.row_number().over(window)).filter(F.col(quoted(place)) == 1)
    return rows.select(*map(quoted, docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no document goes."""
    return personal.masked(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ``doc_id``, ``lang``, ``source`` and its pieces; the text is what they decode to."""
    return pieces.encoded(docs, carry=["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("piece_ids", piece_ids),
]
