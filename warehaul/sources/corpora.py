"""Collections of small files: scripts, XML and notebook documents, JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warehaul.functions.scalar import file_stem

BAD = "_corrupt_record"


def read_scripts(
    spark: SparkSession, path: str, suffixes: Sequence[str] = (".hql", ".hive", ".sql", ".ddl", ".dml")
) -> DataFrame:
    """One row per script file below ``path`` with one of the suffixes; bad bytes are replaced.

    Files with other suffixes are never opened: the reader lists only names that end in a suffix, in any case.
    """
    letters = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    ending = "*{" + ",".join(letters(s) for s in suffixes) + "}"
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", ending).text(path, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.filter(ends.isin([s.lower() for s in suffixes])).select(
        "path", file_stem(F.col("path")).alias("stem"), F.make_valid_utf8("text").alias("text")
    )


def parse_xml(df: DataFrame, xml: str, schema: str, name: str = "doc") -> DataFrame:
    """XML texts to nested rows, whatever namespace prefixes they use.

    ``<name>_bad`` is true for unreadable XML, whose fields are NULL.
    """
    parsed = F.from_xml(xml, f"{schema}, {BAD} string", {"ignoreNamespace": "true"})
    # a generator keeps Spark from parsing a text again for every filter and column that reads the result
    once = F.inline_outer(F.array(F.struct(parsed.alias(name))))
    return df.select("*", once).withColumn(
        f"{name}_bad", F.col(f"{name}.{BAD}").isNotNull() | F.col(xml).isNull()
    )


def unreadable_files(df: DataFrame, xml: str, schema: str, stem: str = "stem") -> DataFrame:
    """Files whose text is no readable XML, with the reason: (file, reason)."""
    reason = F.when(F.col(xml).isNull(), "no text").when(F.trim(xml) == "", "empty text").otherwise("XML parse error")
    return parse_xml(df, xml, schema).filter("doc_bad").select(F.col(stem).alias("file"), reason.alias("reason"))


def read_xml_corpus(spark: SparkSession, path: str, schema: str, suffixes: Sequence[str] = (".xml",)) -> DataFrame:
    """XML files below ``path`` as (path, stem, text, doc, doc_bad)."""
    return parse_xml(read_scripts(spark, path, suffixes), "text", schema)


CELLS_AS_TEXT = "struct<cells:array<struct<cell_type:string,source:string>>>"
CELLS_AS_LIST = "struct<cells:array<struct<source:array<string>>>>"


def read_cells(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Notebook JSON to numbered cells (id, pos, kind, text); a source may be a text or a list of texts."""
    both = F.arrays_zip(
        F.from_json(json_col, CELLS_AS_TEXT)["cells"].alias("plain"),
        F.from_json(json_col, CELLS_AS_LIST)["cells"].alias("listed"),
    )
    cells = df.select(id_col, F.posexplode_outer(both).alias("pos", "cell")).filter("pos IS NOT NULL")
    return cells.select(
        id_col,
        "pos",
        F.col("cell.plain.cell_type").alias("kind"),
        F.coalesce(F.array_join("cell.listed.source", ""), F.col("cell.plain.source")).alias("text"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """Nested records, one JSON object per line."""
    df.write.mode("overwrite").json(path)
