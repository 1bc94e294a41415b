"""Many report definitions as tables: sources, datasets, items, parameters, status and warnings."""

from __future__ import annotations

from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.functions.scalar import any_match
from warehaul.sources.corpora import parse_xml

_SOURCES = (
    "DataSources struct<DataSource:array<struct<_Name:string,"
    "ConnectionProperties:struct<ConnectString:string,DataProvider:string>>>>"
)
_PARAMETERS = "ReportParameters struct<ReportParameter:array<struct<_Name:string>>>"
_DATASET = (
    "array<struct<_Name:string,Query:struct<CommandType:string,CommandText:string,"
    "QueryParameters:struct<QueryParameter:array<struct<_Name:string>>>>>>"
)
# datasets stand in a list, or by themselves in the file of a shared dataset
_DATASETS = f"DataSets struct<DataSet:{_DATASET}>, DataSet {_DATASET}"
_ITEMS = "array<struct<item_type:string,name:string,dataset:string>>"


def _items(texts: pd.Series) -> pd.Series:
    """Items of a report at any depth, kind by kind, with the first dataset named inside each.

    Items nest without a limit, which a declared schema cannot say, so this one list is made in
    Python on Arrow batches. Unreadable XML has no items.
    """

    def local(element) -> str:
        return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""

    def items(text: str | None) -> list[dict]:
        try:
            root = ElementTree.fromstring((text or "").encode())
        except ElementTree.ParseError:
            return []
        found = []
        for element in root.iter():
            if local(element) in fv.REPORT_ITEM_KINDS:
                named = next((e for e in element.iter() if local(e) == "DataSetName"), None)
                dataset = (named.text or "").strip() if named is not None else ""
                found.append({"item_type": local(element), "name": element.get("Name", ""), "dataset": dataset})
        return sorted(found, key=lambda i: fv.REPORT_ITEM_KINDS.index(i["item_type"]))

    return texts.map(items)


class ReportTables(NamedTuple):
    reports: DataFrame
    data_sources: DataFrame
    parameters: DataFrame
    datasets: DataFrame
    items: DataFrame
    code_blocks: DataFrame


def _dataset_list() -> Column:
    def dataset(d: Column) -> Column:
        query = d["Query"]
        names = F.coalesce(query["QueryParameters"]["QueryParameter"]["_Name"], F.array().cast("array<string>"))
        return F.struct(
            F.coalesce(d["_Name"], F.lit("")).alias("dataset"),
            F.coalesce(F.trim(query["CommandType"]), F.lit("Text")).alias("query_language"),
            F.coalesce(F.trim(query["CommandText"]), F.lit("")).alias("query"),
            F.filter(names, lambda p: p != "").alias("parameters"),
        )

    kind = "array<struct<dataset:string,query_language:string,query:string,parameters:array<string>>>"
    return F.coalesce(
        F.transform(F.coalesce("doc.DataSets.DataSet", "doc.DataSet"), dataset), F.array().cast(kind)
    )


def report_tables(df: DataFrame, xml: str = "text", stem: str = "stem") -> ReportTables:
    """Tables of a corpus of report XML, keyed by ``file`` (the stem), as names may repeat. A report without a
    name takes its file stem.

    ``reports`` has one row per file and holds its datasets and parameters as lists, so what
    follows from a single report needs no shuffle. The other tables are its children.
    """

    def parsed(part: str) -> DataFrame:
        """The corpus read with the schema of some parts only."""
        docs = parse_xml(df, xml, f"Name string, {part}")
        name = F.coalesce(F.nullif(F.trim("doc.Name"), F.lit("")), F.col(stem))
        return docs.select(
            F.col(stem).alias("file"),
            F.when(F.col("doc_bad"), F.col(stem)).otherwise(name).alias("report"),
            F.col("doc_bad").alias("unreadable"),
            "doc",
            F.col(xml).alias("xml"),
        )

    def child(part: str, elements: Column | str) -> DataFrame:
        # the outer form keeps Spark from parsing the XML again in a derived filter
        rows = parsed(part).select("file", "report", F.posexplode_outer(elements).alias("pos", "n"))
        return rows.filter("pos IS NOT NULL")

    code = F.nullif(F.trim("doc.Code"), F.lit(""))
    names = F.coalesce("doc.ReportParameters.ReportParameter._Name", F.array().cast("array<string>"))
    return ReportTables(
        reports=parsed(f"Code string, {_DATASETS}, {_PARAMETERS}").select(
            "file",
            "report",
            "unreadable",
            code.isNotNull().alias("has_code"),
            _dataset_list().alias("dataset_list"),
            F.filter(names, lambda n: n != "").alias("parameter_list"),
        ),
        data_sources=child(_SOURCES, "doc.DataSources.DataSource").select(
            "file",
            "report",
            F.coalesce("n._Name", F.lit("")).alias("data_source"),
            F.coalesce(F.trim("n.ConnectionProperties.ConnectString"), F.lit("")).alias("connection"),
            F.coalesce(F.trim("n.ConnectionProperties.DataProvider"), F.lit("")).alias("provider"),
        ),
        parameters=child(_PARAMETERS, "doc.ReportParameters.ReportParameter")
        .select("file", "report", "pos", F.col("n._Name").alias("parameter"))
        .filter("parameter != ''"),
        datasets=child(_DATASETS, _dataset_list()).select("file", "report", "pos", "n.*"),
        items=parsed("Code string")
        .select("file", "report", F.explode_outer(F.pandas_udf(_items, _ITEMS)("xml")).alias("i"))
        .filter("i IS NOT NULL")
        .select("file", "report", "i.*"),
        code_blocks=parsed("Code string").select("file", "report", code.alias("code")).filter("code IS NOT NULL"),
    )


def _convertible() -> Column:
    return ~F.col("unreadable") & F.exists("dataset_list", lambda d: d["query_language"] == "Text")


def report_status(tables: ReportTables) -> DataFrame:
    """Convertible means readable with at least one Text dataset; code blocks do not veto."""
    return tables.reports.select(
        "file",
        "report",
        _convertible().alias("convertible"),
        F.size("dataset_list").cast("bigint").alias("datasets"),
    )


def report_warnings(tables: ReportTables) -> DataFrame:
    """(file, report, place, warning): unreadable files, code blocks, datasets by kind and dialect hints,
    in the order of ``place``."""

    def of_dataset(d: Column) -> Column:
        name, query = d["dataset"], d["query"]
        hints = F.transform(
            any_match(query, [fv.IGNORE_CASE + p for p in fv.DIALECT_HINTS]),
            lambda p: F.format_string(
                fv.DIALECT_WARNING, name, F.substring(p, F.lit(len(fv.IGNORE_CASE) + 1), F.length(p))
            ),
        )
        return (
            F.when(
                d["query_language"] == "StoredProcedure",
                F.array(F.format_string(fv.STORED_PROCEDURE_WARNING, name, query)),
            )
            .when(
                d["query_language"] == "TableDirect", F.array(F.format_string(fv.TABLE_DIRECT_WARNING, name, query))
            )
            .otherwise(hints)
        )

    def only_if(test: Column, message: str) -> Column:
        return F.when(test, F.array(F.lit(message))).otherwise(F.array().cast("array<string>"))

    readable = ~F.col("unreadable")
    every = F.concat(
        only_if(F.col("unreadable"), fv.UNREADABLE_WARNING),
        only_if(readable & F.col("has_code"), fv.CODE_BLOCK_WARNING),
        F.flatten(F.transform("dataset_list", of_dataset)),
        only_if(readable & (F.size("dataset_list") == 0), fv.NO_DATASET_WARNING),
    )
    rows = tables.reports.select("file", "report", F.posexplode_outer(every).alias("place", "warning"))
    return rows.filter("warning IS NOT NULL")


def report_records(tables: ReportTables) -> DataFrame:
    """One nested record per report file, for a JSON sink."""
    return tables.reports.select(
        "file", "report", _convertible().alias("convertible"), "has_code", "dataset_list", "parameter_list"
    )


def fleet_summary(tables: ReportTables) -> DataFrame:
    """Reports, convertible reports and notebooks to write, as one row."""
    return report_status(tables).agg(
        F.count("*").alias("reports"),
        F.count_if("convertible").alias("convertible"),
        F.count_if(~F.col("convertible")).alias("manual"),
        F.sum("datasets").alias("datasets"),
    )
