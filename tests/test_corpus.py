import json

import pytest

from tests.conftest import rows
from warehaul.functions import fixed_values as fv
from warehaul.operators import corpus
from warehaul.sources.corpora import read_cells

VARIABLES = """-- variables
SET run_dt=2025-01-01;
SET hivevar:region=us;
SET hivevar:env=dev;
SET hive.exec.parallel=true;
SET note=it's;
SELECT * FROM sales WHERE dt = '${run_dt}';
INSERT OVERWRITE TABLE sales_${hivevar:region} SELECT ${missing};
SET region=eu;
"""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_variables(spark):
    got = corpus.extract_placeholders(one(spark, VARIABLES), "id", "text").orderBy("position").collect()
    assert [(r["name"], r["value"]) for r in got] == [
        ("run_dt", "'2025-01-01'"), ("region", "'eu'"), ("missing", "'UNKNOWN'"), ("env", "'dev'"), ("note", "'it''s'"),
    ]


def test_audit_lines_counts_and_matches_across_lines(spark):
    text = "add jar a;\nselect 1;\nADD  JAR b; ${x}\ncreate temporary\nfunction f"
    got = {r["rule_no"]: r for r in corpus.audit(one(spark, text), "id", "text").collect()}
    assert list(got[0]["lines"]) == [1, 3] and got[0]["count"] == 2 and got[0]["severity"] == "BLOCKER"
    assert list(got[1]["lines"]) == [] and got[1]["count"] == 0
    assert list(got[2]["lines"]) == [3]
    assert corpus.audit(one(spark, "ADDJAR x"), "id", "text").count() == 0


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [(2, "B", "INFO", "b", "y", True), (1, "A", "ERROR", "a", "x", False)],
        "position int, category string, severity string, message string, pattern string, ignore_case boolean",
    )
    rules = corpus.rules_from_table(table)
    assert [r.category for r in rules] == ["A", "B"]
    issues = corpus.audit(one(spark, "X Y x"), "id", "text", rules)
    assert rows(issues, "category") == [("A",), ("B",)]
    assert rows(corpus.severity_matrix(issues, "id")) == [(1, 0, 1, 0, 1)]
    many = [corpus.Rule("A", "INFO", str(i), f"n{i}\\b") for i in range(450)]
    found = corpus.audit(one(spark, "n0 n199 n200 n449"), "id", "text", many)
    assert rows(found, "rule_no") == [(0,), (199,), (200,), (449,)]


def test_statement_findings(spark):
    texts = [
        "MSCK REPAIR TABLE t",
        "FROM s INSERT OVERWRITE TABLE a SELECT 1 INSERT OVERWRITE TABLE b SELECT 2",
        "load data inpath 'x' into table t",
        "CREATE EXTERNAL TABLE a (id INT) LOCATION '/x'",
        "create table a (id int)",
        "CREATE TABLE a LOCATION '/x' AS SELECT 1",
        "CREATE TABLE a (id INT) LOCATION '/x'",
        "INSERT INTO t SELECT * FROM s",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, statement string")
    assert rows(corpus.classify(df, "statement"), "id", "category") == [
        (0, "HIVE_COMMAND"), (1, "MULTI_INSERT"), (2, "UNSUPPORTED"), (3, "DDL_UNSUPPORTED"), (4, "DDL_REVIEW"), (5, "CTAS_REVIEW"),
    ]


@pytest.mark.parametrize(
    "before, after",
    [
        ("SELECT nvl (a, 1)", "SELECT COALESCE(a, 1)"),
        ("from_unixtime(x, 'yyyy')", "DATE_FORMAT(TIMESTAMP_SECONDS(x), 'yyyy')"),
        ("from_unixtime( x )", "TIMESTAMP_SECONDS(x)"),
        ("UNIX_TIMESTAMP( )", "CURRENT_TIMESTAMP()"),
        ("/*+ MAPJOIN(c) */", "/*+ BROADCAST(c) */"),
        ("ANALYZE TABLE t COMPUTE\nSTATISTICS FOR COLUMNS", "ANALYZE TABLE t COMPUTE STATISTICS FOR ALL COLUMNS"),
        ("SELECT plain", "SELECT plain"),
    ],
)
def test_statement_rewrites(spark, before, after):
    assert corpus.rewrite(one(spark, before), "text").first()["text"] == after


@pytest.mark.parametrize(
    "code, text, warnings",
    [
        ('sc.textFile("hdfs://nn:8020/data/x")', 'sc.textFile("dbfs:/data/x")', [0]),
        ('spark.read.csv("hdfs:///data/x")', 'spark.read.csv("dbfs:/data/x")', []),
        ("sc = SparkContext()\nconf = SparkConf()", None, [1, 4]),
        ("df.foreachPartition(f); rows = df.collect()", None, [2, 3]),
        ("df.repartition(200)", None, [5]),
        ("df.repartition(20).limit(3)", None, []),
    ],
)
def test_code_rewrites_and_warnings(spark, code, text, warnings):
    got = corpus.migrate_texts(one(spark, code), "text").first()
    assert got["text"] == (text or code)
    assert got["warnings"] == [fv.CODE_WARNINGS[i][1] for i in warnings]


def test_notebook_cells(spark):
    notebook = {
        "cells": [
            {"cell_type": "code", "source": ["rows = df.collect()\n", 'x = "hdfs:///a"']},
            {"cell_type": "markdown", "source": "see df.collect() at hdfs:///a"},
            {"cell_type": "code", "source": "sc = SparkContext(); y = df.collect()"},
        ]
    }
    df = spark.createDataFrame([(1, json.dumps(notebook))], "id int, json string")
    cells, warnings = corpus.migrate_cells(read_cells(df, "id", "json"), "id", "pos", "kind", "text")
    assert [r["text"] for r in cells.orderBy("pos").collect()] == [
        'rows = df.collect()\nx = "dbfs:/a"', "see df.collect() at hdfs:///a", "sc = SparkContext(); y = df.collect()",
    ]
    assert warnings.first()["warnings"] == [fv.CODE_WARNINGS[3][1], fv.CODE_WARNINGS[1][1]]


def test_replacement_guards(spark):
    old = spark.createDataFrame(
        [(0, "INSERT INTO t SELECT 1"), (1, "INSERT OVERWRITE t PARTITION(d) SELECT 1"), (2, "SELECT 1 AS x"), (3, "SELECT 3")],
        "idx int, text string",
    )
    new = spark.createDataFrame(
        [(0, "SELECT 1 FROM somewhere"), (1, "INSERT INTO t SELECT 1"), (2, "SELECT 2 AS better"), (9, "SELECT 'unknown'")],
        "idx int, text string",
    )
    got = {r["idx"]: (r["text"], r["skip_reason"], r["replaced"]) for r in corpus.apply_replacements(old, new, ["idx"]).collect()}
    assert got == {
        0: ("INSERT INTO t SELECT 1", "INSERT guard failed", False),
        1: ("INSERT OVERWRITE t PARTITION(d) SELECT 1", "PARTITION guard failed", False),
        2: ("SELECT 2 AS better", None, True),
        3: ("SELECT 3", None, False),
        9: (None, "unknown id", False),
    }
