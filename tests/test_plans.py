"""Physical plans: what is pushed down, pruned, shuffled or broadcast."""

import re

from pyspark.sql import functions as F

from warehaul import plans
from warehaul.operators import corpus, joins, reports
from warehaul.operators.windows import top_n_per_key

SF = "/root/testdata/sf0.001"
#: Queries whose join has no equal keys by nature; one side is a fixed or checked number of rows.
KEYLESS: set[str] = set()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_reads_only_its_days_and_columns(spark):
    text = plan(plans.QUERIES["report_order_summary"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)
    assert "o_orderpriority" not in text


def test_partition_filter_prunes_directories(spark):
    text = plan(plans.QUERIES["scan_orc_partitioned"](spark, SF))
    assert re.search(r"PartitionFilters: \[.*o_orderstatus.* = F", text)


def test_top_rows_are_cut_before_the_shuffle(spark):
    text = plan(top_n_per_key(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], ["-id"], 2))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_text_rules_need_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (
        corpus.audit(docs, "doc_id", "text"),
        corpus.rewrite(docs, "text"),
        corpus.migrate_texts(docs, "text"),
        corpus.extract_placeholders(docs, "doc_id", "text"),
        corpus.classify(docs, "text"),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_report_status_and_warnings_need_no_shuffle(spark):
    tables = reports.report_tables(spark.createDataFrame([("a", "<Report/>")], "stem string, text string"))
    for df in (reports.report_status(tables), reports.report_warnings(tables), reports.report_records(tables), tables.datasets):
        assert "Exchange" not in plan(df)


def test_xml_is_parsed_once_per_table(spark):
    tables = reports.report_tables(spark.createDataFrame([("a", "<Report/>")], "stem string, text string"))
    assert plan(tables.datasets).count("from_xml(") == 1


def test_no_query_joins_without_keys(spark):
    for name, query in plans.QUERIES.items():
        text = plan(query(spark, SF))
        assert "Cartesian" not in text, name
        assert "NestedLoop" not in text or name in KEYLESS, name


def test_large_sides_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big, one = spark.range(300_000), spark.range(10)
        assert "BroadcastHashJoin" not in plan(joins.join_small(one, big, "id"))
        assert "BroadcastHashJoin" in plan(joins.join_small(big, one, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_order_lines_and_documents_are_not_dealt_out(spark):
    for name in ("sales_by_category_city", "function_tour", "audit_documents"):
        assert "REPARTITION_BY_NUM" not in plan(plans.QUERIES[name](spark, SF)), name


def test_rounds_of_a_long_chain_grow_with_its_logarithm(spark):
    from warehaul.operators import workflows

    n = 100
    kind = lambda i: "fork" if 0 < i < n else "action"
    chain = [("w", str(i), str(i + 1), "ok", kind(i), kind(i + 1)) for i in range(n)]
    edges = spark.createDataFrame(chain, "w string, src string, dst string, kind string, src_kind string, dst_kind string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = [tuple(r) for r in workflows.contract_edges(edges, ["w"]).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before)
    assert got == [("w", str(n), "0", "ok")] and jobs < n


def test_cycles_of_pass_through_nodes_end(spark):
    from warehaul.operators import workflows

    rows = [("w", "a", "f", "ok", "action", "fork"), ("w", "f", "g", "ok", "fork", "fork"), ("w", "g", "f", "ok", "fork", "fork"),
            ("w", "g", "b", "ok", "fork", "action")]
    edges = spark.createDataFrame(rows, "w string, src string, dst string, kind string, src_kind string, dst_kind string")
    assert [tuple(r) for r in workflows.contract_edges(edges, ["w"]).collect()] == [("w", "b", "a", "ok")]
