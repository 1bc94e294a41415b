"""Storage listings, workflows, reports and schedules on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from warehaul.functions import scalar
from warehaul.operators import reports, schedules, storage, workflows

LISTING = """Found 12 items
drwxr-xr-x   - hadoop supergroup          0 2024-01-15 10:23 /user/retail_db
drwxr-xr-x   - hadoop supergroup          0 2024-01-15 10:23 /user/retail_db/customers
-rw-r--r--   3 hadoop supergroup    4194304 2024-01-15 10:23 /user/retail_db/customers/customers_20240115.parquet
drwxr-xr-x   - hadoop supergroup          0 2024-01-15 10:24 /user/retail_db/transactions
-rw-r--r--   3 hadoop supergroup   16777216 2024-01-15 10:24 /user/retail_db/transactions/txns_20240115.parquet
-rw-r--r--   3 hadoop supergroup    2097152 2024-01-14 09:10 /user/retail_db/transactions/txns_20240114.parquet
drwxr-xr-x   - hadoop supergroup          0 2024-01-10 08:00 /user/raw_data
-rw-r--r--   3 hadoop supergroup     524288 2024-01-10 08:00 /user/raw_data/extra_cust.csv
drwxr-xr-x   - hadoop supergroup          0 2024-01-12 14:30 /warehouse
drwxr-xr-x   - hadoop supergroup          0 2024-01-12 14:30 /warehouse/hive/retail_db.db
-rw-r--r--   3 hadoop supergroup    8388608 2024-01-12 14:30 /warehouse/hive/retail_db.db/customers/000000_0
drwxr-xr-x   - hadoop supergroup          0 2024-01-12 14:30 /warehouse/hive/retail_db.db/transactions"""


@pytest.fixture(scope="module")
def entries(spark):
    return storage.parse_listing(spark.createDataFrame([(line,) for line in LISTING.splitlines()], "value string")).cache()


def test_listing(entries):
    assert entries.count() == 12
    assert entries.filter("entry_type = 'file'").count() == 5
    assert entries.filter("entry_type = 'dir'").count() == 7
    assert entries.filter("path LIKE '%.parquet'").count() == 3
    row = entries.filter("path LIKE '%0114.parquet'").first()
    assert (row["replication"], row["owner"], row["size"], row["modified"]) == (3, "hadoop", 2097152, dt.datetime(2024, 1, 14, 9, 10))


def test_manifest_volumes_and_usage(entries):
    manifest = storage.copy_manifest(entries)
    assert manifest.count() == 5
    assert ("hdfs://namenode:8020/user/raw_data/extra_cust.csv", "dbfs:/user/raw_data/extra_cust.csv") in rows(manifest, "source", "target")
    plan = {r["directory"]: r["volume"] for r in storage.volume_plan(entries).collect()}
    assert plan["/warehouse/hive/retail_db.db"] == "main.migrations.warehouse_hive_retail_db.db" and "" not in plan
    assert set(plan) == {"/user", "/user/retail_db", "/user/retail_db/customers", "/user/retail_db/transactions", "/user/raw_data",
                         "/warehouse/hive", "/warehouse/hive/retail_db.db", "/warehouse/hive/retail_db.db/customers"}
    usage = {r["directory"]: (r["files"], r["bytes"]) for r in storage.usage_by_dir(entries, 2).collect()}
    assert usage["/"] == (5, 31981568) and usage["/user/retail_db"] == (3, 23068672) and "/user/retail_db/customers" not in usage


def test_locations(spark):
    df = spark.createDataFrame([("location 'hdfs://h:1/a/b' LOCATION '/mnt/x' LOCATION 's3://b/c'",)], "s string")
    assert storage.rewrite_locations(df, "s").first()[0] == "LOCATION 'dbfs:/a/b' LOCATION '/mnt/x' LOCATION 's3://b/c'"
    assert "abfss://c@a.dfs.core.windows.net/a/b'" in storage.rewrite_locations(df, "s", "abfss", "c", "a").first()[0]


def test_name_functions(spark):
    def value(col):
        return spark.range(1).select(col).first()[0]

    assert value(scalar.app_name(F.lit("hdfs://nn:8020/apps/wf-sales/"))) == "wf-sales"
    assert value(scalar.app_name(F.concat(F.lit("$"), F.lit("{nameNode}/apps/wf")))) == "wf"
    assert value(scalar.file_stem(F.lit("a\\b/c.d.xml"))) == "c.d"
    assert value(scalar.normal_name(F.lit("WF--a_-b"))) == "wf_a_b"
    assert value(scalar.task_key(F.lit("a-b.c d"))) == "a_b_c_d"
    assert value(scalar.epoch_millis(F.lit("2024-01-01T00:00Z"))) == 1704067200000
    assert value(scalar.epoch_millis(F.lit("2024-01-01T05:30+05:30"))) == 1704067200000
    assert value(scalar.epoch_millis(F.lit("yesterday"))) is None
    assert value(scalar.key_values(F.array(F.lit(" a = 1=2 "), F.lit("flag"), F.lit("b="), F.lit("a=3")))) == {"a": "3", "b": ""}
    assert value(scalar.overlay(F.create_map(F.lit("e"), F.lit("prod"), F.lit("x"), F.lit("1")), F.lit(None).cast("map<string,string>"),
                                F.create_map(F.lit("e"), F.lit("dev")))) == {"e": "dev", "x": "1"}
    assert value(scalar.currency(F.lit(1234.5))) == "$1,234.50"


def action(name, ok="end", error="fail", body="<shell><exec>x</exec></shell>", attrs="", more=""):
    return f'<action name="{name}" {attrs}>{body}{more}<ok to="{ok}"/><error to="{error}"/></action>'


def graph(spark, *bodies):
    docs = [
        (f"f{i}", f'<?xml version="1.0"?><workflow-app xmlns="uri:oozie:workflow:0.5" name="w{i}">{b}<kill name="fail"/><end name="end"/></workflow-app>')
        for i, b in enumerate(bodies)
    ]
    return workflows.workflow_tables(spark.createDataFrame([*docs, ("bad", "<workflow-app")], "stem string, text string"))


FORK_JOIN = (
    action("task0", "f") + '<fork name="f"><path start="task1"/><path start="task2"/></fork>' + action("task1", "j")
    + action("task2", "j") + '<join name="j" to="task3"/>' + action("task3")
)
DECISION = (
    '<decision name="d"><switch><case to="a">one</case><case to="b">two</case><default to="end"/></switch></decision>' + action("a") + action("b")
)
ERROR = action("t1", "end", "t2") + action("t2") + action("t3", "t4", "t4") + action("t4")
CYCLE = action("x", "j") + '<join name="j" to="f"/><fork name="f"><path start="j"/><path start="y"/></fork>' + action("y")
ERROR_TO_FORK = action("p", "end", "f") + '<fork name="f"><path start="q"/></fork>' + action("q")


def test_predecessors_and_run_conditions(spark):
    nodes, edges = graph(spark, FORK_JOIN, DECISION, ERROR, CYCLE, ERROR_TO_FORK)
    preds = workflows.contract_edges(edges, ["workflow"])
    assert rows(preds, "workflow", "node", "pred", "kind") == [
        ("w0", "task1", "task0", "ok"), ("w0", "task2", "task0", "ok"), ("w0", "task3", "task1", "ok"), ("w0", "task3", "task2", "ok"),
        ("w1", "a", "d", "ok"), ("w1", "b", "d", "ok"),
        ("w2", "t2", "t1", "error"), ("w2", "t4", "t3", "error"), ("w2", "t4", "t3", "ok"),
        ("w3", "y", "x", "ok"),
    ]
    plain = workflows.contract_edges(edges.drop("src_kind", "dst_kind"), ["workflow"], nodes)
    assert rows(plain) == rows(preds)
    runs = {(r["workflow"], r["node"]): r["run_if"] for r in workflows.run_conditions(preds, nodes, ["workflow"]).collect()}
    assert runs[("w2", "t2")] == "AT_LEAST_ONE_FAILED" and runs[("w2", "t4")] == "ALL_DONE"
    assert runs[("w0", "task0")] == "ALL_SUCCESS" and ("w1", "d") in runs


def test_retries_kinds_and_parameters(spark):
    config = "<configuration><property><name>env</name><value>{}</value></property></configuration>"
    nodes, _ = graph(
        spark,
        f"<global>{config.format('prod')}</global>"
        + action("a", attrs='retry-max="2" retry-interval="5"', more="<retry-max>3</retry-max><retry-interval>10</retry-interval>")
        + action("b", attrs='retry-max="4"', body=f"<hive><script>s.hql</script><param>k=v=w</param><param>no</param>{config.format('dev')}</hive>")
        + action("c", body="<mystery/>")
        + action("d", body="<sub-workflow><app-path>/p</app-path></sub-workflow>"),
    )
    got = {r["node"]: r for r in nodes.filter("kind = 'action'").collect()}
    assert set(got) == {"a", "b", "d"} and got["d"]["action_type"] == "sub-workflow"
    assert (got["a"]["retry_max"], got["a"]["retry_interval_ms"]) == (3, 600_000)
    assert (got["b"]["retry_max"], got["b"]["retry_interval_ms"]) == (4, 60_000)
    params = {r["node"]: r["parameters"] for r in workflows.effective_config(nodes).collect()}
    assert params["b"] == {"script_path": "s.hql", "env": "dev", "k": "v=w"} and params["a"] == {"env": "prod"}


COORDINATOR = (
    '<coordinator-app name="{0}" frequency="${{coord:hours(1)}}" start="2024-01-01T00:00Z" end="2024-01-02T00:00Z" timezone="UTC" '
    'xmlns="uri:oozie:coordinator:0.4"><!-- c --><action><workflow><app-path>{1}</app-path></workflow></action></coordinator-app>'
)


def test_schedules_link_to_workflows(spark):
    xml = [(COORDINATOR.format("multi", "/apps/wf-sales"),), (COORDINATOR.format("daily", "/workflows/daily_flow"),)]
    table = workflows.coordinator_table(spark.createDataFrame([(f"f{i}", *x) for i, x in enumerate(xml)], "stem string, text string"))
    assert table.filter("schedule = 'multi'").first()["frequency"] == "${coord:hours(1)}"
    names = spark.createDataFrame([("wf_inventory", "b.xml", 1), ("wf_sales", "a.xml", 2)], "name string, path string, pos int")
    links = workflows.link_schedules(table, names)
    got = {r["schedule"]: (r["workflow"], r["target"], r["task_key"], r["warning"] is None) for r in links.collect()}
    assert got["multi"] == ("wf_sales", "{{job_id:wf_sales}}", "run_wf_sales", True)
    assert got["daily"] == (None, "/workflows/daily_flow", "run_daily_flow", False)
    ids = spark.createDataFrame([("wf_sales", 77)], "name string, job_id int")
    assert ("multi", "77") in rows(workflows.link_schedules(table, names, ids), "schedule", "target")
    assert tuple(workflows.fleet_summary(names, links).first()) == (2, 2, 1, 1, 1)


def test_slots_of_all_units(spark):
    data = [
        ("hourly", "${coord:hours(1)}", "2024-01-01T00:00Z", "2024-01-02T00:00Z", "UTC"),
        ("daily", "${coord:days(1)}", "2024-01-01T00:00Z", "2024-01-10T00:00Z", "UTC"),
        ("kolkata", "${coord:hours(2)}", "2024-01-01T00:00Z", "2024-01-02T00:00Z", "Asia/Kolkata"),
        ("minutes", "45", "2024-01-01T00:00Z", "2024-01-01T03:00Z", "UTC"),
        ("monthly", "${coord:months(1)}", "2024-01-31T00:00Z", "2024-06-01T00:00Z", "UTC"),
        ("summer", "${coord:days(1)}", "2024-03-30T11:00Z", "2024-04-02T00:00Z", "Europe/Berlin"),
        ("bad", "whenever", "2024-01-01T00:00Z", "2024-01-02T00:00Z", "UTC"),
    ]
    df = spark.createDataFrame(data, "schedule string, frequency string, start string, end string, timezone string")
    for chunk in (50_000, 2):
        slots = schedules.schedule_slots(df, chunk)
        n = {r["schedule"]: r["count"] for r in slots.groupBy("schedule").count().collect()}
        assert n == {"hourly": 24, "daily": 9, "kolkata": 12, "minutes": 4, "monthly": 5, "summer": 3}
        shown = {s: [str(r["slot"]) for r in slots.filter(F.col("schedule") == s).orderBy("slot").collect()] for s in ("monthly", "summer")}
        assert shown["monthly"][1] == "2024-02-29 00:00:00" and shown["monthly"][2] == "2024-03-31 00:00:00"
        assert shown["summer"] == ["2024-03-30 11:00:00", "2024-03-31 10:00:00", "2024-04-01 10:00:00"]
    runs = slots.filter("schedule = 'daily' AND slot_no <> 4").select("schedule", "slot")
    assert rows(schedules.missing_slots(slots.filter("schedule = 'daily'"), runs), "slot_no") == [(4,)]


NS = 'xmlns="http://schemas.microsoft.com/sqlserver/reporting/2010/01/reportdefinition"'


def test_reports(spark):
    def dataset(name, command, text):
        return f'<DataSet Name="{name}"><Query>{command}<CommandText>{text}</CommandText><QueryParameters><QueryParameter Name="@P"/></QueryParameters></Query></DataSet>'

    nested = (
        "<Body>" + "<ReportItems><Rectangle>" * 6
        + '<ReportItems><Tablix Name="t"><DataSetName>a</DataSetName><TablixBody><TablixRows><TablixRow><TablixCells>'
        '<TablixCell><CellContents><Textbox Name="x"/></CellContents></TablixCell></TablixCells></TablixRow></TablixRows></TablixBody></Tablix>'
        '<List><Chart Name="c"/></List></ReportItems>' + "</Rectangle></ReportItems>" * 6 + "</Body>"
    )
    docs = [
        ("s1", f"<Report {NS}><Name>R1</Name><DataSets>{dataset('a', '<CommandType>Text</CommandType>', 'SELECT GetDate(), dateadd(d, 1, x)')}</DataSets>{nested}</Report>"),
        ("s2", f"<Report {NS}><Code> code </Code><DataSets>{dataset('b', '<CommandType>StoredProcedure</CommandType>', 'dbo.p')}</DataSets></Report>"),
        ("s3", f"<Report {NS}><Code>c</Code><DataSets>{dataset('c', '', 'SELECT 1')}</DataSets></Report>"),
        ("s4", f"<Report {NS}/>"),
        ("s5", "<Report><broken"),
        ("s6", f"<SharedDataSet>{dataset('shared', '', 'SELECT 2')}</SharedDataSet>"),
    ]
    tables = reports.report_tables(spark.createDataFrame(docs, "stem string, text string"))
    assert rows(reports.report_status(tables), "report", "convertible") == [("R1", True), ("s2", False), ("s3", True), ("s4", False), ("s5", False), ("s6", True)]
    assert rows(tables.items.drop("file")) == [("R1", "Chart", "c", ""), ("R1", "Tablix", "t", "a"), ("R1", "Textbox", "x", "")]
    warned = rows(reports.report_warnings(tables), "report", "warning")
    assert sum(r == "R1" for r, _ in warned) == 2
    assert ("s2", "Dataset 'b' uses a stored procedure ('dbo.p') — manual migration required") in warned
    assert ("s4", "No datasets found — nothing to convert") in warned and ("s5", "XML parse error") in warned
    assert not any(r == "s5" and "No datasets" in w for r, w in warned)
    assert tuple(reports.fleet_summary(tables).first()) == (6, 3, 3, 4)
    assert rows(tables.code_blocks.drop("file")) == [("s2", "code"), ("s3", "c")]


def test_stream_rewrites_touched_days(spark, tmp_path):
    from warehaul.sources import tables as src
    from warehaul.streaming.daily_summary import read_stream, stream_daily_summary

    landing, schema = str(tmp_path / "in"), "id int, ts timestamp, v int"
    src.create_table(spark, "stream_days", "n BIGINT, v BIGINT, day DATE", "parquet", ["day"], str(tmp_path / "out"))

    def arrive(*data):
        spark.createDataFrame([(i, dt.datetime.fromisoformat(t), v) for i, t, v in data], schema).coalesce(1).write.mode("append").parquet(landing)

    def drain():
        stream_daily_summary(
            read_stream(spark, landing, spark.createDataFrame([], schema).schema, 1),
            lambda: spark.read.schema(schema).parquet(landing),
            lambda df: df.groupBy("day").agg(F.count("*").alias("n"), F.sum("v").alias("v")),
            "stream_days", str(tmp_path / "ck"),
        )
        spark.catalog.refreshTable("stream_days")
        return [(str(r["day"]), r["n"], r["v"]) for r in spark.table("stream_days").orderBy("day").collect()]

    arrive((1, "2024-01-01 10:00:00", 1), (2, "2024-01-02 10:00:00", 2))
    assert drain() == [("2024-01-01", 1, 1), ("2024-01-02", 1, 2)]
    arrive((3, "2024-01-01 23:00:00", 10))  # late
    arrive((4, "2024-01-03 00:00:00", 4))
    assert drain() == [("2024-01-01", 2, 11), ("2024-01-02", 1, 2), ("2024-01-03", 1, 4)]
    assert drain() == [("2024-01-01", 2, 11), ("2024-01-02", 1, 2), ("2024-01-03", 1, 4)]


def test_stream_totals_read_each_row_once_and_bear_repeats(spark, tmp_path):
    from warehaul.sources import tables as src
    from warehaul.streaming.daily_summary import daily_totals, read_stream, stream_daily_totals

    arrive, schema = str(tmp_path / "in"), "ts timestamp, kind string, v double"
    src.create_table(spark, "day_totals", "day DATE, kind STRING, n BIGINT, total DOUBLE, batch BIGINT", "parquet", ["batch"], str(tmp_path / "out"))
    totals = {"n": F.count("*"), "total": F.sum("v")}

    def arrived(data):
        df = spark.createDataFrame(data, "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
        df.write.mode("append").parquet(arrive)

    def drain(checkpoint):
        stream_daily_totals(read_stream(spark, arrive, schema), "day_totals", str(tmp_path / checkpoint), ["kind"], totals)
        return rows(daily_totals(spark.table("day_totals"), ["kind"], list(totals)), "kind", "n", "total")

    arrived([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-02 10:00:00", "a", 2.0)])
    assert drain("c") == [("a", 1, 1.0), ("a", 1, 2.0)]
    arrived([("2024-01-01 09:00:00", "a", 5.0), ("2024-01-01 09:00:00", "b", 7.0)])  # late
    assert drain("c") == [("a", 1, 2.0), ("a", 2, 6.0), ("b", 1, 7.0)]
    assert spark.table("day_totals").select("batch").distinct().count() == 2
    # a batch that runs again replaces its own partition
    src.overwrite_dynamic("day_totals", spark.createDataFrame([("2024-01-01", "a", 2, 6.0, 1)], "day string, kind string, n bigint, total double, batch bigint").withColumn("day", F.to_date("day")))
    assert spark.table("day_totals").filter("batch = 1").count() == 1 and spark.table("day_totals").filter("batch = 0").count() == 2


def test_prefixed_and_unreadable_files(spark):
    from warehaul.sources import corpora

    xml = '<w:workflow-app xmlns:w="u"><w:action name="a"><w:shell><w:exec> x.sh </w:exec></w:shell><w:ok to="b"/><w:error to="k"/></w:action><w:kill name="k"><w:message>no</w:message></w:kill></w:workflow-app>'
    files = spark.createDataFrame([("f", xml), ("g", "<workflow-app"), ("h", None)], "stem string, text string")
    nodes, edges = workflows.workflow_tables(files)
    got = {r["node"]: r for r in nodes.collect()}
    assert got["a"]["settings"] == {"exec": "x.sh"} and got["k"]["message"] == "no" and got["a"]["workflow"] == "f"
    assert edges.count() == 2
    assert rows(corpora.unreadable_files(files, "text", workflows.WORKFLOW_SCHEMA)) == [("g", "XML parse error"), ("h", "no text")]


def test_unnamed_schedules_and_repeated_right_sides(spark):
    xml = [(f"f{i}", f"<coordinator-app><action><workflow><app-path>/apps/wf-{x}</app-path></workflow></action></coordinator-app>") for i, x in enumerate("ab")]
    table = workflows.coordinator_table(spark.createDataFrame(xml, "stem string, text string"))
    names = spark.createDataFrame([("wf-a", "a.xml", 1), ("wf-b", "b.xml", 2)], "name string, path string, pos int")
    ids = spark.createDataFrame([("wf-a", 7), ("wf-a", 5)], "name string, job_id int")
    assert rows(workflows.link_schedules(table, names, ids), "file", "workflow", "target") == [("f0", "wf-a", "5"), ("f1", "wf-b", "{{job_id:wf-b}}")]
    bundles = spark.createDataFrame([("b", "e", "/p", "")], "bundle string, entry string, app_path string, kickoff_time string")
    twice = spark.createDataFrame([("/p", "s2"), ("/p", "s1")], "path string, schedule string")
    assert rows(workflows.expand_bundles(bundles, twice), "schedule") == [("s1",)]


def test_every_child_element_of_an_action_is_a_setting(spark):
    body = (
        "<o:command> a &lt; b </o:command><o:n>007</o:n><o:deep><o:x>1</o:x></o:deep><o:mixed>t<o:x>1</o:x></o:mixed><o:with at='1'>v</o:with>"
        "<o:more>x</o:more><o:more/><o:more at='2'> y </o:more><o:empty/><o:arg>1</o:arg><o:file>f10</o:file><o:file>f20</o:file>"
    )
    two = "<o:action name='b'><o:email><o:to>q</o:to></o:email></o:action><o:action name='c'><o:unknown><o:to>q</o:to></o:unknown></o:action>"
    xml = f"<o:workflow-app xmlns:o='u'><o:action name='a'><o:sqoop>{body}</o:sqoop></o:action>{two}</o:workflow-app>"
    one = "<workflow-app><action name='a'><fs/></action></workflow-app>"
    files = spark.createDataFrame([("f", xml), ("g", one), ("h", "<workflow-app>")], "stem string, text string")
    nodes, _ = workflows.workflow_tables(files)
    got = {(r.file, r.node): (r.settings, r.arguments) for r in nodes.collect()}
    want = {"command": "a < b", "n": "007", "mixed": "t", "with": "v", "more": "x,y", "files": "f10,f20"}
    assert got == {("f", "a"): (want, "1"), ("f", "b"): ({"to": "q"}, ""), ("g", "a"): ({}, "")}


def test_runs_belong_to_the_last_slot_before_them(spark):
    plan = spark.createDataFrame(
        [(f, "same", "360", "2024-01-01T00:00Z", "2024-01-02T00:00Z", z) for f, z in (("a", "UTC"), ("b", "+02:00"), ("c", "Mars/Olympus"), ("d", None))],
        "file string, schedule string, frequency string, start string, end string, timezone string",
    )
    assert {r.file: r.reason for r in schedules.rejected_schedules(plan).collect()} == {"c": "unknown time zone 'Mars/Olympus'", "d": "unknown time zone ''"}
    slots = schedules.schedule_slots(plan)
    assert slots.groupBy("file").count().count() == 2 and slots.count() == 8
    starts = ["2024-01-01 00:00:00", "2024-01-01 05:59:59", "2024-01-01 06:30:00", "2024-01-01 07:00:00", "2024-01-01 13:00:00.000001", "2024-01-01 18:59:59", None]
    runs = spark.createDataFrame([("a", "same", t) for t in starts], "file string, schedule string, t string")
    runs = runs.withColumn("started", F.col("t").cast("timestamp_ntz"))
    for piece in (60, 3600, 7 * 86_400):
        got = {(r.file, r.slot.hour): (r.started and r.started.isoformat(" "), r.late_seconds) for r in schedules.runs_by_slot(slots, runs, 3600, piece).collect()}
        want = {("a", 0): (starts[0], 0.0), ("a", 6): (starts[2], 1800.0), ("a", 12): (None, None), ("a", 18): (starts[5], 3599.0)}
        assert got == want | {("b", h): (None, None) for h in (0, 6, 12, 18)}
    exact = runs.select("file", "schedule", F.col("started").alias("slot"))
    assert rows(schedules.missing_slots(slots, exact), "file").count(("b",)) == 4 and schedules.missing_slots(slots, exact).count() == 7


def test_no_rules_and_null_ids(spark):
    from warehaul.operators import corpus, joins

    texts = spark.createDataFrame([(1, "SELECT 1")], "id int, text string")
    issues = corpus.audit(texts, "id", "text", [])
    assert issues.columns == corpus.audit(texts, "id", "text").columns and issues.count() == 0
    left = spark.createDataFrame([(None, "x"), (2, "y")], "id int, name string")
    right = spark.createDataFrame([("x", 10), ("y", 20)], "name string, v int")
    found = joins.match_cascade(left, right, "id", [(F.col("name"), F.col("name"))], ["v"], ["v"])
    assert rows(found, "id", "match_step", "v") == [(2, 1, 20), (None, 1, 10)]


def test_xml_is_parsed_once_and_only_as_asked_for(spark):
    def parses(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("from_xml("), plan.count("Union")

    body = action("a", body="<hive><script>s</script></hive>") + '<decision name="d"/>'
    files = spark.createDataFrame([("f", f"<workflow-app name='w'>{body}</workflow-app>"), ("g", None)], "stem string, text string")
    nodes, edges = workflows.workflow_tables(files)
    assert parses(edges) == (1, 0) and parses(nodes.select("kind")) == (1, 0)
    assert parses(nodes) == (3, 0)
    assert rows(nodes, "file", "node", "kind", "script") == [("f", "a", "action", "s"), ("f", "d", "decision", None)]
    assert parses(workflows.coordinator_table(files)) == (1, 0)


def test_one_file_is_spread_whatever_its_splits(spark, tmp_path):
    from warehaul.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
        assert one.rdd.getNumPartitions() >= cores
        tasks = spread(one, "id").groupBy(F.spark_partition_id()).count().count()
        assert tasks >= cores and rows(spread(one, "id")) == [(i,) for i in range(1000)]
        assert spread(many, "id") is many
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_schedules_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    data = [(f"f{i}", COORDINATOR.format(f"s{i}", f"/apps/wf-{i}")) for i in range(20)]
    schedules = workflows.coordinator_table(spark.createDataFrame(data, "stem string, text string")).withColumn("app_path", counted("app_path"))
    names = spark.createDataFrame([(f"wf-{i}", "x.xml", i) for i in range(10)], "name string, path string, pos int")
    links = workflows.link_schedules(schedules, names)
    assert links.filter("workflow IS NOT NULL").count() == 10 and seen.value == 20
