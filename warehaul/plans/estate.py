"""Queries: script, notebook, storage, workflow, report and schedule estates.

The estates are derived from the driver's tables by Spark, one script, listing line, workflow or
report per row, so that they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.operators import corpus, reports, schedules, storage, workflows
from warehaul.operators.windows import with_lead
from warehaul.plans.loading import fresh
from warehaul.plans.tables import table
from warehaul.registry import query
from warehaul.session import balanced, scratch_path, spread
from warehaul.sources import corpora
from warehaul.sources import tables as src
from warehaul.streaming.daily_summary import daily_totals, read_stream, stream_daily_summary, stream_daily_totals

# --- scripts: one per order ------------------------------------------------------------------

# The text of a script, in the SQL that Spark and DuckDB share. The dollar sign stands apart from
# the brace because Spark would substitute a variable there.
SCRIPT_TEXT = """
    CASE WHEN k % 5 = 0 THEN 'SET run_dt=' || d || ';' ELSE '-- load ' || k END || nl ||
    CASE WHEN k % 3 = 0 THEN 'SET hivevar:region=r' || (k % 7) || ';' ELSE 'SET hive.exec.parallel=true;' END || nl ||
    CASE WHEN k % 4 = 0 THEN 'add jar hdfs://libs/udf_' || k || '.jar;'
         WHEN k % 4 = 1 THEN 'CREATE TEMPORARY' || nl || 'FUNCTION f AS ''com.example.F'';'
         WHEN k % 4 = 2 THEN 'CREATE  TEMPORARY FUNCTION g AS ''com.example.G'';' ELSE 'SELECT 1;' END || nl ||
    'INSERT OVERWRITE TABLE sales_$' || '{region}' || nl ||
    'SELECT NVL(a, 0), from_unixtime(ts, ''yyyy''), from_unixtime(u), unix_timestamp() FROM t DISTRIBUTE BY a, b;' || nl ||
    'SELECT /*+ MAPJOIN(c) */ * FROM t JOIN c WHERE dt = ''$' || '{hivevar:run_dt}'';' || nl ||
    'ANALYZE TABLE t COMPUTE STATISTICS FOR COLUMNS;' || nl ||
    CASE WHEN k % 6 = 0 THEN 'CREATE EXTERNAL TABLE e (id INT) LOCATION ''hdfs://nn:8020/warehouse/e_' || k || '/'';' ELSE '' END
"""
SCRIPT_CTE = f"""scripts AS (SELECT k, {SCRIPT_TEXT} AS text FROM (
    SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d,
        CASE WHEN o_orderkey % 9 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS nl FROM orders))"""


def scripts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return (
        spread(orders, "o_orderkey")
        .select(
            F.col("o_orderkey").alias("k"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
            F.expr("CASE WHEN o_orderkey % 9 = 0 THEN chr(13) || chr(10) ELSE chr(10) END").alias("nl"),
        )
        .select("k", F.expr(SCRIPT_TEXT).alias("text"))
    )


def _audit_sql(source: str, id_col: str, rules) -> str:
    values = ", ".join(
        f"({i}, '{r.category}', '{r.severity}', '{'(?i)' if r.ignore_case else ''}{r.pattern}')" for i, r in enumerate(rules)
    )
    return f"""rules(rule_no, category, severity, p) AS (VALUES {values}),
    texts AS (SELECT {id_col}, text, string_split_regex(text, '\\r\\n|\\n') AS parts FROM {source}),
    issues AS (SELECT {id_col}, rule_no, category, severity,
        list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], p)) AS lines
        FROM texts, rules WHERE regexp_matches(text, p))"""


@query(
    f"""WITH {SCRIPT_CTE}, {_audit_sql('scripts', 'k', corpus.SCRIPT_RULES)}
    SELECT k, rule_no, category, severity, array_to_string(lines, ',') AS lines, len(lines) AS count FROM issues"""
)
def audit_scripts(spark, sf):
    return corpus.audit(scripts(spark, sf), "k", "text").select(
        "k", "rule_no", "category", "severity", F.concat_ws(",", "lines").alias("lines"), "count"
    )


DOCUMENT_RULES = (
    corpus.Rule("SECRET", "BLOCKER", "token", r"token = \"[0-9a-f]{20,}\"", False),
    corpus.Rule("PII", "ERROR", "mail address", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", True),
    corpus.Rule("PII", "WARNING", "network address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", False),
    corpus.Rule("NOTICE", "INFO", "license line", r"licen[cs]e", True),
)


@query(
    f"""WITH {_audit_sql('documents', 'doc_id', DOCUMENT_RULES)}
    SELECT doc_id, rule_no, category, severity, array_to_string(lines, ',') AS lines, len(lines) AS count FROM issues"""
)
def audit_documents(spark, sf):
    """The rule audit over whole documents."""
    return corpus.audit(table(spark, sf, "documents"), "doc_id", "text", DOCUMENT_RULES).select(
        "doc_id", "rule_no", "category", "severity", F.concat_ws(",", "lines").alias("lines"), "count"
    )


@query(
    """WITH calls AS (SELECT o_orderkey, 'ship to ' || n_name || chr(10) || 'priority ' || o_orderpriority AS text
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT o_orderkey, CAST(n_nationkey AS BIGINT) AS rule_no, n_name AS message, '1' AS lines
    FROM calls JOIN nation ON regexp_matches(text, '(?i)to ' || n_name)"""
)
def audit_by_rule_table(spark, sf):
    """Rules kept in a table, one per nation, over a text per order."""
    nation = table(spark, sf, "nation")
    rules = nation.select(
        F.col("n_nationkey").alias("position"), F.lit("PLACE").alias("category"), F.lit("INFO").alias("severity"),
        F.col("n_name").alias("message"), F.concat(F.lit("to "), "n_name").alias("pattern"), F.lit(True).alias("ignore_case"),
    )
    # the nations are a fixed table of 25 rows
    people = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    calls = table(spark, sf, "orders").join(people.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.concat(F.lit("ship to "), "n_name", F.lit("\npriority "), "o_orderpriority").alias("text")
    )
    return corpus.audit(calls, "o_orderkey", "text", corpus.rules_from_table(rules)).select(
        "o_orderkey", F.col("rule_no").cast("bigint").alias("rule_no"), "message", F.concat_ws(",", "lines").alias("lines")
    )


@query(
    f"""WITH {SCRIPT_CTE}, {_audit_sql('scripts', 'k', corpus.DIALECT_RULES)}
    SELECT rule_no, count(*) AS n FROM issues GROUP BY rule_no"""
)
def dialect_hints(spark, sf):
    return (
        corpus.audit(scripts(spark, sf), "k", "text", corpus.DIALECT_RULES).groupBy("rule_no").agg(F.count("*").alias("n"))
    )


@query(
    f"""WITH {SCRIPT_CTE}, {_audit_sql('scripts', 'k', corpus.SCRIPT_RULES)}
    SELECT k, count(*) FILTER (WHERE severity = 'BLOCKER') AS blocker_count, CAST(0 AS BIGINT) AS error_count,
        count(*) FILTER (WHERE severity = 'WARNING') AS warning_count, CAST(0 AS BIGINT) AS info_count FROM issues GROUP BY k"""
)
def severity_by_script(spark, sf):
    return corpus.severity_matrix(corpus.audit(scripts(spark, sf), "k", "text"), "k")


@query(
    f"""WITH {SCRIPT_CTE}, {_audit_sql('scripts', 'k', corpus.SCRIPT_RULES)}
    SELECT DISTINCT k FROM issues WHERE severity IN ('ERROR', 'BLOCKER') ORDER BY k"""
)
def problem_scripts(spark, sf):
    return corpus.problem_rows(corpus.audit(scripts(spark, sf), "k", "text"), ["k"])


STATEMENT_TEXT = """CASE k % 8
    WHEN 0 THEN 'msck repair table t_' || k
    WHEN 1 THEN 'FROM s INSERT OVERWRITE TABLE a SELECT * WHERE x > ' || k || ' INSERT OVERWRITE TABLE b SELECT * WHERE x <= ' || k
    WHEN 2 THEN 'LOAD DATA INPATH ''/data/' || k || '.csv'' INTO TABLE t'
    WHEN 3 THEN 'CREATE EXTERNAL TABLE e_' || k || ' (id INT) LOCATION ''/mnt/e'''
    WHEN 4 THEN 'CREATE TABLE t_' || k || ' (id INT)'
    WHEN 5 THEN 'CREATE TABLE c_' || k || ' LOCATION ''/mnt/c'' AS SELECT * FROM s'
    WHEN 6 THEN 'INSERT OVERWRITE TABLE t PARTITION(dt=''' || k || ''') SELECT * FROM s'
    ELSE 'SELECT ' || k END"""


def statements(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("statement", F.expr(STATEMENT_TEXT))


@query(
    """SELECT o_orderkey AS k, category, severity FROM orders JOIN (VALUES (0, 'HIVE_COMMAND', 'INFO'),
        (1, 'MULTI_INSERT', 'BLOCKER'), (2, 'UNSUPPORTED', 'BLOCKER'), (3, 'DDL_UNSUPPORTED', 'INFO'),
        (4, 'DDL_REVIEW', 'INFO'), (5, 'CTAS_REVIEW', 'INFO')) v(m, category, severity) ON o_orderkey % 8 = m"""
)
def classify_statements(spark, sf):
    return corpus.classify(statements(spark, sf), "statement").select("k", "category", "severity")


def _replace_sql(column: str, rules) -> str:
    for pattern, replacement in rules:
        p = pattern.replace("'", "''")
        flags = "g" if pattern.startswith("(?d") else "gi"
        p = p.replace("(?idU)", "").replace("(?dU)", "")
        r = replacement.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
        column = f"regexp_replace({column}, '{p}', '{r}', '{flags}')"
    return column


@query(f"WITH {SCRIPT_CTE} SELECT k, {_replace_sql('text', corpus.STATEMENT_REWRITES)} AS text FROM scripts")
def rewrite_scripts(spark, sf):
    return corpus.rewrite(scripts(spark, sf), "text")


DDL_TEXT = """'CREATE TABLE t_' || k || ' (id INT)' || chr(10) || CASE k % 7
    WHEN 0 THEN 'ROW FORMAT DELIMITED' || chr(10) || 'FIELDS TERMINATED BY '',''' || chr(10) || 'STORED AS TEXTFILE'
    WHEN 1 THEN 'ROW FORMAT SERDE ''org.x.S'' WITH SERDEPROPERTIES (''a''=''b'')'
    WHEN 2 THEN 'STORED AS ORC TBLPROPERTIES (''k''=''' || k || ''')'
    WHEN 3 THEN 'clustered by (id) into ' || (k % 9) || ' buckets'
    WHEN 4 THEN 'CLUSTERED BY (id) SORTED BY (id ASC) INTO 4 BUCKETS SKEWED BY (id) ON (1)'
    WHEN 5 THEN 'STORED AS INPUTFORMAT ''a.b.In'' OUTPUTFORMAT ''a.b.Out'''
    ELSE 'COMMENT ''kept'' LOCATION ''/mnt/t''' END"""


def _stripped_sql(column: str) -> str:
    """As ``_replace_sql``, with a dot that also stands for a line break; DuckDB puts back what Spark looks ahead to."""
    rules = [(p.replace("(?s)", "").replace("(?=", "("), "$1" if "(?=" in p else r) for p, r in corpus.CLAUSE_REWRITES]
    return _replace_sql(column, rules).replace("'gi')", "'gis')")


@query(f"SELECT k, {_stripped_sql('text')} AS text FROM (SELECT k, {DDL_TEXT} AS text FROM (SELECT o_orderkey AS k FROM orders))")
def strip_clauses(spark, sf):
    """Storage clauses taken out of table definitions."""
    tables = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("text", F.expr(DDL_TEXT))
    return corpus.rewrite(tables, "text", corpus.CLAUSE_REWRITES)


@query(f"WITH {SCRIPT_CTE} SELECT k, {_replace_sql('text', corpus.SCRIPT_STRIPS)} AS text FROM scripts")
def strip_statements(spark, sf):
    """Library and temporary function statements taken out of scripts."""
    return corpus.rewrite(scripts(spark, sf), "text", corpus.SCRIPT_STRIPS)


CELL_TEXT = """text || chr(10) || CASE (conv_id + turn) % 4
    WHEN 0 THEN 'df = sc.textFile("hdfs:///conv/' || conv_id || '")' || chr(10) || 'rows = df.collect()'
    WHEN 1 THEN 'conf = SparkConf()' || chr(10) || 'sc = SparkContext(conf)'
    WHEN 2 THEN 'df = spark.read.parquet("hdfs://nn:8020/d/' || turn || '").repartition(' || (conv_id % 3) * 50 || ')'
    ELSE 'df.foreachPartition(f)' || chr(10) || 'rows = df.collect( )' END"""


def cells(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "code").otherwise("markdown").alias("kind"),
        F.expr(CELL_TEXT).alias("text"),
    )


_CELL_CTE = f"""cells AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'code' ELSE 'markdown' END AS kind,
    {CELL_TEXT} AS text FROM conversations),
    done AS (SELECT conv_id, turn, kind, CASE WHEN kind = 'code' THEN {_replace_sql('text', corpus.PATH_REWRITES)} ELSE text END AS text FROM cells),
    rules(no, p) AS (VALUES {', '.join(f"({i}, '{p.replace('(?dU)', '')}')" for i, (p, _) in enumerate(corpus.CODE_WARNINGS))})"""


@query(
    f"""WITH {_CELL_CTE}, names(no, message) AS (VALUES {', '.join(f"({i}, '{m}')" for i, (_, m) in enumerate(corpus.CODE_WARNINGS))}),
    named AS (SELECT p, no, message FROM rules JOIN names USING (no))
    SELECT conv_id, turn, any_value(text) AS text, coalesce(string_agg(message, '|' ORDER BY no), '') AS warnings
    FROM done LEFT JOIN named ON regexp_matches(text, p) WHERE kind = 'code' GROUP BY conv_id, turn"""
)
def migrate_code_texts(spark, sf):
    code = cells(spark, sf).filter("kind = 'code'").drop("kind")
    return corpus.migrate_texts(code, "text").withColumn("warnings", F.concat_ws("|", "warnings"))


@query(f"WITH {_CELL_CTE} SELECT conv_id, turn, kind, text FROM done")
def migrate_notebook_cells(spark, sf):
    return corpus.migrate_cells(cells(spark, sf), "conv_id", "turn", "kind", "text")[0]


@query(
    f"""WITH {_CELL_CTE}, first AS (SELECT conv_id, no, min(turn) AS turn FROM done, rules
        WHERE kind = 'code' AND regexp_matches(text, p) GROUP BY conv_id, no),
    names(no, message) AS (VALUES {', '.join(f"({i}, '{m}')" for i, (_, m) in enumerate(corpus.CODE_WARNINGS))})
    SELECT conv_id, string_agg(message, '|' ORDER BY turn, no) AS warnings FROM first JOIN names USING (no) GROUP BY conv_id"""
)
def notebook_warnings(spark, sf):
    warnings = corpus.migrate_cells(cells(spark, sf), "conv_id", "turn", "kind", "text")[1]
    return warnings.withColumn("warnings", F.concat_ws("|", "warnings"))


@query(
    """SELECT doc_id, 0 AS pos, 'code' AS kind, replace(text, chr(10), '') AS text FROM documents
    UNION ALL SELECT doc_id, 1, 'markdown', '["' || lang || '"]' FROM documents"""
)
def notebook_json_cells(spark, sf):
    """Notebook JSON with one cell whose source is a list and one whose source is a text."""
    notebook = F.concat(
        F.lit('{"metadata":{},"cells":[{"cell_type":"code","source":'),
        F.to_json(F.split("text", "\n")),
        F.lit('},{"cell_type":"markdown","source":"[\\"'),
        "lang",
        F.lit('\\"]"}]}'),
    )
    docs = table(spark, sf, "documents").select("doc_id", notebook.alias("json"))
    return corpora.read_cells(docs, "doc_id", "json")


@query(
    """SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS position, 'region' AS name,
        CASE WHEN o_orderkey % 3 = 0 THEN '''r' || (o_orderkey % 7) || '''' ELSE '''UNKNOWN''' END AS value FROM orders
    UNION ALL SELECT o_orderkey, 1, 'run_dt',
        CASE WHEN o_orderkey % 5 = 0 THEN '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' ELSE '''UNKNOWN''' END FROM orders"""
)
def script_variables(spark, sf):
    return corpus.extract_placeholders(scripts(spark, sf), "k", "text")


@query(
    """SELECT k, CASE WHEN skip_reason IS NULL AND proposed IS NOT NULL THEN proposed ELSE old END AS text, skip_reason,
        skip_reason IS NULL AND proposed IS NOT NULL AS replaced FROM (SELECT *,
            CASE WHEN length(proposed) < 10 THEN 'output too short'
                WHEN contains(old, 'INSERT') AND NOT contains(proposed, 'INSERT') THEN 'INSERT guard failed'
                WHEN contains(old, 'PARTITION') AND NOT contains(proposed, 'PARTITION') THEN 'PARTITION guard failed' END AS skip_reason
        FROM (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'INSERT OVERWRITE TABLE t PARTITION(dt) SELECT ' || o_orderkey
                WHEN '2-HIGH' THEN 'INSERT INTO t SELECT ' || o_orderkey ELSE 'SELECT * FROM old_' || o_orderkey END AS old,
            CASE WHEN o_totalprice < 50000 THEN NULL WHEN o_totalprice < 100000 THEN 'SELECT 1' WHEN o_orderstatus = 'F' THEN 'SELECT * FROM new_' || o_orderkey
                WHEN o_orderstatus = 'O' THEN 'INSERT INTO n SELECT ' || o_orderkey ELSE 'INSERT INTO n PARTITION (dt) SELECT ' || o_orderkey END AS proposed
        FROM orders))
    UNION ALL SELECT -c_custkey - 1, NULL, 'unknown id', false FROM customer"""
)
def guarded_replacements(spark, sf):
    """Proposals for all but the cheapest orders' statements, and for customers, which are unknown ids."""
    key, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    orders = table(spark, sf, "orders")

    def line(text: str):
        return F.concat(F.lit(text), key)

    priority = F.col("o_orderpriority")
    original = orders.select(
        key.alias("k"),
        F.when(priority == "1-URGENT", line("INSERT OVERWRITE TABLE t PARTITION(dt) SELECT "))
        .when(priority == "2-HIGH", line("INSERT INTO t SELECT "))
        .otherwise(line("SELECT * FROM old_"))
        .alias("text"),
    )
    proposed = orders.filter(price >= 50000).select(
        key.alias("k"),
        F.when(price < 100000, "SELECT 1")
        .when(status == "F", line("SELECT * FROM new_"))
        .when(status == "O", line("INSERT INTO n SELECT "))
        .otherwise(line("INSERT INTO n PARTITION (dt) SELECT "))
        .alias("text"),
    )
    unknown = table(spark, sf, "customer").select((-F.col("c_custkey") - 1).alias("k"), F.lit("SELECT 'no such id'").alias("text"))
    return corpus.apply_replacements(original, proposed.unionByName(unknown), ["k"]).select("k", "text", "skip_reason", "replaced")


@query(
    """SELECT 'functions' AS metric, CAST(count(DISTINCT event_type || user_id) AS DOUBLE) AS value FROM events
    UNION ALL SELECT 'transformations', CAST(sum(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS DOUBLE) FROM events
    UNION ALL SELECT 'objects', CAST(count(DISTINCT source) AS DOUBLE) FROM documents"""
)
def estate_usage_metrics(spark, sf):
    calls = table(spark, sf, "events").select(
        F.concat("event_type", "user_id").alias("fn"), F.regexp_extract("props", "([0-9]+)", 1).alias("steps")
    )
    return corpus.usage_metrics(
        calls, table(spark, sf, "documents"), {"function": "fn", "transformations": "steps", "object": "source"}
    )


# --- files -----------------------------------------------------------------------------------


@query("SELECT count(*) AS lines, sum(length(p_name)) AS chars FROM part")
def script_files(spark, sf):
    """Part names written as many small script files below one directory, read one row per file."""
    path = scratch_path(spark, "scripts")
    part = table(spark, sf, "part").select("p_brand", F.col("p_name").alias("value"))
    balanced(part, "p_brand").write.partitionBy("p_brand").option("maxRecordsPerFile", 1000).text(path)
    files = corpora.read_scripts(spark, path, (".txt",))
    return files.select(F.size(F.split("text", "\n")).alias("n"), F.length("text").alias("c")).agg(
        F.sum(F.col("n") - 1).alias("lines"), F.sum(F.col("c") - F.col("n") + 1).alias("chars")
    )


@query("SELECT sum(length(c_name) + 1) AS bytes, true AS some_files FROM customer")
def stored_bytes(spark, sf):
    """Bytes and files; how many files there are depends on the partitions, so only that there are some is shown."""
    path = scratch_path(spark, "inventory")
    table(spark, sf, "customer").select("c_name").write.text(path)
    return storage.file_inventory(spark, path).select(F.col("bytes").cast("bigint").alias("bytes"), (F.col("files") > 0).alias("some_files"))


# --- storage listings: one line per document ---------------------------------------------------


def listing(spark, sf):
    """A recursive listing as text files: documents, their directories, and count lines."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    files = docs.select(
        F.format_string(
            "-rw-r--r--   3 etl corpus %10d 2024-01-15 10:23 /corpus/%s/%s/doc_%d.txt", "n_chars", "lang", "source", "doc_id"
        ).alias("value")
    )
    dirs = docs.select("lang", "source").distinct().select(
        F.format_string("drwxr-xr-x   - etl corpus          0 2024-01-15 10:23 /corpus/%s/%s", "lang", "source").alias("value")
    )
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).select(F.format_string("Found %d items", "n").alias("value"))
    path = scratch_path(spark, "listing")
    files.unionByName(dirs).unionByName(counts).write.text(path)
    return storage.read_listing(spark, path)


_FILES = "SELECT '/corpus/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, n_chars, lang, source FROM documents"


@query(
    f"""SELECT 'file' AS entry_type, path, 3 AS replication, 'etl' AS owner, 'corpus' AS "group", n_chars AS size,
        TIMESTAMP '2024-01-15 10:23:00' AS modified FROM ({_FILES})
    UNION ALL SELECT 'dir', '/corpus/' || lang || '/' || source, NULL, 'etl', 'corpus', 0, TIMESTAMP '2024-01-15 10:23:00'
        FROM documents GROUP BY lang, source"""
)
def listing_entries(spark, sf):
    return listing(spark, sf)


@query(f"SELECT 'hdfs://namenode:8020' || path || chr(9) || 'dbfs:' || path AS value FROM ({_FILES})")
def listing_copy_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    storage.write_manifest(storage.copy_manifest(listing(spark, sf)), path)
    return spark.read.text(path)


@query(
    """SELECT directory, 'main.migrations.' || replace(trim(directory, '/'), '/', '_') AS volume,
        'abfss://data@mystorageaccount.dfs.core.windows.net' || directory AS location FROM (
        SELECT DISTINCT '/corpus/' || lang || '/' || source AS directory FROM documents
        UNION SELECT DISTINCT '/corpus/' || lang FROM documents)"""
)
def listing_volume_plan(spark, sf):
    return storage.volume_plan(listing(spark, sf))


@query(
    """SELECT '/' AS directory, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents
    UNION ALL SELECT '/corpus', count(*), sum(n_chars)::BIGINT FROM documents
    UNION ALL SELECT '/corpus/' || lang, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY lang
    UNION ALL SELECT '/corpus/' || lang || '/' || source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY lang, source"""
)
def usage_by_directory(spark, sf):
    return storage.usage_by_dir(listing(spark, sf))


@query(
    f"""WITH {SCRIPT_CTE} SELECT k, regexp_replace(text, 'LOCATION\\s+''hdfs://[^/'']*([^'']*)''',
        'LOCATION ''dbfs:\\1''', 'gi') AS dbfs,
        regexp_replace(text, 'LOCATION\\s+''hdfs://[^/'']*([^'']*)''',
        'LOCATION ''abfss://raw@lake.dfs.core.windows.net\\1''', 'gi') AS abfss FROM scripts"""
)
def rewritten_locations(spark, sf):
    both = scripts(spark, sf).select("k", F.col("text").alias("dbfs"), F.col("text").alias("abfss"))
    return storage.rewrite_locations(both, "dbfs").transform(storage.rewrite_locations, "abfss", "abfss", "raw", "lake")


# --- workflows: one XML per customer -----------------------------------------------------------

_HEAD = "'<workflow-app xmlns=\"uri:oozie:workflow:0.5\" name=\"wf-' || k || '\">' ||"
_TAIL = "'<kill name=\"fail\"><message>failed</message></kill><end name=\"end\"/></workflow-app>'"


def _action(name: str, ok: str, error: str = "fail", body: str = "<shell><exec>run.sh</exec></shell>", more: str = "") -> str:
    return f'<action name="{name}">{body}{more}<ok to="{ok}"/><error to="{error}"/></action>'


def _prop(name: str, value: str) -> str:
    return f"<configuration><property><name>{name}</name><value>{value}</value></property></configuration>"


_TOPOLOGIES = (
    # two actions in a row, with settings on three levels
    f"<global>{_prop('env', 'prod')}</global><start to=\"a\"/>"
    + _action("a", "b", body=f"<hive><script>a.hql</script><param>region=r1</param><param>flag</param>{_prop('env', 'dev')}</hive>")
    + _action("b", "end"),
    # fork and join
    '<start to="t0"/>' + _action("t0", "f") + '<fork name="f"><path start="t1"/><path start="t2"/></fork>'
    + _action("t1", "j") + _action("t2", "j") + '<join name="j" to="t3"/>' + _action("t3", "end"),
    # decision
    '<start to="d"/><decision name="d"><switch><case to="h">one</case><case to="s">two</case><default to="end"/></switch></decision>'
    + _action("h", "end") + _action("s", "end"),
    # error route, an action of an unknown kind
    '<start to="t1"/>' + _action("t1", "end", "t2") + _action("t2", "x") + _action("x", "t3", body="<custom/>") + _action("t3", "end"),
    # fork in a fork, retries, one node reached on success and on error
    '<start to="t0"/>' + _action("t0", "f1", more="<retry-max>3</retry-max><retry-interval>10</retry-interval>")
    + '<fork name="f1"><path start="f2"/><path start="t1"/></fork><fork name="f2"><path start="t2"/><path start="t3"/></fork>'
    + _action("t1", "j", "t4") + _action("t2", "j") + _action("t3", "j") + '<join name="j" to="t4"/>' + _action("t4", "end"),
)
WORKFLOW_XML = f"""CASE WHEN k % 97 = 96 THEN '<workflow-app name="broken"' ELSE {_HEAD}
    CASE k % 5 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOPOLOGIES))} END || {_TAIL} END"""


def workflow_files(spark, sf):
    return (
        spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
        .select(F.concat(F.lit("flow_"), "k").alias("stem"), F.expr(WORKFLOW_XML).alias("text"))
    )


_WF = "SELECT 'wf-' || c_custkey AS workflow, c_custkey % 5 AS m FROM customer WHERE c_custkey % 97 <> 96"
_PREDS = """(VALUES (0, 'b', 'a', 'ok'), (1, 't1', 't0', 'ok'), (1, 't2', 't0', 'ok'), (1, 't3', 't1', 'ok'), (1, 't3', 't2', 'ok'),
    (2, 'h', 'd', 'ok'), (2, 's', 'd', 'ok'), (3, 't2', 't1', 'error'),
    (4, 't1', 't0', 'ok'), (4, 't2', 't0', 'ok'), (4, 't3', 't0', 'ok'), (4, 't4', 't1', 'ok'), (4, 't4', 't2', 'ok'),
    (4, 't4', 't3', 'ok'), (4, 't4', 't1', 'error')) v(m, node, pred, kind)"""
_NODES = """(VALUES (0, 'a', 1), (0, 'b', 1), (1, 't0', 1), (1, 't1', 1), (1, 't2', 1), (1, 't3', 1), (2, 'd', 0), (2, 'h', 1), (2, 's', 1),
    (3, 't1', 1), (3, 't2', 1), (3, 't3', 1), (4, 't0', 3), (4, 't1', 1), (4, 't2', 1), (4, 't3', 1), (4, 't4', 1)) n(m, node, retries)"""


@query(
    f"""SELECT kind, count(*) AS n, sum(CASE WHEN retries > 0 THEN retries END)::BIGINT AS retries FROM (
        SELECT CASE WHEN retries = 0 THEN 'decision' ELSE 'action' END AS kind, retries FROM ({_WF}) JOIN {_NODES} USING (m)
        UNION ALL SELECT 'kill', NULL FROM ({_WF})
        UNION ALL SELECT 'fork', NULL FROM ({_WF}) WHERE m IN (1, 4) UNION ALL SELECT 'fork', NULL FROM ({_WF}) WHERE m = 4
        UNION ALL SELECT 'join', NULL FROM ({_WF}) WHERE m IN (1, 4)) GROUP BY kind"""
)
def workflow_nodes(spark, sf):
    nodes, _ = workflows.workflow_tables(workflow_files(spark, sf))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("retry_max").alias("retries"))


@query(f"SELECT workflow, node, pred, kind FROM ({_WF}) JOIN {_PREDS} USING (m)")
def workflow_predecessors(spark, sf):
    _, edges = workflows.workflow_tables(workflow_files(spark, sf))
    return workflows.contract_edges(edges, ["file", "workflow"]).drop("file")


@query(
    f"""SELECT workflow, node, CASE WHEN ok AND error THEN 'ALL_DONE' WHEN error THEN 'AT_LEAST_ONE_FAILED' ELSE 'ALL_SUCCESS' END AS run_if,
        n_preds FROM (SELECT workflow, node, bool_or(kind = 'ok') AS ok, bool_or(kind = 'error') AS error, count(DISTINCT pred) AS n_preds
        FROM ({_WF}) JOIN {_NODES} USING (m) LEFT JOIN {_PREDS} USING (m, node) GROUP BY ALL)"""
)
def workflow_run_conditions(spark, sf):
    nodes, edges = workflows.workflow_tables(workflow_files(spark, sf))
    keys = ["file", "workflow"]
    return workflows.run_conditions(workflows.contract_edges(edges, keys), nodes, keys).drop("file")


@query(
    f"""SELECT workflow, node, CASE WHEN m = 0 AND node = 'a' THEN 'env=dev,region=r1,script_path=a.hql'
        WHEN m = 0 THEN 'env=prod' ELSE '' END AS parameters FROM ({_WF}) JOIN {_NODES} USING (m) WHERE retries > 0"""
)
def workflow_parameters(spark, sf):
    nodes, _ = workflows.workflow_tables(workflow_files(spark, sf))
    shown = F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return workflows.effective_config(nodes).select("workflow", "node", F.concat_ws(",", shown).alias("parameters"))


@query(
    """SELECT user_id, event_id AS node, pred FROM (
        SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events
        WHERE event_type <> 'view') WHERE pred IS NOT NULL"""
)
def event_predecessors(spark, sf):
    """Each event leads to the user's next one; views are walked through."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    step = F.struct("event_id", "event_type")
    chain = with_lead(events.withColumn("_e", step), ["user_id"], ["ts", "event_id"], "_e", "_next").filter("_next IS NOT NULL")
    kind = F.when(F.col("event_type") == "view", "through").otherwise("real")
    next_kind = F.when(F.col("_next.event_type") == "view", "through").otherwise("real")
    edges = chain.select(
        "user_id",
        F.col("event_id").alias("src"),
        F.col("_next.event_id").alias("dst"),
        F.lit("ok").alias("kind"),
        kind.alias("src_kind"),
        next_kind.alias("dst_kind"),
    )
    return workflows.contract_edges(edges, ["user_id"], real=("real",), through=("through",)).drop("kind")


def schedule_rows(spark, sf):
    app = """CASE k % 6 WHEN 0 THEN '/apps/wf-' || c WHEN 1 THEN 'hdfs://nn:8020/apps/wf-' || c || '/'
        WHEN 2 THEN '$' || '{nameNode}/apps/flow_' || c WHEN 3 THEN '/apps/WF_' || c WHEN 4 THEN '/apps/Flow-' || c
        ELSE '/apps/missing.' || k END"""
    return (
        table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
        .select(F.concat(F.lit("coord_"), "k").alias("schedule"), F.expr(app).alias("app_path"))
    )


def workflow_names(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("wf-"), key).alias("name"),
        F.concat(F.lit("repo\\flows\\flow_"), key, F.lit(".xml")).alias("path"),
        key.alias("pos"),
    )


_LINKS = """SELECT 'coord_' || o_orderkey AS schedule,
        CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS match_step,
        CASE WHEN o_orderkey % 6 < 5 THEN 'wf-' || o_custkey END AS workflow,
        CASE WHEN o_orderkey % 6 < 5 THEN '{{job_id:wf-' || o_custkey || '}}' ELSE '/apps/missing.' || o_orderkey END AS target,
        CASE WHEN o_orderkey % 6 < 5 THEN 'run_wf_' || o_custkey ELSE 'run_missing_' || o_orderkey END AS task_key,
        CASE WHEN o_orderkey % 6 = 5 THEN printf('@WARNING@', 'coord_' || o_orderkey, '/apps/missing.' || o_orderkey) END AS warning
    FROM orders""".replace("@WARNING@", fv.NO_WORKFLOW_WARNING.replace("'", "''"))


@query(_LINKS)
def schedule_links(spark, sf):
    return workflows.link_schedules(schedule_rows(spark, sf), workflow_names(spark, sf)).select(
        "schedule", "match_step", "workflow", "target", "task_key", "warning"
    )


@query(
    f"""SELECT schedule, coalesce(CAST(1000 + c_custkey AS VARCHAR), target) AS target FROM ({_LINKS})
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON workflow = 'wf-' || c_custkey"""
)
def schedule_links_with_ids(spark, sf):
    """Placeholders of deployed workflows are replaced by their job ids."""
    names = workflow_names(spark, sf)
    key = F.col("c_custkey")
    deployed = table(spark, sf, "customer").filter("c_acctbal >= 0")
    ids = deployed.select(F.concat(F.lit("wf-"), key).alias("name"), (key + 1000).alias("job_id"))
    return workflows.link_schedules(schedule_rows(spark, sf), names, ids).select("schedule", "target")


BUNDLE_XML = """'<bundle-app name="bundle_' || k || '" xmlns="uri:oozie:bundle:0.2"><coordinator name="main"><app-path>/coord/c' || k ||
    '</app-path></coordinator><coordinator name="extra"><app-path>/ignored</app-path><configuration><property><name>oozie.coord.application.path</name><value>/coord/x' || k ||
    '</value></property><property><name>kickOffTime</name><value>2024-01-01T00:00Z</value></property></configuration></coordinator></bundle-app>'"""


@query(
    """SELECT 'bundle_' || c_custkey AS bundle, 'main' AS entry, '/coord/c' || c_custkey AS app_path, '' AS kickoff_time,
        CASE WHEN c_acctbal >= 0 THEN 'coord_' || c_custkey END AS schedule, c_acctbal < 0 AS warned FROM customer
    UNION ALL SELECT 'bundle_' || c_custkey, 'extra', '/coord/x' || c_custkey, '2024-01-01T00:00Z', NULL, true FROM customer"""
)
def bundle_entries(spark, sf):
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    bundles = workflows.bundle_table(customers.select(key.alias("k")).select(F.expr(BUNDLE_XML).alias("text")))
    known = customers.filter("c_acctbal >= 0").select(
        F.concat(F.lit("/coord/c"), key).alias("path"), F.concat(F.lit("coord_"), key).alias("schedule")
    )
    return workflows.expand_bundles(bundles, known).select(
        "bundle", "entry", "app_path", "kickoff_time", "schedule", F.col("warning").isNotNull().alias("warned")
    )


@query(
    """SELECT (SELECT count(*) FROM customer) AS workflows, count(*) AS schedules, count(*) FILTER (WHERE o_orderkey % 6 < 5) AS linked,
        count(*) FILTER (WHERE o_orderkey % 6 = 5) AS unlinked, count(*) FILTER (WHERE o_orderkey % 6 = 5) AS warnings FROM orders"""
)
def workflow_fleet_summary(spark, sf):
    names = workflow_names(spark, sf)
    return workflows.fleet_summary(names, workflows.link_schedules(schedule_rows(spark, sf), names))


# an estate of odd files: prefixed XML, no or repeated names, actions with settings, unreadable texts
ODD_XML = """CASE k % 6
    WHEN 0 THEN '<wf:workflow-app xmlns:wf="uri:oozie:workflow:0.5" name="same"><wf:start to="s"/><wf:action name="s"><wf:shell><wf:exec>run_' || k ||
        '.sh</wf:exec><wf:file>a.txt</wf:file><wf:file>b.txt</wf:file></wf:shell><wf:ok to="p"/><wf:error to="fail"/></wf:action>' ||
        '<wf:action name="p"><wf:spark><wf:master>yarn</wf:master><wf:mode>cluster</wf:mode><wf:class>C' || k || '</wf:class><wf:jar>j.jar</wf:jar></wf:spark>' ||
        '<wf:ok to="end"/><wf:error to="fail"/></wf:action><wf:kill name="fail"><wf:message> failed ' || k || ' </wf:message></wf:kill></wf:workflow-app>'
    WHEN 1 THEN '<workflow-app><start to="a"/><action name="a"><shell><exec>x</exec><archive>z.zip</archive></shell><ok to="end"/><error to="end"/></action></workflow-app>'
    WHEN 2 THEN '<workflow-app name="same"' WHEN 3 THEN '' WHEN 4 THEN NULL
    ELSE '<workflow-app name="empty"></workflow-app>' END"""


def odd_files(spark, sf):
    keys = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
    return keys.select(F.concat(F.lit("flow_"), "k").alias("stem"), F.expr(ODD_XML).alias("text"))


@query(
    """WITH f AS (SELECT c_custkey AS k, 'flow_' || c_custkey AS file, c_custkey % 6 AS m FROM customer)
    SELECT file, 'same' AS workflow, 's' AS node, 'exec=run_' || k || '.sh,files=a.txt,b.txt' AS settings, NULL AS message FROM f WHERE m = 0
    UNION ALL SELECT file, 'same', 'p', 'class=C' || k || ',jar=j.jar,master=yarn,mode=cluster', NULL FROM f WHERE m = 0
    UNION ALL SELECT file, 'same', 'fail', '', 'failed ' || k FROM f WHERE m = 0
    UNION ALL SELECT file, file, 'a', 'archives=z.zip,exec=x', NULL FROM f WHERE m = 1"""
)
def workflow_settings(spark, sf):
    """Settings of actions and messages of kill nodes, with prefixed XML and repeated names."""
    nodes, _ = workflows.workflow_tables(odd_files(spark, sf))
    one = F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return nodes.select("file", "workflow", "node", F.concat_ws(",", F.array_sort(one)).alias("settings"), "message")


# one action of each kind, with the child elements that are common for it
KINDS_XML = """'<w:workflow-app xmlns:w="uri:oozie:workflow:0.5" name="kinds"><w:start to="hive"/>' ||
    '<w:action name="hive"><w:hive><w:job-tracker>jt:' || k || '</w:job-tracker><w:script>q.hql</w:script><w:param>A=1</w:param></w:hive></w:action>' ||
    '<w:action name="spark"><w:spark><w:name>job ' || k || '</w:name><w:spark-opts>--conf a=b</w:spark-opts><w:arg>1</w:arg><w:jar>0' || k || '</w:jar></w:spark></w:action>' ||
    '<w:action name="java"><w:java><w:prepare><w:delete path="/tmp/x"/></w:prepare><w:main-class>org.C' || k || '</w:main-class><w:java-opts>-Xmx1g</w:java-opts></w:java></w:action>' ||
    '<w:action name="pig"><w:pig><w:script>p.pig</w:script><w:job-xml>a.xml</w:job-xml><w:job-xml> b' || k || '.xml </w:job-xml></w:pig></w:action>' ||
    '<w:action name="sqoop"><w:sqoop><w:command>import --id ' || k || ' &lt; 5</w:command><w:configuration><w:property><w:name>q</w:name><w:value>v</w:value></w:property></w:configuration></w:sqoop></w:action>' ||
    '<w:action name="shell"><w:shell><w:exec>run.sh</w:exec><w:env-var>A=' || k || '</w:env-var><w:env-var>B=2</w:env-var><w:file>f' || k || '</w:file><w:capture-output/></w:shell></w:action>' ||
    '<w:action name="fs"><w:fs><w:name-node>hdfs://n' || k || '</w:name-node><w:mkdir path="/x"/><w:chmod path="/x" permissions="755">all</w:chmod></w:fs></w:action>' ||
    '<w:action name="email"><w:email><w:to>a@b.c</w:to><w:subject>Run ' || k || '</w:subject><w:body> ended </w:body></w:email></w:action>' ||
    '<w:action name="sub"><w:sub-workflow><w:app-path>/apps/' || k || '</w:app-path><w:propagate-configuration/></w:sub-workflow></w:action></w:workflow-app>'"""


@query(
    """SELECT 'kinds_' || c_custkey AS file, node, replace(settings, '#', CAST(c_custkey AS VARCHAR)) AS settings FROM customer, (VALUES
        ('hive', 'job-tracker=jt:#'), ('spark', 'jar=0#,name=job #,spark-opts=--conf a=b'), ('java', 'java-opts=-Xmx1g,main-class=org.C#'),
        ('pig', 'job-xml=a.xml,b#.xml'), ('sqoop', 'command=import --id # < 5'), ('shell', 'env-var=A=#,B=2,exec=run.sh,files=f#'),
        ('fs', 'chmod=all,name-node=hdfs://n#'), ('email', 'body=ended,subject=Run #,to=a@b.c'), ('sub', 'app-path=/apps/#')) t(node, settings)"""
)
def workflow_action_settings(spark, sf):
    """Every child element of every kind of action, also unknown, repeated and nested ones."""
    keys = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
    files = keys.select(F.concat(F.lit("kinds_"), "k").alias("stem"), F.expr(KINDS_XML).alias("text"))
    nodes, _ = workflows.workflow_tables(files)
    one = F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return nodes.select("file", "node", F.concat_ws(",", F.array_sort(one)).alias("settings"))


@query(
    """SELECT 'flow_' || c_custkey AS file, CASE c_custkey % 6 WHEN 2 THEN 'XML parse error' WHEN 3 THEN 'empty text' ELSE 'no text' END AS reason
    FROM customer WHERE c_custkey % 6 IN (2, 3, 4)"""
)
def unreadable_workflows(spark, sf):
    return corpora.unreadable_files(odd_files(spark, sf), "text", workflows.WORKFLOW_SCHEMA)


@query(
    """SELECT 'c_' || o_orderkey AS file, 'migrated-coordinator' AS schedule, 'wf-' || o_custkey AS workflow FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'c_' || o_orderkey, 'daily', 'wf-' || o_custkey FROM orders WHERE o_orderkey % 2 = 1"""
)
def schedule_links_by_file(spark, sf):
    """Schedules without a name, or all with the same one, each linked to its own workflow."""
    xml = F.concat(
        F.lit("<c:coordinator-app xmlns:c='uri:oozie:coordinator:0.4'"),
        F.when(F.col("o_orderkey") % 2 == 1, " name='daily'").otherwise(""),
        F.lit(" frequency='60'><c:action><c:workflow><c:app-path>/apps/wf-"), "o_custkey",
        F.lit("</c:app-path></c:workflow></c:action></c:coordinator-app>"),
    )
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    files = orders.select(F.concat(F.lit("c_"), "o_orderkey").alias("stem"), xml.alias("text"))
    return workflows.link_schedules(workflows.coordinator_table(files), workflow_names(spark, sf)).select("file", "schedule", "workflow")


# --- reports: one XML per part -----------------------------------------------------------------

_DS = '<DataSources><DataSource Name="DW"><ConnectionProperties><DataProvider>SQL</DataProvider><ConnectString>Data Source=dw</ConnectString></ConnectionProperties></DataSource></DataSources>'
_PARAMS = '<ReportParameters><ReportParameter Name="Day"><DataType>DateTime</DataType></ReportParameter><ReportParameter Name="Region"/></ReportParameters>'


def _dataset(name: str, kind: str, text: str) -> str:
    command = f"<CommandType>{kind}</CommandType>" if kind else ""
    return (
        f'<DataSet Name="{name}"><Query>{command}<CommandText> {text} </CommandText>'
        '<QueryParameters><QueryParameter Name="@Day"/></QueryParameters></Query></DataSet>'
    )


_TABLIX = (
    '<Body><ReportItems><Textbox Name="title"/><Tablix Name="grid"><DataSetName>Main</DataSetName><TablixBody><TablixRows><TablixRow>'
    '<TablixCells><TablixCell><CellContents><Textbox Name="c1"/></CellContents></TablixCell>'
    '<TablixCell><CellContents><Textbox Name="c2"/></CellContents></TablixCell></TablixCells></TablixRow></TablixRows></TablixBody></Tablix>'
    '<Chart Name="chart"><DataSetName>Main</DataSetName></Chart></ReportItems></Body>'
)
_REPORTS = (
    _DS + _PARAMS + "<DataSets>" + _dataset("Main", "", "SELECT TOP 10 ISNULL(a, 0) FROM t WITH (NOLOCK) WHERE d = getdate()") + "</DataSets>" + _TABLIX,
    _DS + "<Code>Function F() End Function</Code><DataSets>" + _dataset("Stock", "StoredProcedure", "dbo.usp_stock") + "</DataSets>",
    _PARAMS,
    "<DataSets>" + _dataset("Main", "Text", "SELECT 1") + _dataset("Full", "TableDirect", "dbo.t") + "</DataSets>" + _TABLIX,
)
REPORT_XML = f"""CASE WHEN k % 101 = 100 THEN '<Report><Name>broken' ELSE
    '<Report xmlns="http://schemas.microsoft.com/sqlserver/reporting/2010/01/reportdefinition">' ||
    CASE WHEN k % 2 = 0 THEN '<Name> Report ' || k || ' </Name>' ELSE '' END ||
    CASE k % 4 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_REPORTS))} END || '</Report>' END"""


def report_set(spark, sf):
    files = (
        spread(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k")
        .select(F.concat(F.lit("file_"), "k").alias("stem"), F.expr(REPORT_XML).alias("text"))
    )
    return reports.report_tables(files)


_RP = """SELECT CASE WHEN p_partkey % 2 = 0 AND p_partkey % 101 <> 100 THEN 'Report ' || p_partkey ELSE 'file_' || p_partkey END AS report,
    CASE WHEN p_partkey % 101 = 100 THEN -1 ELSE p_partkey % 4 END AS m FROM part"""


@query(
    f"""SELECT report, item_type, name, dataset FROM ({_RP}) JOIN (VALUES ('Textbox', 'title', ''), ('Tablix', 'grid', 'Main'),
        ('Textbox', 'c1', ''), ('Textbox', 'c2', ''), ('Chart', 'chart', 'Main')) v(item_type, name, dataset) ON m IN (0, 3)"""
)
def report_items(spark, sf):
    return report_set(spark, sf).items.drop("file")


@query(
    f"""SELECT report, dataset, query_language, query, '@Day' AS parameters FROM ({_RP}) JOIN (VALUES
        (0, 'Main', 'Text', 'SELECT TOP 10 ISNULL(a, 0) FROM t WITH (NOLOCK) WHERE d = getdate()'),
        (1, 'Stock', 'StoredProcedure', 'dbo.usp_stock'), (3, 'Main', 'Text', 'SELECT 1'), (3, 'Full', 'TableDirect', 'dbo.t'))
        v(m, dataset, query_language, query) USING (m)"""
)
def report_datasets(spark, sf):
    return report_set(spark, sf).datasets.select(
        "report", "dataset", "query_language", "query", F.concat_ws(",", "parameters").alias("parameters")
    )


@query(
    f"""SELECT 'source' AS part, report, 'DW|SQL|Data Source=dw' AS detail FROM ({_RP}) WHERE m IN (0, 1)
    UNION ALL SELECT 'parameter', report, p FROM ({_RP}), (VALUES ('Day'), ('Region')) v(p) WHERE m IN (0, 2)
    UNION ALL SELECT 'code', report, 'Function F() End Function' FROM ({_RP}) WHERE m = 1"""
)
def report_sources_and_parameters(spark, sf):
    tables = report_set(spark, sf)
    sources = tables.data_sources.select(
        F.lit("source").alias("part"), "report", F.concat_ws("|", "data_source", "provider", "connection").alias("detail")
    )
    params = tables.parameters.select(F.lit("parameter").alias("part"), "report", F.col("parameter").alias("detail"))
    code = tables.code_blocks.select(F.lit("code").alias("part"), "report", F.col("code").alias("detail"))
    return sources.unionByName(params).unionByName(code)


@query(
    f"""SELECT report, m IN (0, 3) AS convertible, CASE m WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS datasets FROM ({_RP})"""
)
def report_conversion_status(spark, sf):
    return reports.report_status(report_set(spark, sf)).drop("file")


@query(
    f"""SELECT report, warning FROM ({_RP}) JOIN (VALUES (-1, 'XML parse error'), (2, 'No datasets found — nothing to convert'),
        (1, 'Custom VB.NET code block detected — manual migration required'),
        (1, 'Dataset ''Stock'' uses a stored procedure (''dbo.usp_stock'') — manual migration required'),
        (3, 'Dataset ''Full'' uses TableDirect — convert to SELECT * FROM ''dbo.t'''),
        (0, 'Dataset ''Main'': T-SQL pattern detected — \\bGETDATE\\s*\\(\\)'), (0, 'Dataset ''Main'': T-SQL pattern detected — \\bISNULL\\s*\\('),
        (0, 'Dataset ''Main'': T-SQL pattern detected — \\bNOLOCK\\b'), (0, 'Dataset ''Main'': T-SQL pattern detected — \\bTOP\\s+(\\d+)\\b'))
        v(m, warning) USING (m)"""
)
def report_conversion_warnings(spark, sf):
    return reports.report_warnings(report_set(spark, sf)).select("report", "warning")


@query(
    f"""SELECT count(*) AS reports, count(*) FILTER (WHERE m IN (0, 3)) AS convertible, count(*) FILTER (WHERE m NOT IN (0, 3)) AS manual,
        sum(CASE m WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END)::BIGINT AS datasets FROM ({_RP})"""
)
def report_fleet_summary(spark, sf):
    return reports.fleet_summary(report_set(spark, sf))


@query(f"SELECT report, m IN (0, 3) AS convertible, CASE m WHEN 0 THEN 'Main' WHEN 1 THEN 'Stock' WHEN 3 THEN 'Main,Full' ELSE '' END AS names FROM ({_RP})")
def report_json_records(spark, sf):
    """Nested report records written as JSON lines and read back."""
    path = scratch_path(spark, "records")
    corpora.write_json(reports.report_records(report_set(spark, sf)), path)
    schema = "report string, convertible boolean, dataset_list array<struct<dataset:string>>"
    return spark.read.schema(schema).json(path).select(
        "report", "convertible", F.concat_ws(",", "dataset_list.dataset").alias("names")
    )


@query("SELECT 'file_' || p_partkey AS file, 'Same' AS report, 'grid_' || p_partkey AS name FROM part")
def report_items_by_file(spark, sf):
    """Reports that all have one name: items stay with their own file."""
    xml = F.concat(
        F.lit("<r:Report xmlns:r='urn:x'><r:Name>Same</r:Name><r:Body><r:ReportItems><r:Textbox Name='grid_"),
        "p_partkey", F.lit("'/></r:ReportItems></r:Body></r:Report>"),
    )
    files = table(spark, sf, "part").select(F.concat(F.lit("file_"), "p_partkey").alias("stem"), xml.alias("text"))
    return reports.report_tables(files).items.select("file", "report", "name")


# --- schedules and streams ---------------------------------------------------------------------

_FREQ = "CASE user_id % 3 WHEN 0 THEN '$' || '{coord:days(1)}' WHEN 1 THEN '$' || '{coord:hours(6)}' ELSE '720' END"


@query(
    """WITH u AS (SELECT DISTINCT user_id FROM events), grid AS (
        SELECT user_id, CASE user_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 6 ELSE 12 END AS h FROM u),
    slots AS (SELECT user_id, h, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:59:59', to_hours(h))) AS slot FROM grid),
    runs AS (SELECT DISTINCT user_id, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / h) * h AS BIGINT)) AS slot FROM events JOIN grid USING (user_id))
    SELECT 'user_' || user_id AS schedule, slot FROM slots WHERE NOT EXISTS (
        SELECT 1 FROM runs WHERE runs.user_id = slots.user_id AND runs.slot = slots.slot)"""
)
def missing_schedule_slots(spark, sf):
    """Users as schedules of different frequency; slots in which the user has no event."""
    events = table(spark, sf, "events")
    name = F.concat(F.lit("user_"), "user_id").alias("schedule")
    plan = events.select("user_id").distinct().select(
        name,
        F.expr(_FREQ).alias("frequency"),
        F.lit("2024-01-01T00:00Z").alias("start"),
        F.lit("2024-01-31T00:00Z").alias("end"),
        F.lit("UTC").alias("timezone"),
    )
    hours = F.when(F.col("user_id") % 3 == 0, 24).when(F.col("user_id") % 3 == 1, 6).otherwise(12)
    runs = events.select(
        name,
        (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(F.hour("ts") / hours) * hours).cast("int"))).alias("slot"),
    )
    return schedules.missing_slots(schedules.schedule_slots(plan), runs).select("schedule", "slot")


@query(
    """WITH u AS (SELECT DISTINCT user_id FROM events), grid AS (
        SELECT user_id, CASE user_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 6 ELSE 12 END AS h FROM u),
    slots AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:59:59', to_hours(h))) AS slot FROM grid)
    SELECT 'file_' || s.user_id AS file, 'nightly' AS schedule, slot, min(ts) AS started FROM slots s
    LEFT JOIN events e ON e.user_id = s.user_id AND ts >= slot AND ts < slot + INTERVAL 5 HOUR GROUP BY ALL"""
)
def schedule_runs_by_slot(spark, sf):
    """Schedules of one name in many files: the first run of each slot, up to five hours late."""
    events = table(spark, sf, "events")
    keys = [F.concat(F.lit("file_"), "user_id").alias("file"), F.lit("nightly").alias("schedule")]
    plan = events.select("user_id").distinct().select(
        *keys, F.expr(_FREQ).alias("frequency"), F.lit("2024-01-01T00:00Z").alias("start"), F.lit("2024-01-31T00:00Z").alias("end"), F.lit("UTC").alias("timezone")
    )
    runs = events.select(*keys, F.col("ts").cast("timestamp_ntz").alias("started"))
    found = schedules.runs_by_slot(schedules.schedule_slots(plan), runs, 5 * 3600)
    return found.select("file", "schedule", "slot", "started")


@query(
    """SELECT 'user_' || user_id AS schedule, CASE user_id % 4 WHEN 0 THEN 'frequency ''sometimes'' cannot be read' WHEN 1 THEN 'end cannot be read'
        ELSE 'start is not before end' END AS reason FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 < 3"""
)
def rejected_schedules(spark, sf):
    """Users as schedules, three in four of which cannot be read."""
    k = F.col("user_id") % 4
    plan = table(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("user_"), "user_id").alias("schedule"),
        F.when(k == 0, "sometimes").otherwise("60").alias("frequency"),
        F.when(k == 2, "2024-02-01T00:00Z").otherwise("2024-01-01T00:00Z").alias("start"),
        F.when(k == 1, "soon").otherwise("2024-01-31T00:00Z").alias("end"),
    )
    return schedules.rejected_schedules(plan).select("schedule", "reason")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def streamed_daily_summary(spark, sf):
    """Events arriving as files; each batch adds its partial sums, which are added up at the end."""
    events = table(spark, sf, "events")
    name, path = fresh(spark, "stream_totals")
    src.create_table(spark, name, "day DATE, event_type STRING, n BIGINT, total DOUBLE, batch BIGINT", "parquet", ["batch"], path)
    totals = {"n": F.count("*"), "total": F.sum("value")}
    stream = read_stream(spark, f"{sf}/events*.parquet", events.schema)
    stream_daily_totals(stream, name, scratch_path(spark, "stream-checkpoint"), ["event_type"], totals)
    found = daily_totals(spark.table(name), ["event_type"], list(totals))
    return found.withColumn("total", F.round("total", 2))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, median(value) AS middle FROM events GROUP BY ALL")
def streamed_daily_medians(spark, sf):
    """Events arriving as files; medians do not add up, so each batch computes the days it touches again."""
    events = table(spark, sf, "events")
    name, path = fresh(spark, "stream_summary")
    src.create_table(spark, name, "event_type STRING, n BIGINT, middle DOUBLE, day DATE", "parquet", ["day"], path)

    def summarise(df):
        return df.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.median("value").alias("middle"))

    stream_daily_summary(
        read_stream(spark, f"{sf}/events*.parquet", events.schema),
        lambda: table(spark, sf, "events"),
        summarise,
        name,
        scratch_path(spark, "stream-checkpoint"),
    )
    return spark.table(name)
