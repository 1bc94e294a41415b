"""Texts, patterns and constants that results must agree on."""

# Flags that make a Java pattern read like an ignore-case Unicode one
# in which only \n ends a line for the dot.
IGNORE_CASE = "(?idU)"
CASE = "(?dU)"

# Fixed value: characters that end a line.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Script variables.
ENGINE_SETTING_PREFIXES = ("spark.", "hive.", "mapreduce.")
UNSET_VARIABLE = "UNKNOWN"
VARIABLE_USE = r"\$\{(?:hivevar:)?(\w+)\}"
VARIABLE_SET = r"SET\s+((?:hivevar:)?[\w\.]+)\s*=\s*([^;]+)"
DATE_VALUE = r"^\d{4}-\d{2}-\d{2}"

# Whole-text rules (category, severity, message, pattern, ignore case).
SCRIPT_RULES = (
    ("UDF", "BLOCKER", "UDF JAR detected — not supported in Databricks", r"\bADD\s+JAR\b", True),
    (
        "UDF",
        "BLOCKER",
        "Hive temporary UDF detected — requires manual rewrite",
        r"\bCREATE\s+TEMPORARY\s+FUNCTION\b",
        True,
    ),
    ("VARIABLE", "WARNING", "Dynamic variables detected — manual review required", r"\$\{.*?\}", False),
)

# Ordered statement rewrites (pattern, replacement), ignoring case.
STATEMENT_REWRITES = (
    (r"\bNVL\s*\(", "COALESCE("),
    (r"\bFROM_UNIXTIME\s*\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)", "DATE_FORMAT(TIMESTAMP_SECONDS($1), $2)"),
    (r"\bFROM_UNIXTIME\s*\(\s*([^)]+?)\s*\)", "TIMESTAMP_SECONDS($1)"),
    (r"\bUNIX_TIMESTAMP\s*\(\s*\)", "CURRENT_TIMESTAMP()"),
    (r"\bDISTRIBUTE\s+BY\s+[\w,\s]+", ""),
    (r"\bSORT\s+BY\s+[\w,\s]+", ""),
    (r"/\*\+\s*MAPJOIN\((.*?)\)\s*\*/", "/*+ BROADCAST($1) */"),
)
# Clauses taken out of statements, over line breaks, after the rewrites above.
STRIPPED_CLAUSES = (
    r"ROW\s+FORMAT\s+DELIMITED.*?(?=\)|$)",
    r"ROW\s+FORMAT\s+SERDE\s+'[^']*'.*?(?=\)|$)",
    r"STORED\s+AS\s+\w+",
    r"TBLPROPERTIES\s*\([^)]*\)",
    r"CLUSTERED\s+BY\s*\([^)]*\)\s+INTO\s+\d+\s+BUCKETS",
    r"SORTED\s+BY\s*\([^)]*\)",
    r"SKEWED\s+BY\s*\([^)]*\)\s+ON\s*\([^)]*\).*?",
    r"INPUTFORMAT\s+'[^']*'",
    r"OUTPUTFORMAT\s+'[^']*'",
)
# Statements taken out of scripts.
STRIPPED_STATEMENTS = (
    r"\bADD\s+JAR\s+[^;]+;?",
    r"CREATE\s+TEMPORARY\s+FUNCTION\s+[^;]+;?",
)
STATISTICS_REWRITE = (
    r"ANALYZE\s+TABLE\s+(\w+)\s+COMPUTE\s+STATISTICS\s+FOR\s+COLUMNS",
    "ANALYZE TABLE $1 COMPUTE STATISTICS FOR ALL COLUMNS",
)

# Patterns and words that statement-level findings look for, in upper case.
CREATE_TABLE = r"CREATE\s+(EXTERNAL\s+)?TABLE"
REPAIR_TABLE = r"MSCK\s+REPAIR\s+TABLE\s+\w+"
LOAD_DATA = r"\bLOAD\s+DATA\b"
INSERT_WORDS = ("INSERT INTO", "INSERT OVERWRITE")

# Parts of application paths and names.
LEADING_VARIABLE = r"^\$\{[^}]+\}"
PATH_HOST = "^hdfs://[^/]*"
NAME_BREAKS = "[-_]+"
KEY_BREAKS = "[^a-zA-Z0-9_]"

# Texts and bound of stock levels.
STOCK_OUT, STOCK_LOW, STOCK_OK, STOCK_BOUND = "OUT OF STOCK", "LOW", "OK", 10

# Default places of storage plans.
NAME_NODE = "hdfs://namenode:8020"
LAKE_CONTAINER, LAKE_ACCOUNT = "data", "mystorageaccount"
VOLUME_CATALOG, VOLUME_SCHEMA = "main", "migrations"

# Statement-level findings (category, severity, message).
REPAIR_FINDING = ("HIVE_COMMAND", "INFO", "MSCK REPAIR replaced with REFRESH TABLE")
MULTI_INSERT_FINDING = ("MULTI_INSERT", "BLOCKER", "Hive multi-insert not supported in Databricks")
LOAD_DATA_FINDING = ("UNSUPPORTED", "BLOCKER", "LOAD DATA not supported in Databricks")
EXTERNAL_FINDING = (
    "DDL_UNSUPPORTED",
    "INFO",
    "External table converted to Delta — verify data location and format",
)
NO_LOCATION_FINDING = (
    "DDL_REVIEW",
    "INFO",
    "Table created without explicit LOCATION — verify storage behavior",
)
CTAS_FINDING = ("CTAS_REVIEW", "INFO", "CTAS converted to Delta — verify query correctness")

# Ordered path rewrites of notebook code (pattern, replacement).
PATH_REWRITES = (
    (r"hdfs:///([^\"']+)", "dbfs:/$1"),
    (r"hdfs://[^/\s\"'\)]*(/[^\"']+)", "dbfs:$1"),
)

# Notebook warnings in report order (pattern, message).
CODE_WARNINGS = (
    (
        r"\bsc\.textFile\s*\(",
        "RDD API detected: sc.textFile() → consider spark.read.text() or spark.read.csv()",
    ),
    (
        r"\bSparkContext\s*\(",
        "SparkContext() is managed by Databricks — remove explicit SparkContext initialization",
    ),
    (
        r"\bforeachPartition\s*\(",
        "foreachPartition() detected — consider applyInPandas() for vectorized partition processing",
    ),
    (
        r"\b\.collect\s*\(\s*\)",
        "collect() detected — avoid on large DataFrames; use .limit(n).collect() or write to Delta",
    ),
    (
        r"\bSparkConf\s*\(",
        "SparkConf() — cluster config belongs in cluster settings; use spark.conf.set() instead",
    ),
    (r"\.repartition\s*\(\s*\d{3,}", "High repartition count detected — validate against cluster size"),
)

# Dialect hints in report queries, ignoring case.
DIALECT_HINTS = (
    r"\bGETDATE\s*\(\)",
    r"\bGETUTCDATE\s*\(\)",
    r"\bISNULL\s*\(",
    r"\bNVL\s*\(",
    r"\bNOLOCK\b",
    r"\bTOP\s+(\d+)\b",
    r"\bDATEADD\s*\(",
    r"\bDATEDIFF\s*\(",
    r"\bCONVERT\s*\(",
)

# Storage listings and locations.
LISTING_LINE = r"^([-d])[rwx-]{9}\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$"
LOCATION_CLAUSE = r"LOCATION\s+'hdfs://[^/']*([^']*)'"

# Workflow actions and schedules.
ACTION_KINDS = ("hive", "spark", "java", "pig", "sqoop", "shell", "fs", "email", "sub-workflow")
FREQUENCY = r"\$\{coord:(minutes|hours|days|months)\((\d+)\)\}"

NO_WORKFLOW_WARNING = (
    "No workflow XML supplied for coordinator '%s'. A placeholder task pointing to '%s' was inserted. "
    "Replace it with the actual migrated notebook path."
)
NO_COORDINATOR_WARNING = (
    "Bundle entry '%s': coordinator XML for path '%s' was not supplied. "
    "Add the coordinator XML to generate a complete job payload."
)
JOB_PLACEHOLDER = "{{job_id:%s}}"
DEFAULT_SCHEDULE_NAME = "migrated-coordinator"
RUN_ALWAYS, RUN_ON_ERROR, RUN_ON_SUCCESS = "ALL_DONE", "AT_LEAST_ONE_FAILED", "ALL_SUCCESS"

# Report items.
REPORT_ITEM_KINDS = ("Tablix", "Chart", "Matrix", "Textbox", "Image", "Subreport")
UNREADABLE_WARNING = "XML parse error"
CODE_BLOCK_WARNING = "Custom VB.NET code block detected — manual migration required"
STORED_PROCEDURE_WARNING = "Dataset '%s' uses a stored procedure ('%s') — manual migration required"
TABLE_DIRECT_WARNING = "Dataset '%s' uses TableDirect — convert to SELECT * FROM '%s'"
DIALECT_WARNING = "Dataset '%s': T-SQL pattern detected — %s"
NO_DATASET_WARNING = "No datasets found — nothing to convert"

# Synthetic columns, type -> (Spark type, lowest, highest).
SYNTHETIC_TYPES = {
    "INT": ("int", 1, 100_000),
    "BIGINT": ("bigint", 1, 10_000_000),
    "SMALLINT": ("smallint", 1, 1_000),
    "TINYINT": ("tinyint", 0, 127),
    "FLOAT": ("float", 0, 10_000),
    "DOUBLE": ("double", 0, 100_000),
    "DECIMAL": ("decimal(18,2)", 0, 99_999.99),
    "STRING": ("string", None, None),
    "VARCHAR": ("string", None, None),
    "CHAR": ("string", None, None),
    "BOOLEAN": ("boolean", None, None),
    "DATE": ("string", "2020-01-01", 1460),
    "TIMESTAMP": ("string", None, None),
    "BINARY": ("binary", None, None),
}

# Guarded replacement of statements.
SHORTEST_REPLACEMENT = 10
GUARD_WORDS = ("INSERT", "PARTITION")

# Report sizes of the usage metrics.
TOP_USAGE, FIRST_CATEGORIES = 15, 12
