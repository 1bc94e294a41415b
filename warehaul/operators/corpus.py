"""Rules over a table of texts: audits, rewrites, placeholders and guarded replacements.

The rules are a short Python list that becomes one projection over the texts: no join with the
rules, no shuffle of the texts, no Python worker. Texts are always read whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.operators.aggregates import count_by_value, last_by, top_usage
from warehaul.operators.projection import split_lines, without_last_break

SEVERITIES = ("BLOCKER", "ERROR", "WARNING", "INFO")
#: Rules that one projection holds; more are applied in several passes.
RULES_PER_PASS = 200


class Rule(NamedTuple):
    category: str
    severity: str
    message: str
    pattern: str
    ignore_case: bool = True

    @property
    def regex(self) -> str:
        return (fv.IGNORE_CASE if self.ignore_case else fv.CASE) + self.pattern


SCRIPT_RULES = tuple(Rule(*r) for r in fv.SCRIPT_RULES)
DIALECT_RULES = tuple(
    Rule("DIALECT", "WARNING", f"T-SQL pattern detected — {p}", p) for p in fv.DIALECT_HINTS
)
STATEMENT_REWRITES = tuple((fv.IGNORE_CASE + p, r) for p, r in (fv.STATISTICS_REWRITE, *fv.STATEMENT_REWRITES))
# (?s): a dot also stands for a line break, as the clauses of a statement may run over lines
CLAUSE_REWRITES = tuple((fv.IGNORE_CASE + "(?s)" + p, "") for p in fv.STRIPPED_CLAUSES)
SCRIPT_STRIPS = tuple((fv.IGNORE_CASE + p, "") for p in fv.STRIPPED_STATEMENTS)
PATH_REWRITES = tuple((fv.CASE + p, r) for p, r in fv.PATH_REWRITES)
CODE_WARNINGS = tuple((fv.CASE + p, m) for p, m in fv.CODE_WARNINGS)


def rules_from_table(df: DataFrame) -> list[Rule]:
    """Rules kept in a table, in the order of their position; a rule book, which people write, fits on the driver."""
    rows = df.orderBy("position").collect()
    return [Rule(r["category"], r["severity"], r["message"], r["pattern"], r["ignore_case"]) for r in rows]


def audit(df: DataFrame, id_col: str, text: str, rules: Sequence[Rule] = SCRIPT_RULES) -> DataFrame:
    """One issue per text and rule found anywhere in the text.

    ``lines`` are the lines on which the pattern matches by itself and ``count`` their number, so
    a match that spans lines is an issue with no lines. Long rule lists are applied in several passes; no rules give no issues.
    """
    if not rules:
        nothing = Rule("", "", "", "", False)
        return _audit_pass(df.limit(0), id_col, text, [nothing], 0)
    passes = [_audit_pass(df, id_col, text, rules, n) for n in range(0, len(rules), RULES_PER_PASS)]
    return reduce(DataFrame.unionByName, passes)


def _audit_pass(df: DataFrame, id_col: str, text: str, every: Sequence[Rule], first: int) -> DataFrame:
    rules = every[first : first + RULES_PER_PASS]
    hits = [f"_hit{i}" for i in range(len(rules))]
    marked = df.select(
        id_col, F.col(text).alias("_text"), *[F.col(text).rlike(r.regex).alias(h) for r, h in zip(rules, hits)]
    )
    # the text is split once, and only where some rule hits
    some = F.greatest(*[F.col(h) for h in hits]) if len(hits) > 1 else F.col(hits[0])
    split = marked.withColumn("_parts", F.when(some, split_lines(F.col("_text")))).withColumn(
        "_lines", without_last_break(F.col("_parts"))
    )

    def found(no: int, rule: Rule) -> Column:
        numbers = F.array_compact(
            F.transform("_lines", lambda line, i: F.when(line.rlike(rule.regex), i + 1))
        )
        return F.when(
            F.col(hits[no]),
            F.struct(
                F.lit(first + no).alias("rule_no"),
                F.lit(rule.category).alias("category"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.message).alias("message"),
                F.lit(rule.pattern).alias("pattern"),
                numbers.alias("lines"),
            ),
        )

    issues = F.array(*[found(i, r) for i, r in enumerate(rules)])
    # the outer form keeps Spark from evaluating the issues again in a derived filter
    return (
        split.select(id_col, F.explode_outer(issues).alias("issue"))
        .filter("issue IS NOT NULL")
        .select(id_col, "issue.*")
        .withColumn("count", F.size("lines").cast("bigint"))
    )


def _finding(parts: tuple[str, str, str]) -> Column:
    category, severity, message = parts
    return F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(message).alias("message")
    )


def classify(df: DataFrame, statement: str) -> DataFrame:
    """Findings per statement: independent flags, and one chain for tables where the first match wins."""
    upper = F.upper(F.col(statement))
    inserts = F.length(upper) - F.length(F.replace(upper, F.lit("INSERT"), F.lit("")))
    creates = upper.rlike(fv.CREATE_TABLE)
    findings = (
        F.array(
            F.when(upper.rlike(fv.REPAIR_TABLE), _finding(fv.REPAIR_FINDING)),
            F.when(
                reduce(lambda a, b: a | b, [upper.contains(w) for w in fv.INSERT_WORDS])
                & (inserts > len("INSERT"))
                & upper.contains("FROM"),
                _finding(fv.MULTI_INSERT_FINDING),
            ),
            F.when(upper.rlike(fv.LOAD_DATA), _finding(fv.LOAD_DATA_FINDING)),
            F.when(creates & upper.contains("EXTERNAL"), _finding(fv.EXTERNAL_FINDING))
            .when(creates & ~upper.contains("LOCATION"), _finding(fv.NO_LOCATION_FINDING))
            .when(creates & upper.contains("AS SELECT"), _finding(fv.CTAS_FINDING)),
        )
    )
    rows = df.select("*", F.explode_outer(findings).alias("_f")).filter("_f IS NOT NULL")
    return rows.select(*df.columns, "_f.*")


def severity_matrix(issues: DataFrame, id_col: str) -> DataFrame:
    """Number of issues per text and severity."""
    return count_by_value(issues, [id_col], "severity", SEVERITIES)


def problem_rows(issues: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Distinct, sorted rows with an ERROR or BLOCKER."""
    return issues.filter(F.col("severity").isin("ERROR", "BLOCKER")).select(*id_cols).distinct().orderBy(*id_cols)


def rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered rewrites, each on the output of the one before."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def rewrite(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] = STATEMENT_REWRITES) -> DataFrame:
    return df.withColumn(text, rewritten(F.col(text), rules))


def migrate_texts(
    df: DataFrame,
    text: str,
    rewrites: Sequence[tuple[str, str]] = PATH_REWRITES,
    warnings: Sequence[tuple[str, str]] = CODE_WARNINGS,
) -> DataFrame:
    """Rewrite ``text``, then list in ``warnings`` what is found in the rewritten text, in rule order."""
    done = rewrite(df, text, rewrites)
    found = [F.when(F.col(text).rlike(pattern), F.lit(message)) for pattern, message in warnings]
    return done.withColumn("warnings", F.array_compact(F.array(*found)))


def migrate_cells(
    df: DataFrame, doc: str, pos: str, kind: str, text: str, code: str = "code",
    rewrites: Sequence[tuple[str, str]] = PATH_REWRITES, warnings: Sequence[tuple[str, str]] = CODE_WARNINGS,
) -> tuple[DataFrame, DataFrame]:
    """(cells, document warnings): cells of kind ``code`` are rewritten, the others stay as they are;
    a document's warnings are distinct and in the order in which they are first seen.

    The warnings come from the smallest position per document and warning, so a document with
    very many cells is never gathered in one place.
    """
    is_code = F.col(kind) == code
    cells = df.withColumn(text, F.when(is_code, rewritten(F.col(text), rewrites)).otherwise(F.col(text)))
    order = {message: i for i, (_, message) in enumerate(warnings)}
    found = (
        F.array(
            *[
                F.when(is_code & F.col(text).rlike(p), F.struct(F.lit(order[m]).alias("no"), F.lit(m).alias("message")))
                for p, m in warnings
            ]
        )
    )
    first = (
        cells.select(doc, F.col(pos).alias("_pos"), F.explode_outer(found).alias("w"))
        .filter("w IS NOT NULL")
        .groupBy(doc, "w.no", "w.message")
        .agg(F.min("_pos").alias("_pos"))
    )
    # at most one row per rule and document
    per_doc = first.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_pos", "no", "message"))).alias("_w"))
    return cells, per_doc.select(doc, F.transform("_w", lambda w: w["message"]).alias("warnings"))


def extract_placeholders(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Variables of a script: (name, value, position).

    Names are those used as ``${x}`` or ``${hivevar:x}`` and those set, in first-seen order, uses
    before settings. Engine settings are skipped, the last setting wins, values are quoted, a
    variable without a setting is 'UNKNOWN'.
    """
    body = F.col(text)
    used = F.regexp_extract_all(body, F.lit("(?iU)" + fv.VARIABLE_USE), F.lit(1))
    raw_names = F.regexp_extract_all(body, F.lit("(?iU)" + fv.VARIABLE_SET), F.lit(1))
    raw_values = F.regexp_extract_all(body, F.lit("(?iU)" + fv.VARIABLE_SET), F.lit(2))
    settings = F.transform(
        F.arrays_zip(F.col("_names").alias("name"), F.col("_values").alias("value")),
        lambda s: F.struct(
            F.regexp_replace(s["name"], "(?i)^hivevar:", "").alias("name"), F.trim(_no_breaks(s["value"])).alias("value")
        ),
    )
    settings = F.filter(
        settings,
        lambda s: ~s["name"].contains(".") & ~_starts_with_any(F.lower(s["name"]), fv.ENGINE_SETTING_PREFIXES),
    )
    found = df.select(id_col, used.alias("_used"), raw_names.alias("_names"), raw_values.alias("_values"))
    staged = found.select(id_col, "_used", settings.alias("_set")).withColumn(
        "_names", F.array_distinct(F.concat("_used", F.transform("_set", lambda s: s["name"])))
    )
    rows = staged.select(id_col, "_set", F.posexplode_outer("_names").alias("position", "name"))
    rows = rows.filter("name IS NOT NULL")
    mine = F.filter("_set", lambda s: s["name"] == F.col("name"))
    value = F.try_element_at(mine, F.lit(-1))["value"]
    quoted = (
        F.when(value.isNull(), F.lit(f"'{fv.UNSET_VARIABLE}'"))
        .when(value.rlike(fv.DATE_VALUE), F.concat(F.lit("'"), value, F.lit("'")))
        .when(value.startswith("'"), value)
        .otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))
    )
    return rows.select(id_col, F.col("position").cast("bigint").alias("position"), "name", quoted.alias("value"))


def _no_breaks(value: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    tests = [value.startswith(p) for p in prefixes]
    result = tests[0]
    for t in tests[1:]:
        result = result | t
    return result


def apply_replacements(
    original: DataFrame, proposed: DataFrame, keys: Sequence[str], text: str = "text", order: Sequence[str] = ()
) -> DataFrame:
    """Accept a proposed text only if its id is known, it is long enough and it keeps the words
    INSERT and PARTITION of the original; otherwise the original stays and ``skip_reason`` says why.

    Proposals for unknown ids come back as rows without a text. With ``order`` the last proposal
    of an id wins; without it, repeated ids are an error.
    """
    if order:
        proposed = last_by(proposed, keys, order)
    else:
        repeated = proposed.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        if not repeated.isEmpty():
            raise ValueError("several proposals for one id; give an order")
    new = proposed.select(*keys, F.trim(F.col(text)).alias("_new"), F.lit(True).alias("_hit"))
    old = original.withColumn("_known", F.lit(True))
    both = old.join(new, list(keys), "full")
    reason = F.when(F.col("_known").isNull(), "unknown id").when(F.col("_hit").isNull(), F.lit(None))
    reason = reason.when(
        F.length(F.coalesce(F.col("_new"), F.lit(""))) < fv.SHORTEST_REPLACEMENT, "output too short"
    )
    for word in fv.GUARD_WORDS:
        lost = F.upper(F.col(text)).contains(word) & ~F.upper(F.col("_new")).contains(word)
        reason = reason.when(lost, f"{word} guard failed")
    checked = both.withColumn("skip_reason", reason)
    accept = F.col("_hit") & F.col("_known") & F.col("skip_reason").isNull()
    return (
        checked.withColumn("replaced", F.coalesce(accept, F.lit(False)))
        .withColumn(text, F.when(F.col("replaced"), F.col("_new")).otherwise(F.col(text)))
        .drop("_new", "_hit", "_known")
    )


def usage_metrics(calls: DataFrame, objects: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Estate figures in long form: distinct functions, objects, and sum of transformations.

    ``columns`` names the columns: ``function``, ``object`` and ``transformations`` (text is read as numbers).
    """
    figures = calls.agg(
        F.count_distinct(columns["function"]).cast("double").alias("functions"),
        F.sum(F.col(columns["transformations"]).cast("string").try_cast("double")).alias("transformations"),
    ).select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("functions", "transformations")])))
    counted = objects.agg(F.count_distinct(columns["object"]).cast("double").alias("value")).select(
        F.lit("objects").alias("metric"), "value"
    )
    return figures.unionByName(counted)


def top_functions(calls: DataFrame, name: str, count: str | None = None) -> DataFrame:
    return top_usage(calls, name, count, fv.TOP_USAGE)
