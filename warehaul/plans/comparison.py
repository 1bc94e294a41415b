"""Queries: reconciliation and synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from warehaul.operators import reconcile as rec
from warehaul.operators import synthetic
from warehaul.plans.tables import table
from warehaul.registry import query


def _pair(spark, sf):
    """Orders, and orders as a faulty load left them: high ones lost, urgent ones also under a
    negative key, low ones without status, and the expensive low ones with another price."""
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    low = priority == "5-LOW"
    new = (
        old.filter(priority != "2-HIGH")
        .withColumns(
            {
                "o_orderstatus": F.when(~low, F.col("o_orderstatus")),
                "o_totalprice": F.when(low & (price > 300000), price + 1).otherwise(price),
            }
        )
        .unionByName(old.filter(priority == "1-URGENT").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    )
    return old, new


@query(
    """SELECT false AS passed, count(*) = right_count AS row_count_match, true AS schema_match, count(*) AS left_count, right_count
    FROM orders, (SELECT count(*) FILTER (WHERE o_orderpriority <> '2-HIGH') + count(*) FILTER (WHERE o_orderpriority = '1-URGENT')
        AS right_count FROM orders) GROUP BY right_count"""
)
def reconcile_row_counts(spark, sf):
    old, new = _pair(spark, sf)
    return rec.reconcile(old, new).select("passed", "row_count_match", "schema_match", "left_count", "right_count")


@query("SELECT true AS passed, true AS row_count_match, true AS schema_match, true AS data_match, count(*) AS left_count, count(*) AS right_count FROM lineitem")
def reconcile_same_result(spark, sf):
    """The same rows with other column and row order."""
    left = table(spark, sf, "lineitem")
    right = left.select(*reversed(left.columns)).repartition("l_partkey")
    return rec.reconcile(left, right).select(
        "passed", "row_count_match", "schema_match", "data_match", "left_count", "right_count"
    )


@query("SELECT * FROM (VALUES ('c_acctbal', 'left'), ('c_mktsegment', 'left'), ('balance', 'right'), ('c_custkey', 'bigint <> string')) v(\"column\", side)")
def schema_difference(spark, sf):
    people = table(spark, sf, "customer")
    changed = people.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_nationkey", F.col("c_acctbal").alias("balance"))
    return rec.schema_diff(people, changed, types=True)


@query(
    """SELECT o_orderkey, 'missing_right' AS status, '' AS changed FROM orders WHERE o_orderpriority = '2-HIGH'
    UNION ALL SELECT -o_orderkey - 1, 'missing_left', '' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'changed', CASE WHEN o_totalprice > 300000 THEN 'o_orderstatus,o_totalprice' ELSE 'o_orderstatus' END
        FROM orders WHERE o_orderpriority = '5-LOW'"""
)
def keyed_difference(spark, sf):
    old, new = _pair(spark, sf)
    return rec.diff_by_key(old, new, ["o_orderkey"]).withColumn("changed", F.concat_ws(",", "changed"))


@query(
    """SELECT side, copies, event_type, user_id FROM (
        SELECT 'left' AS side, count(*) AS copies, event_type, user_id FROM events WHERE event_type = 'error' GROUP BY ALL
        UNION ALL SELECT 'right', count(*), 'failure', user_id FROM events WHERE event_type = 'error' GROUP BY user_id)"""
)
def copies_difference(spark, sf):
    """Row difference where rows have many copies."""
    left = table(spark, sf, "events").select("event_type", "user_id")
    right = left.withColumn("event_type", F.when(F.col("event_type") == "error", "failure").otherwise(F.col("event_type")))
    return rec.diff_rows(left, right)


@query(
    """SELECT v.*, CASE WHEN "case" = 'fails' THEN 0 ELSE n END AS right_count, n AS left_count FROM
        (VALUES ('agrees', true, true, true, true, false), ('differs', false, true, true, false, false),
            ('fails', false, false, false, NULL, true))
            v("case", passed, row_count_match, schema_match, data_match, failed),
        (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)"""
)
def verdict_of_two_texts(spark, sf):
    """Original and migrated text over the same tables: one that agrees, one that differs, one that fails."""
    table(spark, sf, "lineitem").createOrReplaceTempView("wh_lineitem")
    original = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM wh_lineitem GROUP BY l_returnflag"
    texts = {
        "agrees": "SELECT sum(l_quantity) AS q, l_returnflag, count(1) AS n FROM wh_lineitem GROUP BY l_returnflag",
        "differs": "SELECT l_returnflag, count(*) + 1 AS n, sum(l_quantity) AS q FROM wh_lineitem GROUP BY l_returnflag",
        "fails": "SELECT missing_column FROM wh_lineitem",
    }
    verdicts = [
        rec.reconcile_sql(spark, original, text).withColumn("case", F.lit(case)) for case, text in texts.items()
    ]
    return (
        verdicts[0].unionByName(verdicts[1]).unionByName(verdicts[2]).select(
            "case", "passed", "row_count_match", "schema_match", "data_match", "left_count", "right_count",
            F.col("error").isNotNull().alias("failed"),
        )
    )


@query(
    """SELECT * FROM (SELECT 'customer' AS "table", count(*) AS rows, true AS same FROM customer
    UNION ALL SELECT 'orders', count(*), true FROM orders UNION ALL SELECT 'part', count(*), false FROM part
    UNION ALL SELECT 'supplier', count(*), true FROM supplier)"""
)
def fingerprint_many_tables(spark, sf):
    """Fingerprints of table pairs; one pair differs in a single column."""
    frames = []
    for name in ("customer", "orders", "part", "supplier"):
        df = table(spark, sf, name)
        other = df.repartition(df.columns[0]) if name != "part" else df.withColumn("p_size", F.col("p_size") + 1)
        left = rec.fingerprint(df, name)
        right = rec.fingerprint(other, name).select("table", "column", F.col("hash_sum").alias("other_sum"))
        frames.append(left.join(F.broadcast(right), ["table", "column"], "full"))  # one row per column
    pairs = frames[0]
    for f in frames[1:]:
        pairs = pairs.unionByName(f)
    return pairs.groupBy("table").agg(
        F.max("rows").alias("rows"), F.bool_and(F.col("hash_sum").eqNullSafe(F.col("other_sum"))).alias("same")
    )


SYNTHETIC = {
    "a_int": "INT", "a_bigint": "BIGINT", "a_small": "SMALLINT", "a_tiny": "TINYINT", "a_float": "FLOAT",
    "a_double": "DOUBLE", "a_decimal": "DECIMAL(10,2)", "a_text": "STRING", "a_varchar": "VARCHAR(20)", "a_char": "CHAR(1)",
    "a_flag": "BOOLEAN", "a_date": "DATE", "a_time": "TIMESTAMP", "a_binary": "BINARY", "a_other": "GEOMETRY",
}


@query(
    """SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, true AS numbers_in_range, true AS texts_in_shape,
        true AS varied FROM orders"""
)
def synthetic_columns(spark, sf):
    """A synthetic row beside every order key, checked against the ranges of its types."""
    rows = synthetic.synthesize_for(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SYNTHETIC)
    numbers = (
        F.col("a_int").between(1, 100_000) & F.col("a_bigint").between(1, 10_000_000) & F.col("a_small").between(1, 1000)
        & F.col("a_tiny").between(0, 127) & F.col("a_float").between(0, 10_000) & F.col("a_double").between(0, 100_000)
        & F.col("a_decimal").between(0, 99_999.99) & F.col("a_flag").isNotNull()
    )
    texts = (
        F.col("a_date").between("2020-01-01", "2023-12-31") & F.col("a_time").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
        & F.col("a_char").rlike("^[a-zA-Z]$") & F.col("a_text").rlike("^[a-z]+$") & F.col("a_varchar").rlike("^[a-z]+$")
        & (F.hex("a_binary") == "00") & F.col("a_other").rlike("^[a-z]+$")
    )
    return rows.agg(
        F.count("*").alias("n"),
        F.countDistinct("o_orderkey").alias("keys"),
        F.bool_and(numbers).alias("numbers_in_range"),
        F.bool_and(texts).alias("texts_in_shape"),
        (F.approx_count_distinct("a_int") > 100).alias("varied"),
    )


@query(
    """SELECT 'agree' AS "case", true AS passed, count(*) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer
    UNION ALL SELECT 'lost rows', false, count(*), round(sum(c_acctbal), 2) FROM customer"""
)
def generate_run_compare(spark, sf):
    """Synthetic columns beside every customer, two versions of a query over both, verdicts."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    made = synthetic.synthesize_for(people.select("c_custkey"), "c_custkey", {"city": "STRING", "amount": "DECIMAL(10,2)"})
    people.join(made, "c_custkey").createOrReplaceTempView("wh_syn_people")
    original = "SELECT c_custkey, c_name, c_acctbal, nvl(city, 'NONE') AS city, amount FROM wh_syn_people"
    changed = "SELECT c_name, c_custkey, coalesce(city, 'NONE') AS city, amount, c_acctbal FROM wh_syn_people"
    cases = {"agree": changed, "lost rows": f"{changed} WHERE amount > 50000"}
    balance = spark.sql(original).agg(F.round(F.sum("c_acctbal"), 2)).first()[0]
    verdicts = [
        rec.reconcile_sql(spark, original, text).select(F.lit(case).alias("case"), "passed", F.col("left_count").alias("rows"))
        for case, text in cases.items()
    ]
    return verdicts[0].unionByName(verdicts[1]).withColumn("balance", F.lit(balance))


# --- faults that a comparison must see, and differences that it must not -------------------------


@query(
    """SELECT false AS passed, true AS row_count_match, true AS schema_match, false AS data_match, count(*) AS left_count
    FROM orders"""
)
def reconcile_moved_null(spark, sf):
    """A value that a faulty load put into the neighbouring column, where there was NULL."""
    orders = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    here, there = F.when(urgent, F.col("o_totalprice")), F.when(~urgent, F.col("o_totalprice"))
    left = orders.select("o_orderkey", here.alias("a"), there.alias("b"))
    right = orders.select("o_orderkey", there.alias("a"), here.alias("b"))
    return rec.reconcile(left, right).select("passed", "row_count_match", "schema_match", "data_match", "left_count")


@query(
    """SELECT o_orderkey, 'left' AS side, CAST(1 AS BIGINT) AS copies FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'right', 1 FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def moved_null_rows(spark, sf):
    """The rows in which a value moved within an array with a NULL in it."""
    orders = table(spark, sf, "orders")
    pair = lambda first: F.when(F.col("o_orderpriority") == "1-URGENT", first)
    nothing = F.lit(None).cast("bigint")
    left = orders.select("o_orderkey", pair(F.array(nothing, "o_custkey")).alias("v"))
    right = orders.select("o_orderkey", pair(F.array(F.col("o_custkey"), nothing)).alias("v"))
    return rec.diff_rows(left, right).select("o_orderkey", "side", "copies")


@query(
    """SELECT * FROM (VALUES ('array', false), ('map order', true), ('same', true), ('struct', false)) v("case", same),
        (SELECT count(*) AS rows FROM customer)"""
)
def fingerprint_null_positions(spark, sf):
    """Fingerprints of columns that differ only in where a NULL stands, or in the order of map entries."""
    people = table(spark, sf, "customer")
    k, name, nothing = F.col("c_custkey"), F.lit("x"), F.lit(None).cast("bigint")
    cases = {
        "array": (F.array(nothing, k), F.array(k, nothing)),
        "struct": (F.struct(k.alias("p"), nothing.alias("q")), F.struct(nothing.alias("p"), k.alias("q"))),
        "map order": (F.create_map(name, k, F.lit("y"), nothing), F.create_map(F.lit("y"), nothing, name, k)),
        "same": (F.array(nothing, k), F.array(nothing, k)),
    }
    out = []
    for case, (a, b) in cases.items():
        left, right = (rec.fingerprint(people.select(v.alias("v")), case) for v in (a, b))
        right = right.select("column", F.col("hash_sum").alias("other"))
        # one row per column
        out.append(left.join(F.broadcast(right), "column").select(F.lit(case).alias("case"), (F.col("hash_sum") == F.col("other")).alias("same"), "rows"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


@query(
    """SELECT * FROM (VALUES ('added in another order', true, true), ('a cent less', false, false)) v("case", passed, data_match),
        (SELECT count(DISTINCT l_returnflag) AS left_count FROM lineitem)"""
)
def reconcile_large_sums(spark, sf):
    """Sums above ten million, added in another order (equal) and with a cent missing (not equal)."""
    lines = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") * 10
    whole = lines.groupBy("l_returnflag").agg((F.sum(price) + F.lit(1e7)).alias("total"))
    parts = lines.groupBy("l_returnflag", "l_suppkey").agg(F.sum(price).alias("part")).groupBy("l_returnflag")
    other = parts.agg((F.sum("part") + F.lit(1e7)).alias("total"))
    # a cent of 10^9 is the twelfth digit
    less = whole.withColumn("total", F.when(F.col("l_returnflag") == "A", F.col("total") * (1 - 1e-10)).otherwise(F.col("total")))
    cases = {"added in another order": other, "a cent less": less}
    verdicts = [rec.reconcile(whole, df).select(F.lit(c).alias("case"), "passed", "data_match", "left_count") for c, df in cases.items()]
    return verdicts[0].unionByName(verdicts[1])


@query(
    """SELECT * FROM (VALUES ('added in another order', true, 0, 0), ('a few units in the last place', true, 0, 0), ('one value changed', false, 1, 1))
        v("case", passed, left_rows, right_rows), (SELECT count(*) AS rows FROM lineitem)"""
)
def reconcile_many_sums(spark, sf):
    """A sum per order line, without keys: equal whatever the order of addition, and one changed value among all is found."""
    lines = table(spark, sf, "lineitem")
    a, b, c = F.col("l_extendedprice") * 0.1, F.col("l_quantity") * 0.7, F.col("l_orderkey") * 1.1 + F.col("l_linenumber") * 0.013
    sums = lines.select("l_returnflag", "l_orderkey", "l_linenumber", (a + b + c).alias("total"), (c + (b + a)).alias("other"))
    left = sums.select("l_returnflag", "total")
    least = sums.agg(F.min(F.struct("l_orderkey", "l_linenumber"))).first()[0]
    one = (F.col("l_orderkey") == least[0]) & (F.col("l_linenumber") == least[1])
    cases = {
        "added in another order": F.col("other"),
        "a few units in the last place": F.col("total") * F.lit(1 + 4 * 2.0**-52),
        "one value changed": F.when(one, F.col("other") * (1 + 1e-9)).otherwise(F.col("other")),
    }
    found = []
    for case, value in cases.items():
        right = sums.select("l_returnflag", value.alias("total"))
        verdict, diff = rec.reconcile_rows(left, right)
        verdict = verdict.select(F.lit(case).alias("case"), "passed", F.col("left_count").alias("rows"))
        sides = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("copies"))), F.lit(0)).alias(f"{s}_rows") for s in ("left", "right")]
        surplus = diff.agg(*sides).first().asDict()
        found.append(verdict.withColumns({c: F.lit(n) for c, n in surplus.items()}))
    return found[0].unionByName(found[1]).unionByName(found[2])
