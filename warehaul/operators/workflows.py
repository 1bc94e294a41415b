"""Many workflow definitions as node and edge tables, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.functions import fixed_values as fv
from warehaul.functions import scalar
from warehaul.functions.fixed_values import ACTION_KINDS
from warehaul.operators.joins import link_or_placeholder, match_cascade
from warehaul.session import checkpointed, materialised, small
from warehaul.sources.corpora import parse_xml

_PROPERTIES = "struct<property:array<struct<name:string,value:string>>>"
_TEXTS = ("script", "exec", "class", "jar", "master", "mode", "app-path")
_LISTS = ("param", "arg", "argument", "file", "archive")
_ACTION = "struct<{},configuration:{}>".format(
    ",".join([f"`{t}`:string" for t in _TEXTS] + [f"{x}:array<string>" for x in _LISTS]), _PROPERTIES
)
_KINDS = ",".join(f"`{k}`:{_ACTION}" for k in ACTION_KINDS)
WORKFLOW_SCHEMA = (
    f"_name string, global struct<configuration:{_PROPERTIES}>, start struct<_to:string>,"
    " kill array<struct<_name:string,message:string>>,"
    " fork array<struct<_name:string,path:array<struct<_start:string>>>>,"
    " `join` array<struct<_name:string,_to:string>>,"
    " decision array<struct<_name:string,switch:struct<`case`:array<struct<_to:string,_VALUE:string>>,"
    "default:struct<_to:string>>>>,"
    " action array<struct<_name:string,`_retry-max`:string,`_retry-interval`:string,`retry-max`:string,"
    f"`retry-interval`:string,ok:struct<_to:string>,error:struct<_to:string>,{_KINDS}>>"
)
#: The same action bodies as texts by child element, and in whatever shape they have.
_BODIES = "action array<struct<{}>>"
_TEXT_BODIES = _BODIES.format(",".join(f"`{k}`:map<string,string>" for k in ACTION_KINDS))
_SHAPED_BODIES = _BODIES.format(",".join(f"`{k}`:variant" for k in ACTION_KINDS))
#: Child elements that have a column of their own.
_APART = ("configuration", "param", "script", "arg", "argument")
_VIEWS = (("texts", _TEXT_BODIES), ("shaped", _SHAPED_BODIES))
COORDINATOR_SCHEMA = (
    "_name string, _frequency string, _start string, _end string, _timezone string,"
    " action struct<workflow:struct<`app-path`:string>>"
)
BUNDLE_SCHEMA = (
    "_name string, coordinator array<struct<_name:string,`app-path`:string,"
    f"configuration:{_PROPERTIES}>>"
)


def _properties(config: Column) -> Column:
    pairs = F.transform(
        F.filter(config["property"], lambda p: F.trim(p["name"]) != ""),
        lambda p: F.struct(F.trim(p["name"]).alias("key"), F.coalesce(F.trim(p["value"]), F.lit("")).alias("value")),
    )
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return scalar.last_wins(F.coalesce(pairs, empty))


def _settings() -> Column:
    """The child elements of an action body by name, whatever names they have; those without text of their own are left out.

    Repeated elements are comma-joined. The text of an element that stands once is as written; among repeated ones only
    files, archives and those in ``_APART`` are sure to keep leading zeros.
    """

    def parts(v: Column) -> Column:
        """The names of the elements in an element; null for plain text."""
        return F.filter(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: ~k.startswith("_"))

    def own(v: Column) -> Column:
        """The text that an element holds beside elements and attributes."""
        return F.trim(F.when(parts(v).isNotNull(), F.try_variant_get(v, "$._VALUE", "string")).otherwise(F.try_variant_get(v, "$", "string")))

    def value(name: Column, v: Column) -> Column:
        # most elements are plain texts; only lists and elements within elements are looked into
        shape = F.schema_of_variant(v)
        many = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), own), lambda t: F.coalesce(t, F.lit("")) != "")
        plain = F.trim(F.col("texts")[name])
        deep = F.when(F.size(parts(v)) > 0, own(v)).otherwise(plain)
        return F.when(shape.startswith("ARRAY"), scalar.joined(many)).when(shape.startswith("OBJECT"), deep).otherwise(plain)

    lists = [(f"{t}s", scalar.joined(F.transform(F.col(f"body.{t}"), lambda x: F.trim(x)))) for t in ("file", "archive")]
    told = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in lists])
    children = F.filter(
        F.map_entries(F.try_variant_get("shaped", "$", "map<string,variant>")),
        lambda e: ~e["key"].startswith("_") & ~e["key"].isin(*_APART, "file", "archive"),
    )
    named = F.transform(children, lambda e: F.struct(e["key"].alias("key"), value(e["key"], e["value"]).alias("value")))
    every = F.concat(told, F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>")))
    return F.map_from_entries(F.filter(every, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def _whole(attribute: Column, element: Column) -> Column:
    """Child elements override attributes; neither means 1."""
    return F.coalesce(F.trim(element).try_cast("int"), F.trim(attribute).try_cast("int"), F.lit(1))


def workflow_tables(df: DataFrame, xml: str = "text", stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus of workflow XML, keyed by ``file`` (the stem), as names may repeat.

    Nodes: file, workflow, node, kind, action_type, retries, settings, parameters and the message of kill nodes.
    ``settings`` holds every other child element of an action by name, repeated ones comma-joined. Edges: file, workflow,
    src, dst, kind (ok or error) and the kinds of both ends. Actions of an unknown kind drop; unreadable files are
    listed by ``corpora.unreadable_files``.
    """
    docs = parse_xml(df, xml, WORKFLOW_SCHEMA).filter(~F.col("doc_bad")).select(
        F.col(stem).alias("file"),
        F.coalesce(F.nullif(F.col("doc._name"), F.lit("")), F.col(stem)).alias("workflow"),
        F.col("doc"),
        _properties(F.col("doc.global.configuration")).alias("global_config"),
        *[F.from_xml(xml, bodies, {"ignoreNamespace": "true"})["action"].alias(name) for name, bodies in _VIEWS],
    )

    no_list = F.array().cast("array<string>")

    def named(kind: str) -> Column:
        return F.coalesce(
            F.transform(
                f"doc.`{kind}`._name", lambda name: F.struct(name.alias("node"), F.lit(kind).alias("kind"))
            ),
            F.array().cast("array<struct<node:string,kind:string>>"),
        )

    others = F.concat(*[named(k) for k in ("decision", "fork", "join", "kill")])
    # all nodes of a file in one list, so that one pass over the XML gives them; the bodies of an action are taken by its place,
    # so that the views are parsed only if their columns are asked for
    listed = F.concat(
        F.transform(
            F.coalesce("doc.action", F.array()),
            lambda a, i: F.struct(i.alias("at"), a["_name"].alias("node"), F.lit("action").alias("kind")),
        ),
        F.transform(others, lambda o: F.struct(F.lit(-1).alias("at"), o["node"].alias("node"), o["kind"].alias("kind"))),
    )
    of_kind = lambda column: F.coalesce(*[F.col(f"{column}.`{k}`") for k in ACTION_KINDS])
    own = F.try_element_at(F.filter("kills", lambda k: k["_name"] == F.col("node")), F.lit(-1))
    each = docs.select(
        "file", "workflow", "global_config", "texts", "shaped", F.col("doc.action").alias("actions"), F.col("doc.kill").alias("kills"),
        F.inline_outer(listed),
    ).withColumns({"n": F.get("actions", "at"), "texts": F.get("texts", "at"), "shaped": F.get("shaped", "at")})
    found = each.select(
        "file",
        "workflow",
        "node",
        "kind",
        F.coalesce(*[F.when(F.col(f"n.`{k}`").isNotNull(), F.lit(k)) for k in ACTION_KINDS]).alias("action_type"),
        "n",
        of_kind("n").alias("body"),
        "global_config",
        of_kind("texts").alias("texts"),
        of_kind("shaped").alias("shaped"),
        F.when(F.col("kind") == "kill", F.coalesce(F.trim(own["message"]), F.lit(""))).alias("message"),
    ).filter(F.when(F.col("kind") == "action", F.col("action_type").isNotNull()).otherwise(F.col("node").isNotNull()))
    of_action = {
        "retry_max": _whole(F.col("n.`_retry-max`"), F.col("n.`retry-max`")),
        "retry_interval_ms": _whole(F.col("n.`_retry-interval`"), F.col("n.`retry-interval`")) * 60_000,
        "global_config": F.col("global_config"),
        "properties": _properties(F.col("body.configuration")),
        "params": F.coalesce(F.col("body.param"), no_list),
        "script": F.col("body.script"),
        "arguments": scalar.joined(F.coalesce(F.col("body.arg"), F.col("body.argument"))),
        "settings": _settings(),
    }
    nodes = found.select(
        "file", "workflow", "node", "kind", "action_type",
        *[F.when(F.col("kind") == "action", value).alias(name) for name, value in of_action.items()],
        "message",
    )

    def steps(path: str, kind: str, ok) -> Column:
        """Edges of one kind of element; ``ok`` gives the array of its (dst, kind)."""
        empty = F.array().cast("array<struct<src:string,dst:string,kind:string,src_kind:string>>")

        def outgoing(n: Column) -> Column:
            return F.transform(
                ok(n),
                lambda o: F.struct(
                    n["_name"].alias("src"), o["dst"].alias("dst"), o["kind"].alias("kind"), F.lit(kind).alias("src_kind")
                ),
            )

        return F.coalesce(F.flatten(F.transform(path, outgoing)), empty)

    def to(dst: Column, kind: str = "ok") -> Column:
        return F.struct(dst.alias("dst"), F.lit(kind).alias("kind"))

    def all_to(dsts: Column) -> Column:
        return F.transform(F.coalesce(dsts, no_list), lambda d: to(d))

    def known(action: Column) -> Column:
        return reduce(lambda a, b: a | b, [action[k].isNotNull() for k in ACTION_KINDS])

    every = F.concat(
        steps(
            "doc.action",
            "action",
            lambda a: F.when(known(a), F.array(to(a["ok"]["_to"]), to(a["error"]["_to"], "error"))).otherwise(
                F.array().cast("array<struct<dst:string,kind:string>>")
            ),
        ),
        steps("doc.fork", "fork", lambda f: all_to(f["path"]["_start"])),
        steps("doc.`join`", "join", lambda j: F.array(to(j["_to"]))),
        steps(
            "doc.decision",
            "decision",
            lambda d: F.concat(all_to(d["switch"]["case"]["_to"]), F.array(to(d["switch"]["default"]["_to"]))),
        ),
    )
    # all nodes of a workflow stand in its own row: the kind of a target needs no join
    own_actions = F.transform(
        F.filter(F.coalesce("doc.action", F.array()), known),
        lambda a: F.struct(a["_name"].alias("node"), F.lit("action").alias("kind")),
    )
    pairs = F.transform(F.concat(others, own_actions), lambda n: F.struct(n["node"].alias("key"), n["kind"].alias("value")))
    edges = (
        docs.select("file", "workflow", every.alias("_edges"), scalar.last_wins(pairs).alias("_kinds"))
        .select("file", "workflow", "_kinds", F.inline_outer("_edges"))
        .filter(F.coalesce(F.col("dst"), F.lit("")) != "")
        .withColumn("dst_kind", F.try_element_at("_kinds", F.col("dst")))
        .drop("_kinds")
    )
    return nodes, edges


def contract_edges(
    edges: DataFrame, keys: Sequence[str], nodes: DataFrame | None = None,
    real: Sequence[str] = ("action", "decision"), through: Sequence[str] = ("fork", "join"),
) -> DataFrame:
    """Predecessors of the real nodes: (keys, node, pred, kind), distinct.

    Walks back through pass-through nodes along ok edges; an error edge counts for one hop only.
    ``edges`` carry ``src_kind`` and ``dst_kind``, else both are looked up in ``nodes``. The pointers of
    pass-through nodes are doubled: each round follows paths twice as long, so a chain of n nodes takes about log2(n)
    rounds, and after that many what still points to a pass-through node runs in a cycle. Every round is checkpointed.
    """
    keys = list(keys)
    if nodes is not None:
        kinds = nodes.select(*keys, F.col("node").alias("_n"), F.col("kind").alias("_k")).distinct()
        for side in ("src", "dst"):
            edges = edges.join(
                kinds.withColumnRenamed("_n", side).withColumnRenamed("_k", f"{side}_kind"), [*keys, side]
            )
    is_real, passes = F.col("dst_kind").isin(*real), F.col("src_kind").isin(*through)
    edges = checkpointed(edges.select(*keys, "src", "dst", "kind", "src_kind", "dst_kind").distinct())
    # pointers of pass-through nodes to what comes before them
    inner = (F.col("kind") == "ok") & F.col("dst_kind").isin(*through) & F.col("src_kind").isin(*real, *through)
    pointers = checkpointed(
        edges.filter(inner).select(
            *keys, F.col("dst").alias("at"), F.col("src").alias("before"), F.col("src_kind").isin(*real).alias("done")
        )
    )
    rounds = max(1, (pointers.select(*keys, "at").distinct().count() + 1).bit_length())
    for _ in range(rounds):
        if pointers.filter(~F.col("done")).isEmpty():
            break
        onward = pointers.select(*keys, F.col("at").alias("before"), F.col("before").alias("_next"), F.col("done").alias("_done"))
        moved = pointers.filter(~F.col("done")).join(onward, [*keys, "before"])
        moved = moved.select(*keys, "at", F.col("_next").alias("before"), F.col("_done").alias("done"))
        pointers = checkpointed(pointers.filter("done").unionByName(moved).distinct())
    direct = edges.filter(is_real & F.col("src_kind").isin(*real)).select(
        *keys, F.col("dst").alias("node"), F.col("src").alias("pred"), "kind"
    )
    front = edges.filter(is_real & passes & (F.col("kind") == "ok")).select(*keys, F.col("dst").alias("node"), F.col("src").alias("at"))
    far = front.join(pointers.filter("done"), [*keys, "at"]).select(
        *keys, "node", F.col("before").alias("pred"), F.lit("ok").alias("kind")
    )
    return direct.unionByName(far).distinct()


def run_conditions(preds: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run condition per real node from the kinds of its predecessors; no predecessor means ALL_SUCCESS."""
    kinds = preds.groupBy(*keys, "node").agg(
        F.bool_or(F.col("kind") == "ok").alias("_ok"),
        F.bool_or(F.col("kind") == "error").alias("_error"),
        F.count_distinct("pred").alias("n_preds"),
    )
    real = nodes.filter(F.col("kind").isin("action", "decision")).select(*keys, "node").distinct()
    return real.join(kinds, [*keys, "node"], "left").select(
        *keys,
        "node",
        F.when(F.col("_ok") & F.col("_error"), fv.RUN_ALWAYS)
        .when(F.col("_error"), fv.RUN_ON_ERROR)
        .otherwise(fv.RUN_ON_SUCCESS)
        .alias("run_if"),
        F.coalesce("n_preds", F.lit(0)).cast("bigint").alias("n_preds"),
    )


def effective_config(nodes: DataFrame) -> DataFrame:
    """Parameters of every action: script path, global settings, own settings, explicit parameters; later wins."""
    script = F.when(
        F.col("action_type") == "hive", F.create_map(F.lit("script_path"), F.coalesce("script", F.lit("")))
    )
    params = F.when(F.col("action_type") == "hive", scalar.key_values(F.col("params")))
    return nodes.filter(F.col("kind") == "action").select(
        "file",
        "workflow",
        "node",
        scalar.overlay(script, F.col("global_config"), F.col("properties"), params).alias("parameters"),
    )


def coordinator_table(df: DataFrame, xml: str = "text", stem: str = "stem") -> DataFrame:
    """Schedules of a corpus of coordinator XML, keyed by ``file`` (the stem), as names may repeat or be missing.

    Unreadable files are listed by ``corpora.unreadable_files``.
    """
    docs = parse_xml(df, xml, COORDINATOR_SCHEMA).filter(~F.col("doc_bad"))
    return docs.select(
        F.col(stem).alias("file"),
        F.coalesce("doc._name", F.lit(fv.DEFAULT_SCHEDULE_NAME)).alias("schedule"),
        F.coalesce("doc._frequency", F.lit("")).alias("frequency"),
        F.col("doc._start").alias("start"),
        F.col("doc._end").alias("end"),
        F.coalesce("doc._timezone", F.lit("UTC")).alias("timezone"),
        F.coalesce(F.trim("doc.action.workflow.`app-path`"), F.lit("")).alias("app_path"),
    )


def link_schedules(schedules: DataFrame, workflows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Schedules with the workflow they start, or a placeholder and a warning.

    ``workflows`` has name, path and pos. The match is, in this order: exact name, exact file
    stem, normalised name, normalised stem; ties go to the first workflow by pos. With ``ids``
    (name, job_id) the named placeholder of a matched workflow is replaced by its real id, of a repeated name
    the smallest. ``schedules`` are told apart by ``file`` if they have it, else by ``schedule``; a repeat is an error.
    """
    # the cascade reads the schedules three times, which may come from parsed texts
    schedules = materialised(schedules, "schedules")
    app, wf_name, stem = F.nullif(scalar.app_name(F.col("app_path")), F.lit("")), F.col("name"), scalar.file_stem(F.col("path"))
    matched = match_cascade(
        schedules,
        workflows,
        "file" if "file" in schedules.columns else "schedule",
        [
            (app, wf_name),
            (app, stem),
            (scalar.normal_name(app), scalar.normal_name(wf_name)),
            (scalar.normal_name(app), scalar.normal_name(stem)),
        ],
        ["pos", "name"],
        ["pos", "name"],
    ).drop("pos").withColumnRenamed("name", "workflow")
    path = F.coalesce(F.nullif(F.col("app_path"), F.lit("")), F.concat(F.lit("/Migrations/"), "schedule"))
    fallback = F.coalesce(F.nullif(scalar.app_name(path), F.lit("")), F.col("schedule"))
    linked = link_or_placeholder(
        matched,
        "workflow",
        F.format_string(fv.JOB_PLACEHOLDER, "workflow"),
        path,
        F.format_string(fv.NO_WORKFLOW_WARNING, "schedule", path),
    ).withColumn("task_key", F.concat(F.lit("run_"), scalar.task_key(F.coalesce("workflow", fallback))))
    if ids is None:
        return linked
    one = ids.groupBy(F.col("name").alias("workflow")).agg(F.min("job_id").cast("string").alias("_id"))
    known = small(one)
    return linked.join(known, "workflow", "left").withColumn("target", F.coalesce("_id", "target")).drop("_id")


def bundle_table(df: DataFrame, xml: str = "text") -> DataFrame:
    """One row per coordinator that a bundle names."""
    docs = parse_xml(df, xml, BUNDLE_SCHEMA).filter(~F.col("doc_bad"))
    entry = docs.select(F.col("doc._name").alias("bundle"), F.explode_outer("doc.coordinator").alias("c")).filter("c IS NOT NULL").withColumn(
        "p", _properties(F.col("c.configuration"))
    )
    return entry.select(
        "bundle",
        F.col("c._name").alias("entry"),
        F.coalesce(F.try_element_at("p", F.lit("oozie.coord.application.path")), F.trim("c.`app-path`"), F.lit("")).alias("app_path"),
        F.coalesce(F.try_element_at("p", F.lit("kickOffTime")), F.lit("")).alias("kickoff_time"),
    )


def expand_bundles(bundles: DataFrame, schedules: DataFrame) -> DataFrame:
    """Bundle entries with their schedule; entries without one carry a warning.

    ``schedules`` has path and schedule; of several schedules of one path the first by name is taken.
    """
    one = schedules.groupBy(F.col("path").alias("app_path")).agg(F.min("schedule").alias("schedule"))
    return bundles.join(one, "app_path", "left").withColumn(
        "warning",
        F.when(
            F.col("schedule").isNull(),
            F.format_string(fv.NO_COORDINATOR_WARNING, "entry", "app_path"),
        ),
    )


def fleet_summary(workflows: DataFrame, links: DataFrame) -> DataFrame:
    """Workflows, schedules, linked and unlinked schedules, and warnings, as one row."""
    sides = workflows.select(F.lit(1).alias("w"), F.lit(None).cast("string").alias("workflow"), F.lit(None).cast("string").alias("warning"))
    sides = sides.unionByName(links.select(F.lit(0).alias("w"), "workflow", "warning"))
    return sides.agg(
        F.count_if(F.col("w") == 1).alias("workflows"),
        F.count_if(F.col("w") == 0).alias("schedules"),
        F.count_if((F.col("w") == 0) & F.col("workflow").isNotNull()).alias("linked"),
        F.count_if((F.col("w") == 0) & F.col("workflow").isNull()).alias("unlinked"),
        F.count("warning").alias("warnings"),
    )
