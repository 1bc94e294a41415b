"""Chat formatting by schema fingerprints.

A record is a JSON text in one of several layouts. Its fingerprint is the hash of its nested field paths (field
names in order of name, arrays as such, types of the leaves left out). The fingerprint selects a declarative mapping
that gives the turns. Turns are then written with control strings around them; whatever in a text looks like
a control string is escaped reversibly, so that markers come from the template alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.llm.common import fresh, quoted

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed control strings of common templates; in texts a backslash goes behind their first character.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"
#: Speaker names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _field(record: Column, path: str) -> Column:
    return F.coalesce(F.variant_get(record, path, "string"), F.lit(""))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _listed(path: str, role: str, text: str) -> Callable[[Column], Column]:
    """Turns from an array of objects."""

    def run(record: Column) -> Column:
        each = F.variant_get(record, path, f"array<struct<{quoted(role)}:string,{quoted(text)}:string>>")
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        speaker = lambda t: F.coalesce(names[t[role]], t[role], F.lit(""))
        return F.transform(
            each, lambda t: F.struct(speaker(t).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))
        )

    return run


@dataclass(frozen=True)
class Mapping:
    """A layout: an example with its fields, and how the turns come from it."""

    name: str
    example: str
    turns: Callable[[Column], Column]


MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', _listed("$.messages", "role", "content")),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', _listed("$.conversations", "from", "value")),
    Mapping(
        "prompt",
        '{"prompt":"","completion":""}',
        lambda r: F.array(_turn("user", _field(r, "$.prompt")), _turn("assistant", _field(r, "$.completion"))),
    ),
    Mapping(
        "instruction",
        '{"instruction":"","output":""}',
        lambda r: F.array(_turn("user", _field(r, "$.instruction")), _turn("assistant", _field(r, "$.output"))),
    ),
    Mapping(
        "instruction with input",
        '{"instruction":"","input":"","output":""}',
        lambda r: F.array(
            _turn("user", F.concat_ws("\n\n", _field(r, "$.instruction"), F.nullif(_field(r, "$.input"), F.lit("")))),
            _turn("assistant", _field(r, "$.output")),
        ),
    ),
    Mapping(
        "instruction with system",
        '{"system":"","instruction":"","output":""}',
        lambda r: F.array(
            _turn("system", _field(r, "$.system")),
            _turn("user", _field(r, "$.instruction")),
            _turn("assistant", _field(r, "$.output")),
        ),
    ),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant; leaves count without their types."""
    leaf = r"(?<=[:<] |ARRAY<)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP\w*|BINARY|VARIANT|UUID|DECIMAL\(\d+,\d+\))"
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), leaf, "_"), 256)


def canonical(df: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` of the JSON records in ``column``.

    Records that are no JSON have no fingerprint; those, and records of an unknown layout, have neither layout
    nor turns, and stay. An empty list of turns has a fingerprint of its own and so no layout. Null texts and roles
    are empty ones. Repeated rows are alike; clashing names get underscores in front.
    """
    names = [fresh(df.columns, n) for n in ("fingerprint", "layout", "turns")]
    parsed = fresh([*df.columns, *names], "parsed")
    found = df.withColumn(parsed, F.try_parse_json(F.col(quoted(column))))
    found = found.withColumn(names[0], fingerprint(F.col(parsed)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        same = F.col(quoted(names[0])) == fingerprint(F.parse_json(F.lit(m.example)))
        layout = F.when(same, F.lit(m.name)).otherwise(layout)
        turns = F.when(same, m.turns(F.col(parsed)).cast(TURNS)).otherwise(turns)
    return found.withColumns({names[1]: layout, names[2]: turns}).drop(parsed)


def escaped(text: Column) -> Column:
    """The text without control strings: backslashes doubled, one put into each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: of every backslash pair with the next character the character stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(df: DataFrame, turns: str = "turns", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``.

    Each turn is the start marker, its role (percent-encoded), a line feed, its escaped text, the end marker
    and a line feed. ``loss_spans`` are (start, end) of the escaped texts of ``trained`` roles, in code points of
    the formatted text, in order. No turns give an empty text, null turns a null.
    """
    names = [fresh(df.columns, n) for n in ("formatted", "loss_spans")]
    pieces = F.transform(
        F.col(quoted(turns)),
        lambda t: F.struct(
            F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            t["role"].isin(*trained).alias("trained"),
        ),
    )
    parts = fresh([*df.columns, *names], "parts")
    tail = f"{END}\n"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(tail)).alias("at"), F.when(p["trained"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return df.withColumn(parts, pieces).withColumns({names[0]: text, names[1]: spans}).drop(parts)


def read_back(df: DataFrame, text: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """``df`` with ``read_turns`` and ``loss_texts`` (unescaped), read from the formatted text alone."""
    names = [fresh(df.columns, n) for n in ("read_turns", "loss_texts")]
    whole = F.col(quoted(text))
    each = F.filter(F.split(whole, r"<\|im_end\|>\n", -1), lambda p: p != "")
    turns = F.transform(
        each,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    losses = F.transform(
        F.col(quoted(spans)), lambda s: unescaped(F.substr(whole, s["start"] + 1, s["end"] - s["start"]))
    )
    return df.withColumns({names[0]: turns, names[1]: losses})


def records(conversations: DataFrame, raw: str = "record") -> DataFrame:
    """One JSON record per conversation (``conv_id``) from a table with a row per turn, in the layouts above.

    Two turns of user and assistant become prompt or instruction records, three that begin with a system turn
    instruction records with it, all others lists of messages under either naming. Null roles and texts are empty ones.
    Turns go by ``turn``, equal ones by role and text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, odd = F.transform("t", lambda x: x["role"]), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 1
    text = lambda k: F.col("t")[k]["text"]
    speaker = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    shared = F.transform("t", lambda x: F.struct(speaker[x["role"]].alias("from"), x["text"].alias("value")))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    shaped = (
        F.when(pair & odd, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(pair, F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(triple, F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(plain & odd, F.to_json(F.struct(shared.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return one.select("conv_id", shaped.alias(raw))
