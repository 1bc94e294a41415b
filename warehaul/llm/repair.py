"""Repair of conversation structure by secondary-sorted streaming.

A sound conversation is empty or an optional system turn and pairs of user and assistant turns. The cheapest edits that make one
sound come from a dynamic program over its rows whose state is what the next turn may be. Rows are dealt by conversation and
sorted by turn within it, backwards; a stream over the Arrow batches carries the costs of the four states from row to row and leaves one
byte per row: the best edit in each state. These back pointers stay with their rows, and Spark's sort, which spills to
disk, turns the rows around. A second stream then follows them from the front, carrying the state and the running hash. So a task
holds a batch and the audit of one conversation, however long conversations are, and nothing outside Spark's own spill files.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.llm.common import quoted

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: at the front, after a system turn, after a user turn, after a pair. What the next turn must be, and the state after it.
_NEXT = ("u", "u", "a", "u")
_AFTER = (2, 2, 3, 2)
_ROLE = {"u": "user", "a": "assistant"}
#: Costs of the states behind the last row: the missing turns of the pair are put in.
_END = (0, 2 * INSERT, INSERT, 0)
#: Edits in the order that settles ties.
_EDITS = "DIKR"
_D, _I, _K, _R = range(4)
_SOUND_PAIRS = {"su", "ua", "au"}
#: A character that is no white space, and the last such one.
_INK = re.compile(r"[^\x20\x09-\x0D]")
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def damaged(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` after known damage by crc32 of ``conv_id:turn``.

    Of ``modulus`` remainders 0 drops the row (no copies), 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it,
    4 makes it a user's. Nulls in role and text, and in the key, are one space.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % modulus
    text = F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def _costs(after: list[int], initial: str, must_go: bool, truncated: bool) -> tuple[list[int], int]:
    """Costs of the four states before a row, given those behind it, and the best edits packed in a byte."""
    extra = TRUNCATED if truncated else 0
    choices = []
    for state in range(4):
        mine = {_D: DELETE + after[state]}
        if not must_go:
            mine[_R] = REROLE + extra + after[_AFTER[state]]
            if initial == _NEXT[state]:
                mine[_K] = extra + after[_AFTER[state]]
            elif initial == "s" and state == 0:
                mine[_K] = extra + after[1]
        choices.append(mine)
    costs = [min(mine.values()) for mine in choices]
    # a turn put in leads from state to state; two steps meet all of them
    for _ in range(3):
        costs = [min(costs[state], INSERT + costs[_AFTER[state]]) for state in range(4)]
    packed = 0
    for state, mine in enumerate(choices):
        mine[_I] = INSERT + costs[_AFTER[state]]
        packed |= min(edit for edit, cost in mine.items() if cost == costs[state]) << 2 * state
    return costs, packed


def _faults(text: str, first: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    if not _INK.search(text):
        return "b"
    if not first:
        return "d"
    return "" if text.rstrip(_BLANK)[-1] in ".!?" else "t"


def _backwards(batches):
    """The rows of one partition, sorted backwards: with the best edits and the cost from there on."""
    conversation, costs = None, _END
    for batch in batches:
        edits, totals, faults = [], [], []
        for conv_id, role, text, first, copy in zip(batch.conv_id, batch.role, batch.text, batch["first"], batch.copy_no, strict=True):
            if (own := (pd.isna(conv_id), conv_id)) != conversation and not (own[0] and conversation and conversation[0]):
                conversation, costs = own, _END
            fault = ""
            packed = 0
            if copy > 0:
                fault = _faults(text, first and copy == 1)
                costs, packed = _costs(costs, role[:1], fault in ("b", "d"), fault == "t")
            edits.append(packed)
            totals.append(costs[0])
            faults.append(fault)
        yield batch.drop(columns=["first"]).assign(edits=edits, total=totals, fault=faults)


class _Walk:
    """One conversation from its front: state, audit, hash and counts."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.state, self.audit, self.hash = conv_id, 0, bytearray(), hashlib.sha256()
        self.cost, self.kept, self.counts, self.illegal, self.initial = None, 0, {"b": 0, "d": 0, "t": 0}, 0, None
        self.turns, self.least, self.last = 0, None, None

    def put(self, role: str, text: str) -> None:
        if self.kept:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.kept += 1

    def missing(self) -> None:
        role = _NEXT[self.state]
        self.audit += b"I"
        self.put(_ROLE[role], "")
        self.state = _AFTER[self.state]

    def step(self, turn: int | None, role: str, text: str, edits: int, total: int, fault: str) -> None:
        self.cost = total if self.cost is None else self.cost
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in _SOUND_PAIRS
        self.initial = initial
        while (edit := edits >> 2 * self.state & 3) == _I:
            self.missing()
        self.audit += _EDITS[edit].encode()
        if edit == _D:
            return
        if edit == _R:
            role = _ROLE[_NEXT[self.state]]
        self.put(role, text)
        self.state = 1 if edit == _K and initial == "s" else _AFTER[self.state]

    def row(self) -> tuple:
        while self.state in (1, 2):
            self.missing()
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        b, d, t = self.counts.values()
        return self.conv_id, gaps, b, d, t, self.illegal, self.cost or 0, self.audit.decode(), self.hash.hexdigest()


def _forwards(batches):
    """The conversations of one partition, sorted, from rows with their best edits."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    walk = None
    for batch in batches:
        out = []
        columns = (batch[c] for c in ("conv_id", "turn", "role", "text", "copy_no", "edits", "total", "fault"))
        for conv_id, turn, role, text, copy, edits, total, fault in zip(*columns, strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if walk is None or walk.conv_id != conv_id:
                out += [walk.row()] if walk else []
                walk = _Walk(conv_id)
            if copy > 0:
                walk.step(None if pd.isna(turn) else int(turn), role, text, int(edits), int(total), fault)
        if out:
            yield frame(out)
    if walk:
        yield frame([walk.row()])


def repaired(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Rows of a conversation go by turn (nulls first), then role and text; other columns are not read. ``copies`` names a column with the number of
    adjacent copies a row stands for (default: one; zero keeps the conversation, without the row). Null role and text are one space.

    Each row's first fault counts: ``blank`` (white space only), ``duplicate`` (role and text seen earlier), ``truncated`` (ends
    with none of ``.!?``). ``gaps`` are turn numbers that lack between the smallest and the largest, ``illegal`` are adjacent rows
    whose roles do not follow each other. Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for
    blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that stays adds 1. ``audit`` has
    the initials of the cheapest edits, of equally cheap ones the least in ASCII, ``cost`` their cost, ``repaired_sha256`` the hash of
    the repaired rows as ``role:text``, joined by line feeds. A conversation without rows has zeros, an empty audit and the hash of nothing.

    Rows with a null ``conv_id`` are one conversation. Repeated rows are copies and so duplicates. An empty table gives no rows.
    """
    blank = F.lit(" ")
    number = F.lit(1) if copies is None else F.coalesce(F.col(quoted(copies)), F.lit(0))
    plain = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        number.cast("bigint").alias("copies"),
    )
    # rows that are dropped leave one bare row per conversation; equal rows of a turn are counted before the shuffle
    gone = F.col("copies") <= 0
    bare = {c: F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")}
    counted = plain.select("conv_id", *bare.values(), F.greatest("copies", F.lit(0)).alias("copies"))
    counted = counted.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # the turn at which a role and text are first seen, told by two hashes; a null turn comes before all
    before = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    said = [F.xxhash64("role", "text"), F.hash("text", "role", F.lit(7))]
    marked = counted.withColumns({"said": said[0], "again": said[1]})
    firsts = marked.groupBy("conv_id", "said", "again").agg(F.min(before).alias("met")).select(
        F.col("conv_id").alias("of"), F.col("said").alias("of_said"), F.col("again").alias("of_again"), "met"
    )
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("of_said")) & (F.col("again") == F.col("of_again"))
    rows = marked.join(firsts, same).select(
        "conv_id", "turn", "role", "text", F.col("turn").eqNullSafe(F.col("met.turn")).alias("first"),
        F.explode(F.sequence(F.least("copies", F.lit(1)), F.col("copies"))).alias("copy_no"),
    )
    order = ["conv_id", "turn", "role", "text", "copy_no"]
    backward = ["conv_id", *[F.col(c).desc() for c in order[1:]]]
    kept = "conv_id bigint, turn bigint, role string, text string, copy_no bigint, edits int, total bigint, fault string"
    back = rows.repartition("conv_id").sortWithinPartitions(*backward).mapInPandas(_backwards, kept)
    return back.sortWithinPartitions(*order).mapInPandas(_forwards, REPAIRED)
