"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest

from warehaul.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, audit string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    """Rows after damage, from (conv_id, turn, role, text)."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """What ``repaired`` gives for the rows of one conversation, by best-first search over all edit scripts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not ink else "d" if (role, text) in seen else "" if ink[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, out = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            body = "\n".join(f"{r}:{t}" for r, t in out)
            digest = hashlib.sha256(body.encode()).hexdigest()
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in NEXT[last].replace("s", ""):
            heapq.heappush(queue, (cost + 2, audit + "I", at, role, (*out, (NAMES[role], ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, last, out))
            if faults[at] not in ("b", "d"):
                more = cost + (faults[at] == "t")
                if role[:1] and role[:1] in NEXT[last]:
                    heapq.heappush(queue, (more, audit + "K", at + 1, role[:1], (*out, (role, text))))
                for new in NEXT[last].replace("s", ""):
                    heapq.heappush(queue, (more + 2, audit + "R", at + 1, new, (*out, (NAMES[new], text))))


def by_conversation(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    texts = ["Yes.", "no", "Why?", "", " \t", "é漢字!", "so.\n ", None, "a: b\nuser:c."]
    roles = ["user", "assistant", "system", "tool", "", None, "uncle"]
    rows = [(7, None, "user", "Hi."), (7, None, "user", "Hi."), (8, None, None, None), (None, 3, "user", "A."), (None, 1, "system", "B.")]
    for conv_id in range(20, 700):
        start = rng.choice([0, 0, 5, -3])
        weights = rng.choice([(9, 9, 1, 1, 1, 1, 1), (1, 1, 9, 0, 0, 0, 0), (1, 1, 1, 1, 1, 1, 1)])
        said = [(rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(rng.randrange(9))]
        rows += [(conv_id, rng.choice([start + i, start + i, start + 2 * i, None]), *s) for i, s in enumerate(said)]
    return rows + rng.sample(rows, 60)


def test_repair_finds_the_cheapest_edits(spark, table):
    made = spark.createDataFrame([(*r, 5, "x") for r in table], SCHEMA).repartition(5)
    got = by_conversation(repair.repaired(repair.damaged(made), "copies"))
    after = {}
    for row in damage(table):
        after.setdefault(row[0], []).append(row)
    assert got == {c: plain(after.get(c, [])) for c in {r[0] for r in table}}
    assert sum(not v for v in after.values()) == 0 and any(c not in after for c in got)


def test_repair_without_damage_and_without_rows(spark, table):
    made = spark.createDataFrame([(*r, 5, "x") for r in table], SCHEMA)
    got = by_conversation(repair.repaired(made))
    rows = {}
    for row in table:
        rows.setdefault(row[0], []).append((*row[:2], *(" " if x is None else x for x in row[2:])))
    assert got == {c: plain(r) for c, r in rows.items()}
    assert repair.repaired(repair.damaged(made.limit(0)), "copies").collect() == []


def test_repair_carries_its_state_over_batches(spark):
    rng = random.Random(2)
    long = [(1, i, rng.choice(["user", "assistant"]), rng.choice([f"{i}.", f"{i}", "Again."])) for i in range(3000)]
    rows = [(0, 0, "user", "x" * 300_000 + "."), *long, (2, 0, "assistant", "Z.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = by_conversation(repair.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: plain([r for r in rows if r[0] == c]) for c in (0, 1, 2)}
