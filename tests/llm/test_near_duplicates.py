"""The stage of near duplicates against brute force."""

import itertools
import random
import re

import pytest

from tests.llm import brute
from warehaul.llm import similar, stages

SF = "/root/testdata/sf0.001"


def _shingles(text):
    found = re.findall(brute.WORD, (text or "").translate(brute.LOWER))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def _kept(rows):
    """Places of the rows that stay, by all pairs of texts."""
    sets = [_shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return sorted((rows[min(g, key=order)][0] for g in groups.values()), key=lambda i: (i is None, i))


def test_near_copies_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, SF).collect()) == want


@pytest.mark.parametrize(("hot", "key_bytes"), [(2, 3), (64, 3), (64, 4)])
def test_edited_copies_are_found(spark, hot, key_bytes):
    rng = random.Random(hot)
    rows = []
    for _ in range(60):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 60)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", similar.text_class("text"))
    ids = {r["class"]: r.text for r in docs.collect()}
    found = {r.node: r.root for r in similar.linked(docs, key_bytes=key_bytes, hot=hot).collect()}
    pairs = [
        (a, b) for a, b in itertools.combinations(ids, 2)
        if 5 * len(_shingles(ids[a]) & _shingles(ids[b])) >= 4 * len(_shingles(ids[a]) | _shingles(ids[b]))
    ]
    missed = [p for p in pairs if found.get(p[0], p[0]) != found.get(p[1], p[1])]
    assert len(pairs) > 200 and len(missed) <= 0.02 * len(pairs)


def test_a_large_group_makes_few_rows(spark, monkeypatch):
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    for number in range(400):
        copy = list(base)
        for place in rng.sample(range(150), rng.randrange(8)):
            copy[place] = f"edit{rng.randrange(40)}"
        rows.append((number, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", similar.text_class("text"))
    seen, write = [], similar.materialised

    def counting(df, name):
        out = write(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(similar, "materialised", counting)
    ids, found = {r.doc_id: r["class"] for r in docs.collect()}, {r.node: r.root for r in similar.linked(docs).collect()}
    tops = {found.get(i, i) for i in ids.values()}
    kept = _kept(rows)
    # a pair at the similarity may share no posting, so that a text may stay that all pairs would link
    assert 50 < len(kept) <= len(tops) <= 1.03 * len(kept) and len(set(ids.values())) > 300
    assert max(n for _, n in seen) < 60 * len(rows), seen


def test_shared_shingles_bound_what_meets(spark):
    rows = [(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 6]), (3, [7, 8]), (4, [5, -1]), (5, [-(1 << 40), 7])]
    sets = spark.createDataFrame(rows, "num bigint, shingles array<bigint>").repartition(3, "num")
    # hashes are told apart by 32 bits
    assert {r.num: r.alone for r in similar._alone(sets).collect()} == {2: 1, 3: 1, 4: 1, 5: 1}
    prints = [bytes([x]) * 64 + bytes(range(64)) for x in (1, 2, 2, 3)]
    texts = [(i, r, 100, c, p) for i, (r, c, p) in enumerate(zip((0, 0, 2, 3), (95, 95, 90, 80), prints, strict=True))]
    texts = spark.createDataFrame(texts, "num bigint, root bigint, n bigint, c bigint, fp binary")
    pairs = similar._apart(texts, similar._places(1024, 6, 3), 0.8, 1024, 8).collect()
    assert sorted(map(tuple, pairs)) == [(0, 2), (1, 2)]


def test_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, text), (2, text + " and more"), (3, text[: len(text) // 2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, SF).collect()) == [1, 3]


def test_rows_are_told_apart_by_id_and_text(spark):
    other = "one two three four five six seven eight nine ten"
    rows = [
        (None, "alpha beta"), (None, "gamma delta"), (None, other), (7, other), (7, "the same id"), (7, "with another text"),
        (8, "the same id"), (8, "the same id"), (9, "alone"), (9, "alone"), (None, None), (5, ""), (6, "  \n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "map(1, 2) AS extra")
    got = [(r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, SF).collect()]
    want = [
        (None, "alpha beta"), (None, "gamma delta"), (7, other), (7, "the same id"), (7, "with another text"), (9, "alone"), (5, ""),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
