"""Packing against the ids of the library and against packing one document at a time."""

import heapq
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from warehaul.llm import packing

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", None, "one", "é漢字 ▁ 😀\x00  end", "a <|endoftext|> b", " " * 3000, "\n" * 5000 + "x", "it's 12 o'clock!!", "word " * 20_000,
    "z" * 200_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.MODEL_PATH)


def test_ids_equal_the_library(spark, library):
    encoder = packing.Encoder(packing.MODEL_PATH)
    assert encoder.fast is not None
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in [*TEXTS, *real]:
        assert encoder.ids(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids
    long = " " * 4_000_000
    assert len(encoder.ids(long)) > 0


def plain(lengths, size):
    """Packs of single documents: longest first, each into the shortest pack that holds it."""
    packs = []
    for n in sorted(lengths, reverse=True):
        if packs and packs[0] + n <= size:
            heapq.heapreplace(packs, packs[0] + n)
        else:
            heapq.heappush(packs, n)
    return sorted(packs)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_pack_as_single_documents_do(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 40) if rng.random() < 0.7 else 17 for _ in range(rng.choice([0, 5, 300]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed, opened = packing.patterns(counts, 40, slack=10.0)
    filled, met = defaultdict(int), defaultdict(int)
    for whole, low, high, start, piece, first, offset in sorted(placed, key=lambda r: r[-1]):
        assert (start, piece) == (0, whole)
        met[whole] += high - low
        for s in range(first, first + high - low):
            assert filled[s] == offset
            filled[s] += piece
    assert met == counts and sorted(filled.values()) == plain(lengths, 40) and opened == len(filled)


@pytest.mark.parametrize("counts", [{1500: 10**12}, {1100: 10**6, 1000: 10}, {2047: 10**9, 1: 5}, {1025: 3}, {}])
def test_cuts_bound_the_padding_of_any_lengths(counts):
    placed, opened = packing.patterns(counts)
    total = sum(n * c for n, c in counts.items())
    assert opened * 2048 <= total * (1 + packing.SLACK) + 2048 + packing.LEAST_CUT * opened
    for whole, low, high, found in packing.by_rank(placed):
        assert low < high and [a for a, *_ in found] == list(np.cumsum([0, *[n for _, n, *_ in found]])[:-1])
        assert sum(n for _, n, *_ in found) == whole
    assert {n: sum(h - a for w, a, h, _ in packing.by_rank(placed) if w == n) for n in counts} == counts


def pieces_hold(found, ids, size):
    """Every id lies in one piece, pieces leave no gap in sequences; the padding."""
    places, documents = defaultdict(list), defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= size
    assert documents.keys() == ids.keys()
    for i, many in ids.items():
        want = sorted(len(x) for x in many)
        assert sum(r.length for r in documents[i]) == sum(want) and {r.doc_tokens for r in documents[i]} == set(want)
        if len(many) > 1:
            continue
        at = 0
        for r in sorted(documents[i], key=lambda r: r.start):
            piece = np.array(many[0][at : at + r.length], "<u4")
            assert (r.start, r.ids_crc32) == (at, crc32(piece.tobytes()))
            at += r.length
    filled = {s: sum(n for _, n in spans) for s, spans in places.items()}
    return sum(size - n for n in filled.values()) / max(1, sum(filled.values()))


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_of_odd_texts(spark, library, parts):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (2, "one", "x", 3), (90, "same text", None, 1)]
    rows += [(100 + i, "many equal words of one length", "y", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pieces string, rank int").repartition(parts)
    ids = defaultdict(list)
    for i, text, *_ in rows:
        ids[i].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    pieces_hold(packing.packed(docs).collect(), ids, 2048)
    assert pieces_hold(packing.packed(docs, length=64, least_cut=4).collect(), ids, 64) < 0.02
    assert packing.packed(docs.limit(0)).collect() == []


def test_pieces_of_the_given_texts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {r.doc_id: [[*library.encode(r.text or "", add_special_tokens=False).ids, 1]] for r in docs.collect()}
    assert pieces_hold(packing.packed(docs.repartition(5)).collect(), ids, 2048) < 0.01
