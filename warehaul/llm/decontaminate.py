"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

The CGK random walk maps a word sequence to a longer one: at step j it shows the word at its place and then
moves on by R_j(word), a random bit. Sequences at small edit distance stay close in Hamming distance, as their
walks fall in step again after each edit. A bucket key is the words shown at a few sampled steps; sampling is
repeated with fresh walks. A walk depends on nothing but step and place, so one vector of places serves the
windows that start at every word of a text, and a window is dropped as soon as its key so far is that of no item.
Windows have the size class of the items they are compared with. A window in an item's bucket is verified by
the exact word edit distance between the item and the best part of the text around the window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warehaul.llm.common import Batches, texts

SIMILARITY = 0.8
REPEATS = 10
SAMPLED = 3
#: Size classes of items grow by this factor.
CLASS_RATIO = 1.25
#: Items held by a task at once; larger benchmarks take several passes over the documents.
BLOCK_ITEMS = 5000
BLOCK_BYTES = 16 << 20

#: Sampled steps that all size classes share.
SHARED = 2

_TABLE_BITS = 16
_SLOT = np.uint64(64 - _TABLE_BITS)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: ASCII characters that are not letters or digits become spaces; other characters stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, in UTF-8."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """16 random bits for each 33-bit value and a seed."""
    with np.errstate(over="ignore"):
        x = (values + np.uint64(seed)) * np.uint64((seed * _MIX[1] | 1) & 0xFFFFFFFFFFFFFFFF)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(_MIX[0])) >> np.uint64(48)


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, found), np.uint32, len(found)).astype(np.uint64) + np.uint64(1)


@dataclass
class _Class:
    """Items of one size class: window size, sampled steps and, per repeat, the known keys after each step."""

    size: int
    items: list[int]
    steps: list[list[int]] = field(default_factory=list)
    tables: list[list[np.ndarray]] = field(default_factory=list)
    buckets: list[dict[int, list[int]]] = field(default_factory=list)


class Index:
    """LSH index of benchmark items; small enough to travel to every task (see BLOCK_ITEMS)."""

    def __init__(self, items: list[tuple[int, str]], similarity=SIMILARITY, repeats=REPEATS, sampled=SAMPLED, seed=42):
        self.items = [(i, w) for i, w in ((i, item_words(t)) for i, t in items) if w]
        self.similarity, self.repeats, self.sampled = similarity, repeats, sampled
        by_size: dict[int, _Class] = {}
        for place, (_, found) in enumerate(self.items):
            level = int(np.log(len(found)) / np.log(CLASS_RATIO) + 1e-9)
            size = max(1, int(np.ceil(CLASS_RATIO**level - 1e-9)))
            by_size.setdefault(size, _Class(min(size, len(found)), [])).items.append(place)
        self.classes = sorted(by_size.values(), key=lambda c: c.size)
        rng = np.random.default_rng(seed)
        for repeat in range(repeats):
            # the first steps are the same for all classes, so that their walk is shared; the rest spread over each class
            draw = np.sort(rng.random(sampled))
            least = max(SHARED, int(1.5 * self.classes[0].size)) if self.classes else SHARED
            for c in self.classes:
                span = max(sampled, int(1.5 * c.size))
                steps: list[int] = []
                for n, x in enumerate(draw):
                    step = int(x * (least if n < SHARED else span))
                    steps.append(max(steps[-1] + 1, step) if steps else step)
                self._index(c, repeat, steps)
        #: Per repeat and shared step, the keys of any class.
        self.known = [
            [np.logical_or.reduce([c.tables[r][n] for c in self.classes]) for n in range(min(SHARED, sampled))]
            for r in range(repeats if self.classes else 0)
        ]

    def _index(self, c: _Class, repeat: int, steps: list[int]) -> None:
        tables = [np.zeros(1 << _TABLE_BITS, bool) for _ in steps]
        buckets: dict[int, list[int]] = {}
        for place in c.items:
            words = _hashes(self.items[place][1][: c.size])
            walk = Walk(words, repeat)
            at, key = np.zeros(1, np.int64), np.zeros(1, np.uint64)
            for n, step in enumerate(steps):
                at = walk.to(at, steps[n - 1] if n else 0, step)
                key = _keyed(key, walk.shown(at, np.zeros(1, np.int64), c.size))
                tables[n][key >> _SLOT] = True
            buckets.setdefault(int(key[0]), []).append(place)
        c.steps.append(steps)
        c.tables.append(tables)
        c.buckets.append(buckets)

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(window start, item) whose keys agree in some repeat, for the words of a text or of several."""
        found: set[tuple[int, int]] = set()
        for repeat in range(self.repeats if len(hashes) and self.classes else 0):
            walk = Walk(hashes, repeat)
            shared = self.classes[0].steps[repeat]
            place, key, done = np.arange(len(hashes)), np.zeros(1, np.uint64), 0
            start = place
            for n in range(min(SHARED, self.sampled)):
                place, done = walk.to(place, done, shared[n]), shared[n]
                # windows whose walks have met are one from here on
                new = np.concatenate(([True], (place[1:] != place[:-1]) | (key[1:] != key[:-1] if n else False)))
                start, place, key = start[new], place[new], key[new] if n else key
                key = _keyed(key, walk.shown(place, start, self.classes[-1].size))
                live = self.known[repeat][n][key >> _SLOT]
                start, place, key = start[live], place[live], key[live]
                if not len(start):
                    break
            for c in self.classes:
                live = (place - start < c.size) & c.tables[repeat][min(SHARED, self.sampled) - 1][key >> _SLOT]
                begin, at, known = start[live], place[live], key[live]
                for n in range(SHARED, self.sampled):
                    at = walk.to(at, c.steps[repeat][n - 1], c.steps[repeat][n])
                    known = _keyed(known, walk.shown(at, begin, c.size))
                    live = c.tables[repeat][n][known >> _SLOT]
                    begin, at, known = begin[live], at[live], known[live]
                for s, k in zip(begin.tolist(), known.tolist(), strict=True):
                    for item in c.buckets[repeat].get(k, ()):
                        found.add((s, item))
        return found

    def verify(self, words: list[bytes], hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item place, start, words in the best part, distance) of the items that a text holds.

        Per item the part with the smallest distance, the first of equal ones.
        """
        by_item: dict[int, list[int]] = {}
        for start, item in sorted(hits):
            by_item.setdefault(item, []).append(start)
        found = []
        for item, starts in sorted(by_item.items()):
            wanted = self.items[item][1]
            n = len(wanted)
            allowed = int((1 - self.similarity) * n + 1e-9)
            known, best, reached = set(wanted), None, -1
            for start in starts:
                low, high = max(0, start - allowed - n // 4), min(len(words), start + n + 2 * allowed + n // 4)
                if high <= reached:
                    continue
                part = words[low:high]
                # every edit spoils at most one word of the item
                if len(known) - len(known.intersection(part)) > allowed:
                    continue
                distance, begin, length = best_part(wanted, part)
                if distance <= allowed and (best is None or (distance, low + begin) < (best[2], best[0])):
                    best = (low + begin, length, distance)
                reached = high
            if best:
                found.append((item, *best))
        return found


class Walk:
    """CGK walk of one repeat over a word sequence, from any places at once."""

    def __init__(self, hashes: np.ndarray, repeat: int):
        self.hashes, self.repeat = hashes, repeat
        self.lanes: dict[int, np.ndarray] = {}

    def to(self, places: np.ndarray, step: int, until: int) -> np.ndarray:
        """The places after the steps up to ``until``."""
        for j in range(step, until):
            places = places + (self._lane(j // 16, places) >> (j % 16) & 1)
        return places

    def _lane(self, block: int, places: np.ndarray) -> np.ndarray:
        """The bits of 16 steps at the places; for all words at once when many are asked for."""
        seed = self.repeat * 4096 + block + 1
        if block not in self.lanes:
            if len(places) * 16 < len(self.hashes):
                return _mixed(self.hashes.take(places, mode="clip"), seed).astype(np.uint16)
            self.lanes[block] = _mixed(self.hashes, seed).astype(np.uint16)
        return self.lanes[block].take(places, mode="clip")

    def shown(self, places: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Words at the places; one past the end of the window or of all words shows the padding word."""
        words = self.hashes.take(places, mode="clip")
        past = (places - starts >= size) | (places >= len(self.hashes))
        return np.where(past, np.uint64(0), words) if past.any() else words


def _keyed(key: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """The key with one more shown word."""
    with np.errstate(over="ignore"):
        key = (key ^ shown) * np.uint64(_MIX[0])
        return key ^ (key >> np.uint64(29))


def best_part(item: list[bytes], part: list[bytes]) -> tuple[int, int, int]:
    """Smallest edit distance from ``item`` to a consecutive part of ``part``, its start and length.

    Of equal distances the part that ends first, then that which starts last, is taken.
    """
    if part[: len(item)] == item:
        return 0, 0, len(item)
    ids: dict[bytes, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.setdefault(w, len(ids)) for w in part], np.int64)
    m = len(b)
    # distance and start are packed in one number, so that the minimum carries the start (the later one) along
    scale = 1 << 32
    ramp = np.arange(m + 1, dtype=np.int64)
    row = (m - ramp)
    for i, w in enumerate(a, 1):
        new = np.empty(m + 1, np.int64)
        new[0] = i * scale + m
        new[1:] = np.minimum(row[1:] + scale, row[:-1] + (b != w) * scale)
        new = np.minimum.accumulate(new - ramp * scale) + ramp * scale
        row = new
    end = int(np.argmin(row // scale))
    start = m - int(row[end] % scale)
    return int(row[end] // scale), start, end - start


def _blocks(benchmark: DataFrame, block_items: int):
    """The items in blocks of bounded number and size, dealt by a hash."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["b"] or 0) // BLOCK_BYTES))
    for block in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index(sorted(((r[0], r[1]) for r in mine.collect()), key=lambda i: (i[0] is None, i[0] or 0, i[1])))


#: Words that are walked over at once, over several texts; bounds the arrays.
_CHUNK_WORDS = 1 << 18


def _found_in(index: Index, batch_texts) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(text number, hit) of a batch."""
    found: list = []
    pending: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush():
        nonlocal pending, size
        if not pending:
            return
        hashes = _hashes([w for _, ws in pending for w in ws])
        edges = np.cumsum([0] + [len(ws) for _, ws in pending])
        hits: dict[int, list[tuple[int, int]]] = {}
        for start, item in index.candidates(hashes):
            text = int(np.searchsorted(edges, start, "right")) - 1
            hits.setdefault(text, []).append((start - int(edges[text]), item))
        for text, mine in sorted(hits.items()):
            number, ws = pending[text]
            found.extend((number, hit) for hit in index.verify(ws, mine))
        pending, size = [], 0

    for number, text in enumerate(batch_texts):
        ws = item_words(text)
        if ws:
            pending.append((number, ws))
            size += len(ws)
            if size >= _CHUNK_WORDS:
                flush()
    flush()
    return found


SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance bigint"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``start_word``,
    ``n_words`` (the part of the document) and ``distance`` (word edits).

    An item is held if its edit distance to some part of the whole text is at most a fifth of its words; the
    best part is given. Words are compared in lower case without ASCII punctuation. Null and wordless texts
    hold nothing; null or wordless items are held by nothing; an item without an id is reported with a null. Repeated documents give
    repeated rows, repeated items a row each. Empty tables give no rows; extra columns are not read.
    Nothing is shuffled: blocks of the benchmark travel to the texts.
    """
    kept = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    parts = []
    for index in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Batches, shared=shared) -> Batches:
            for batch in batches:
                index, ids = shared.value, batch.column(0)
                hits = _found_in(index, texts(batch, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([n for n, _ in hits], pa.int64())),
                        pa.array([index.items[h[0]][0] for _, h in hits], pa.int64()),
                        *[pa.array([h[k] for _, h in hits], pa.int64()) for k in (1, 2, 3)],
                    ],
                    ["doc_id", "item_id", "start_word", "n_words", "distance"],
                )

        parts.append(kept.mapInArrow(run, SCHEMA))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def clean(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; see ``contaminated``."""
    place = docs.columns.index(text_column)
    for index in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Batches, shared=shared) -> Batches:
            for batch in batches:
                held = {n for n, _ in _found_in(shared.value, texts(batch, place))}
                yield batch.filter(pa.array([n not in held for n in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
