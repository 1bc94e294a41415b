"""Packing documents into sequences: shortest pack first over the length histogram.

A document is its token ids and a closing id. Whole sequences are cut off its front; what is left has a length below that of a
sequence, and only the histogram of these lengths is packed: lengths are placed longest first, each into the shortest
packs that still hold it, many documents of one length at a time. A pattern is a run of packs of equal filling. Patterns go back to the
documents by rank among the documents of their length.

When the packs opened would hold more than ``slack`` beyond what the tokens need, documents are cut at the gap of the
shortest packs instead, so that padding stays small whatever the lengths are.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from warehaul.llm.common import Batches, texts
from warehaul.session import materialised, small

MODEL_PATH = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 2048
#: Follows the ids of each document.
CLOSING_ID = 1
#: Padding that is borne before documents are cut, as a share of all tokens.
SLACK = 0.005
#: No gap below this is filled by a cut.
LEAST_CUT = 32
#: Tokens of the texts that go to Spark in one batch.
_BATCH_TOKENS = 2_000_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Token ids of a text by a byte-level BPE vocabulary file of the tokenizers library.

    Where the file's ids are the ranks of its merges, the faster byte-pair encoder gives the same ids; texts or files that it does
    not bear go to the library itself.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.fast = self._fast(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def _fast(self, path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, merges = model["model"].get("vocab"), model["model"].get("merges")
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        if not merges or len(special) < len(model["added_tokens"]) or (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            return None
        if model["pre_tokenizer"].get("add_prefix_space") or model["normalizer"] is not None:
            return None
        made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
        first = len(vocabulary.keys() - special.keys()) - len(made)
        if any(vocabulary[m] != first + i for i, m in enumerate(made)):
            return None
        # the printable stand-ins of the byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
            except BaseException as failure:  # its panics on some very long runs are no Exception
                if type(failure).__name__ != "PanicException" and not isinstance(failure, ValueError | RuntimeError):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def tokenised(docs: DataFrame, path: str = MODEL_PATH, length: int = LENGTH, closing: int = CLOSING_ID) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian binary), ``n``, and the place of each row of ``docs`` (``doc_id``, ``text``).

    ``part`` is the partition, ``rest`` the tokens beyond whole sequences, ``rest_at`` the row's number among those of
    equal ``rest`` in its part, ``whole_at`` the whole sequences of the part before it.
    """
    names = ["doc_id", "ids", "n", "part", "rest", "rest_at", "whole_at"]

    def run(batches: Batches) -> Batches:
        encoder = Encoder(path)
        part, seen, whole = TaskContext.get().partitionId(), defaultdict(int), 0
        out, size = [], 0

        def flushed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                ids = np.append(encoder.ids(text or ""), np.uint32(closing))
                rest = len(ids) % length
                out.append((doc_id, ids.astype(f"<u{encoder.width}").tobytes(), len(ids), part, rest, seen[rest], whole))
                seen[rest] += 1
                whole += len(ids) // length
                size += len(ids)
                if size >= _BATCH_TOKENS:
                    yield flushed()
                    out, size = [], 0
        if out:
            yield flushed()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, ids binary, n bigint, part int, rest int, rest_at bigint, whole_at bigint")


def patterns(counts: dict[int, int], length: int = LENGTH, slack: float = SLACK, least_cut: int = LEAST_CUT) -> tuple[list[tuple], int]:
    """Where the documents of each length go, and the number of packs.

    ``counts``: documents by length, all below ``length``. A row is (length, first rank, end rank, start, piece length, sequence of the first rank,
    offset): the documents of these ranks put that piece at that offset of consecutive sequences. A length has at most a few rows
    for each other length, whatever the counts are.
    """
    total = sum(size * n for size, n in counts.items())
    limit = -int(-total * (1 + slack) // length)
    # longest first; of a piece: its length, that of its document, first rank, documents, start
    waiting = [(-size, size, 0, n, 0) for size, n in counts.items() if n]
    heapq.heapify(waiting)
    packs: list[tuple[int, int, int]] = []  # tokens, first sequence, sequences
    placed, opened = [], 0
    while waiting:
        least, whole, rank, n, start = heapq.heappop(waiting)
        size = -least
        filled, first, many = packs[0] if packs else (length, 0, 0)
        room = length - filled
        if size > room and (opened < limit or room < least_cut):
            # as many packs as these documents fill alone; beyond the limit only when no gap is worth a cut
            fresh = max(1, n // (length // size))
            fresh = fresh if opened >= limit else min(fresh, limit - opened)
            filled, first, many, room = 0, opened, fresh, length
            opened += fresh
        else:
            heapq.heappop(packs)
        piece, taken = min(size, room), min(n, many)
        placed.append((whole, rank, rank + taken, start, piece, first, filled))
        if many > taken:
            heapq.heappush(packs, (filled, first + taken, many - taken))
        if filled + piece < length:
            heapq.heappush(packs, (filled + piece, first, taken))
        if n > taken:
            heapq.heappush(waiting, (least, whole, rank + taken, n - taken, start))
        if piece < size:
            heapq.heappush(waiting, (piece - size, whole, rank, taken, start + piece))
    return placed, opened


def by_rank(placed: list[tuple]) -> list[tuple]:
    """``placed`` as one row per length and range of ranks, with the pieces of such documents: (length, low, high, pieces)."""
    rows = []
    lengths = defaultdict(list)
    for row in placed:
        lengths[row[0]].append(row)
    for whole, own in lengths.items():
        edges = sorted({e for r in own for e in r[1:3]})
        inside = defaultdict(list)
        for _, low, high, start, piece, first, offset in own:
            for edge in edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)]:
                inside[edge].append((start, piece, first - low, offset))
        rows += [(whole, low, high, sorted(inside[low])) for low, high in zip(edges, edges[1:], strict=False)]
    return rows


def packed(
    docs: DataFrame, path: str = MODEL_PATH, length: int = LENGTH, closing: int = CLOSING_ID, slack: float = SLACK,
    least_cut: int = LEAST_CUT,
) -> DataFrame:
    """The pieces of every row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Per piece ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32`` (of the ids as little-endian 32-bit
    numbers), ``doc_tokens`` (ids with the closing one), ``sequence_id`` and ``offset`` there. The pieces of a sequence leave no gap. A
    null or empty text is the closing id alone. Rows are packed one by one, so repeated rows and null ids each keep their
    pieces. Which of the documents of one length goes where depends on the partitions. An empty table gives no rows.

    Ids are written once to the shared folder; ranks come from counts per part and length, so rows of one length, however
    many, never meet in one task. To the driver come the counts per length (below ``length`` rows), and the patterns, which are bounded by
    the lengths, are broadcast.
    """
    spark = docs.sparkSession
    rows = materialised(tokenised(docs, path, length, closing), "token_ids")
    rests = rows.groupBy("part", "rest").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {length}")).alias("whole"))
    counted = materialised(rests, "rests")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.select(
        F.col("part").alias("of_part"),
        F.col("rest").alias("of_rest"),
        F.coalesce(F.sum("docs").over(before.partitionBy("rest")), F.lit(0)).alias("docs_before"),
    )
    parts = counted.groupBy("part").agg(F.sum("whole").alias("whole"))
    wholes = parts.select(F.col("part").alias("in_part"), F.coalesce(F.sum("whole").over(before.partitionBy(F.lit(0))), F.lit(0)).alias("whole_before"))
    found = {r["rest"]: r["n"] for r in counted.filter("rest > 0").groupBy("rest").agg(F.sum("docs").alias("n")).collect()}
    placed, opened = patterns(found, length, slack, least_cut)
    piece = "array<struct<start:int,size:int,shift:bigint,offset:int>>"
    table = spark.createDataFrame(by_rank(placed), f"size int, low bigint, high bigint, pieces {piece}")
    same = (F.col("rest") == F.col("of_rest")) & (F.col("part") == F.col("of_part"))
    ranked = rows.join(small(ranks), same).join(small(wholes), F.col("part") == F.col("in_part"))
    rank = F.col("rest_at") + F.col("docs_before")
    fits = (F.col("rest") == F.col("size")) & (rank >= F.col("low")) & (rank < F.col("high"))
    joined = ranked.withColumn("rank", rank).join(F.broadcast(table), fits, "left")
    slim = joined.select("doc_id", "ids", "n", (F.col("whole_at") + F.col("whole_before") + opened).alias("first"), "rank", "pieces")

    def run(batches: Batches) -> Batches:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            out = []
            for doc_id, raw, n, first, rank, pieces in zip(*(texts(batch, i) for i in range(6)), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                whole = n // length
                spans = [(k * length, length, first + k, 0) for k in range(whole)]
                spans += [(whole * length + p["start"], p["size"], p["shift"] + rank, p["offset"]) for p in pieces or ()]
                out += [(doc_id, a, size, crc32(ids[a : a + size].tobytes()), n, sequence, offset) for a, size, sequence, offset in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return slim.mapInArrow(run, PIECES)
