"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units (a space run and the word after it) of a batch of texts are concatenated and indexed: places are
sorted by the next characters, as far as the longest piece reaches. Every piece of the vocabulary is then
searched in that order, all at once, which gives its range of occurrences. The occurrences are the edges of a
lattice; they are sorted by position and relaxed. The vocabulary is a merge (BPE) one, whose result is not the path
of the largest score sum, so relaxing follows the merges: in each round the best-ranked edge of every unit
that spans exactly two of its current symbols (the first of equal ones) joins them, until none is left. The ids are
those of the SentencePiece library, but that U+2581 in a text is kept as bytes and so survives decoding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warehaul.llm.common import Batches, fresh, quoted, texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are indexed at once; bounds the arrays of a task.
INDEX_CHARS = 1 << 18
#: Encoded units that a task keeps.
CACHE_UNITS = 250_000

_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Lone surrogates, which no text holds: a U+2581 of the text itself, and the end of a unit.
_OWN_SPACE = "\ud800"
_END = "\ud801"
_CHARS_PER_KEY = 4
#: Longer segments are relaxed with a heap, as rounds over all segments would be too many.
LONG_SEGMENT = 200


@dataclass
class Vocabulary:
    """Pieces of two characters and more with their ranks, the rest by character, and the bytes of every id."""

    ids: np.ndarray
    ranks: np.ndarray
    chars: np.ndarray
    lengths: np.ndarray
    alphabet: np.ndarray
    single: dict[int, int]
    byte_ids: list[int]
    output: list[bytes]
    longest: int

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Read a byte-fallback merge model once, on the driver; it travels to the tasks, whose size it bounds."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        byte_ids = [0] * 256
        output, plain = [], []
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                output.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                output.append(b"")
            else:
                output.append(name.replace(SPACE, " ").encode())
                plain.append(i)
        long = [i for i in plain if len(names[i]) > 1]
        scores = np.array([-model.get_score(i) for i in long])
        ranks = np.unique(scores, return_inverse=True)[1]
        alphabet = np.array(sorted({ord(ch) for i in plain for ch in names[i]}), np.int64)
        longest = max((len(names[i]) for i in long), default=1)
        chars = np.zeros((len(long), longest), np.int64)
        for k, i in enumerate(long):
            chars[k, : len(names[i])] = np.searchsorted(alphabet, [ord(ch) for ch in names[i]]) + 1
        return cls(
            np.array(long, np.int32), ranks.astype(np.int64), chars,
            np.array([len(names[i]) for i in long], np.int64), alphabet, {ord(names[i]): i for i in plain if len(names[i]) == 1},
            byte_ids, output, longest,
        )


def _packed(chars: np.ndarray, fill: int) -> np.ndarray:
    """Rows of characters as rows of sortable keys, ``fill`` after the last character."""
    width = -(-chars.shape[1] // _CHARS_PER_KEY) * _CHARS_PER_KEY
    wide = np.full((len(chars), width), fill, np.uint64)
    wide[:, : chars.shape[1]] = np.where(chars > 0, chars, fill)
    keys = np.zeros((len(chars), width // _CHARS_PER_KEY), np.uint64)
    for place in range(_CHARS_PER_KEY):
        keys = (keys << np.uint64(16)) | wide[:, place::_CHARS_PER_KEY]
    return keys


def _suffix_keys(codes: np.ndarray, keys: int) -> list[np.ndarray]:
    """For every place the next characters, four to a key."""
    padded = np.concatenate((codes, np.zeros(keys * _CHARS_PER_KEY, np.uint64)))
    n = len(codes)
    first = padded[: n + (keys - 1) * _CHARS_PER_KEY]
    for place in range(1, _CHARS_PER_KEY):
        first = (first << np.uint64(16)) | padded[place : place + n + (keys - 1) * _CHARS_PER_KEY]
    return [first[k * _CHARS_PER_KEY : k * _CHARS_PER_KEY + n] for k in range(keys)]


def _counts_below(order_keys: list[np.ndarray], wanted: np.ndarray, equal: bool) -> np.ndarray:
    """For each wanted row of keys, the number of sorted rows below it, or also of those equal to it."""
    low = np.zeros(len(wanted), np.int64)
    high = np.full(len(wanted), len(order_keys[0]), np.int64)
    while (live := low < high).any():
        middle = (low + high) // 2
        at = np.minimum(middle, len(order_keys[0]) - 1)
        below, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k, column in enumerate(order_keys):
            found = column[at]
            below |= same & (found < wanted[:, k])
            same &= found == wanted[:, k]
        if equal:
            below |= same
        low = np.where(live & below, middle + 1, low)
        high = np.where(live & ~below, middle, high)
    return low


class Encoder:
    """Encodes units in bulk and texts by their units."""

    def __init__(self, vocabulary: Vocabulary, cache_units: int = CACHE_UNITS):
        self.v, self.cache_units = vocabulary, cache_units
        self.known: dict[str, bytes] = {}
        self.from_keys = _packed(vocabulary.chars, 0)
        self.to_keys = _packed(vocabulary.chars, 0xFFFF)
        self.dense = np.zeros(0x110000, np.uint64)
        self.dense[vocabulary.alphabet] = np.arange(1, len(vocabulary.alphabet) + 1)
        self.single = np.full(0x110000, -1, np.int32)
        self.single[list(vocabulary.single)] = list(vocabulary.single.values())

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of all pieces of two and more characters: (start, piece), sorted by start."""
        if not len(self.v.ids) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a character in no piece is 0, which sorts before whatever a piece goes on with
        keys = _suffix_keys(self.dense[codes], self.from_keys.shape[1])
        order = np.lexsort(keys[::-1])
        ordered = [k[order] for k in keys]
        begin, end = _counts_below(ordered, self.from_keys, False), _counts_below(ordered, self.to_keys, True)
        counts = end - begin
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[np.repeat(begin, counts) + within]
        by_start = np.argsort(start, kind="stable")
        return start[by_start], piece[by_start]

    def relax(self, size: int, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol starts (flags over all places) and, at the start of each joined symbol, its id."""
        end, rank = start + self.v.lengths[piece], self.v.ranks[piece]
        bounds, joined = np.ones(size + 1, bool), np.full(size, -1, np.int32)
        # places inside some edge; the others cut the text into independent segments
        inner = np.zeros(size + 2, np.int64)
        np.add.at(inner, start + 1, 1)
        np.add.at(inner, end, -1)
        first = np.flatnonzero(np.cumsum(inner)[:size] == 0)
        segment = np.searchsorted(first, start, "right") - 1
        long = np.diff(np.append(first, size))[segment] > LONG_SEGMENT
        for one in np.unique(segment[long]):
            mine = np.flatnonzero(segment == one)
            _relax_by_heap(bounds, joined, start[mine], end[mine], rank[mine], self.v.ids[piece[mine]])
        live = np.flatnonzero(~long)
        start, end, rank, segment = start[live], end[live], rank[live], segment[live]
        ids = self.v.ids[piece[live]]
        while len(start):
            count = np.cumsum(bounds)
            held = bounds[start] & bounds[end]
            span = count[end - 1] - count[start] + 1
            held &= span > 1
            start, end, rank, segment, ids, span = (x[held] for x in (start, end, rank, segment, ids, span))
            if not len(start):
                break
            heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            order = (rank << 32) | np.arange(len(rank))
            order[span != 2] = np.iinfo(np.int64).max
            best = np.minimum.reduceat(order, heads)
            going = best < np.iinfo(np.int64).max
            pick = best[going] & 0xFFFFFFFF
            places = np.flatnonzero(bounds)
            bounds[places[count[start[pick]]]] = False
            joined[start[pick]] = ids[pick]
            if not going.all():
                keep = np.repeat(going, np.diff(np.append(heads, len(start))))
                start, end, rank, segment, ids = (x[keep] for x in (start, end, rank, segment, ids))
        return bounds[:-1], joined

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, four bytes each."""
        text = _END.join(units) + _END
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds, joined = self.relax(len(codes), *self.edges(codes))
        places = np.flatnonzero(bounds)
        ends = codes[places] == ord(_END)
        places = np.where(ends, 0, places)
        code = np.where(codes[places] == ord(_OWN_SPACE), ord(SPACE), codes[places])
        own = codes[places] == ord(_OWN_SPACE)
        ids = np.where(joined[places] >= 0, joined[places], np.where(own, -1, self.single[code]))
        # characters without a piece become their UTF-8 bytes
        unknown = (ids < 0) & ~ends
        widths = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)
        counts = np.where(ends, 0, np.where(unknown, widths, 1))
        out = np.repeat(ids, counts).astype(np.int32)
        begin = np.cumsum(counts) - counts
        byte_ids = np.array(self.v.byte_ids, np.int32)
        for at, c in zip(begin[unknown].tolist(), code[unknown].tolist(), strict=True):
            raw = chr(c).encode()
            out[at : at + len(raw)] = byte_ids[list(raw)]
        stops = (begin[ends] * 4).tolist()
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; of a null or empty one none."""
        found = [_units(t) if t else [] for t in batch]
        if len(self.known) > self.cache_units:
            self.known.clear()
        missing = sorted({u for units in found for u in units if u not in self.known})
        low = 0
        while low < len(missing):
            high, size = low, 0
            while high < len(missing) and (high == low or size + len(missing[high]) < INDEX_CHARS):
                size += len(missing[high]) + 2
                high += 1
            part = missing[low:high]
            self.known.update(zip(part, self.encode_units([SPACE + u for u in part]), strict=True))
            low = high
        return [np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32) for units in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their pieces, without the space that encoding puts first."""
        return b"".join(map(self.v.output.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _units(text: str) -> list[str]:
    """Units of a text, each without the space mark that it starts with."""
    text = text.replace(SPACE, _OWN_SPACE) if SPACE in text else text
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]


def _relax_by_heap(bounds, joined, start, end, rank, ids) -> None:
    """Joins the symbols of one segment in order of rank and place."""
    import heapq

    edge = {(s, e): (r, i) for s, e, r, i in zip(*(x.tolist() for x in (start, end, rank, ids)), strict=True)}
    low, high = min(s for s, _ in edge), max(e for _, e in edge)
    after = {s: s + 1 for s in range(low, high)}
    before = {s + 1: s for s in range(low, high)}
    heap: list = []

    def offer(a):
        b = after.get(a)
        c = after.get(b)
        if c is not None and (found := edge.get((a, c))):
            heapq.heappush(heap, (found[0], a, b, c, found[1]))

    for s in range(low, high):
        offer(s)
    while heap:
        _, a, b, c, i = heapq.heappop(heap)
        if after.get(a) != b or after.get(b) != c:
            continue
        bounds[b], joined[a] = False, i
        after[a], before[c] = c, a
        del after[b]
        offer(a)
        if a in before and after.get(before[a]) == a:
            offer(before[a])


#: Characters of texts that are encoded together.
_TEXT_CHARS = 1 << 21


def encoded(
    docs: DataFrame, model_path: str = MODEL_PATH, text_column: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``piece_ids``, ``n_pieces`` and ``decoded_equal``.

    ``piece_ids`` are the ids of the whole text, ``decoded_equal`` tells whether decoding them gives it
    back. A null text counts as empty: no ids, equal. Repeated rows are each encoded. Clashing names get
    underscores in front. An empty table gives no rows. Nothing is shuffled.
    """
    carry = list(docs.columns) if carry is None else carry
    names = [fresh(carry, n) for n in ("piece_ids", "n_pieces", "decoded_equal")]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))
    text = fresh(carry, "whole_text")
    slim = docs.select(*map(quoted, carry), F.col(quoted(text_column)).cast("string").alias(text))

    def run(batches: Batches) -> Batches:
        encoder = Encoder(shared.value)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                held, size = [], 0
                while low + len(held) < batch.num_rows and size < _TEXT_CHARS:
                    held.append(batch.column(len(carry))[low + len(held)].as_py())
                    size += len(held[-1] or "")
                found = encoder.encode(held)
                equal = [encoder.decode(ids) == (t or "") for ids, t in zip(found, held, strict=True)]
                counts = [len(ids) for ids in found]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(found), pa.int32())
                )
                part = batch.slice(low, len(held))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], lists, pa.array(counts, pa.int64()), pa.array(equal, pa.bool_())],
                    [*carry, *names],
                )
                low += len(held)

    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()]
    fields = [*slim.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]
    return slim.mapInArrow(run, T.StructType(fields))
