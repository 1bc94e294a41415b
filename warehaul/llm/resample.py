"""Importance resampling: hashed n-gram models of target and raw texts, sampled by Gumbel top-k.

Both models are multinomials over hashed unigrams and bigrams of words. They are counted by key through a shuffle and grow with
the texts, as do the keys' bits. Keys seen less than ``MIN_COUNT`` times count as one (kept apart they overfit: most are
seen once). A further feature are unigrams and bigrams of word forms. The form of a word is its course of
capitals, small letters, digits and other characters, each run as one; a word equal to the one before it has a
form of its own. The raw model is counted over all documents, the target model over half of a bounded sample of the labelled good ones.

The importance of a document is the mean of log(target / raw) over its n-grams. Its log weight is that mean, less a cut, on the
scale of log odds: a logistic curve on the other half of the sample tells good from bad by the mean. So a weight is how much likelier
than not a document is one of the target, zero being the cut, and Gumbel noise, whose spread is about one, decides between documents of like
weight. The k largest sums of log weight and noise are k documents drawn without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warehaul.llm.common import Batches, fresh, quoted, released, texts, words
from warehaul.session import materialised

BUCKETS = 1 << 14
#: Words and pairs of words seen less often count as one.
MIN_COUNT = 5
#: N-grams a task gathers before it counts them.
CHUNK = 2_000_000
#: Of these, n-grams that are sorted at once.
COUNTED = 1 << 18
#: Bits of a key within its part; the counts of one part are merged in a plain array.
PART_BITS = 20
#: Keys a task holds; a larger model is dealt out in pieces of this size, to which the documents' keys are shuffled.
MODEL_KEYS = 1 << 23
#: Log ratios are held as whole multiples of this fraction, so that sums do not hang on their order.
UNIT = 1 << 16
#: Bound of the labelled sample, in documents; those with the smallest hashes of their ids are taken.
SAMPLE = 20_000
#: Good documents of the sample that the cut may lose.
LOSS = 0.004
SEED = 42
_SMOOTH = 0.5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Course of a word: X for capitals, x for small letters and what is not ASCII, 9 for digits, others as they are.
_COURSE = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)
_REPEATED = np.uint64(crc32(b"repeated"))


_SMALL, _CAPITALISED = crc32(b"x"), crc32(b"Xx")


def _form(word: bytes) -> int:
    """Hash of the form of a word; the common forms are told without spelling them out."""
    if word.isalpha():
        if word.islower():
            return _SMALL
        if len(word) > 1 and word.istitle():
            return _CAPITALISED
    return crc32(_RUN.sub(rb"\1", word.translate(_COURSE)))


class Forms(dict):
    """Hash of the word and of its form, by word; the words of one task are kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = crc32(word) << 32 | _form(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def ngrams(text: str | None, bits: int, buckets: int, forms: Forms) -> tuple[np.ndarray, np.ndarray]:
    """Key (``bits`` bits) of every word and pair of neighbouring ones, and the bucket of every word form and pair of forms."""
    found = words(text)
    both = np.fromiter(map(forms.__getitem__, found), np.uint64, len(found))
    word, one = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    one[1:][word[1:] == word[:-1]] = _REPEATED
    with np.errstate(over="ignore"):
        two = one[:-1] * _MULTIPLIER + one[1:]
        mixed = np.concatenate((one, two)) * _MULTIPLIER
        pairs = (word[:-1] * _MULTIPLIER ^ (word[1:] + np.uint64(1))) * _MULTIPLIER
        hashed = np.concatenate((word * _MULTIPLIER, pairs ^ pairs >> np.uint64(29))) >> np.uint64(64 - bits)
    return hashed.view(np.int64), ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def key_bits(docs: DataFrame) -> int:
    """Bits of a key: about as many keys as the texts have bytes, several times their n-grams."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return min(40, max(PART_BITS + 4, int(size).bit_length()))


def packed_numbers(values: np.ndarray, ends: np.ndarray, groups: int = 5) -> list[bytes]:
    """Numbers in groups of seven bits, ``groups`` at most, as one blob for each run of ``values`` that ends at ``ends``."""
    v = values.astype(np.uint64)
    sizes = 1 + sum((v >= np.uint64(1 << 7 * j)).astype(np.int64) for j in range(1, groups))
    after = np.cumsum(sizes)
    out = np.zeros(int(after[-1]) if len(after) else 0, np.uint8)
    for j in range(groups):
        has = sizes > j
        out[(after - sizes)[has] + j] = (v[has] >> np.uint64(7 * j) & np.uint64(127)).astype(np.uint8) | (sizes[has] > j + 1) * np.uint8(128)
    edges = np.concatenate(([0], after))[np.concatenate(([0], ends))]
    return [out[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def unpacked_numbers(blob: bytes) -> np.ndarray:
    """The inverse of ``packed_numbers`` for one blob."""
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(raw < 128)[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


@dataclass
class Model:
    """Log ratios in units: of forms by bucket, of the rare keys, and ``table`` with those of the other keys by part.

    ``cut`` and ``slope`` turn means into log odds; without labels of both kinds there is no cut, and all weigh alike.
    """

    forms: np.ndarray
    bits: int
    table: DataFrame | None = None
    size: int = 0
    rare: int = 0
    cut: float | None = None
    slope: float = 0.0
    shared: Broadcast | None = None

    def lookup(self, spark: SparkSession) -> Broadcast:
        """All ratios by key, packed once and shared by the passes over the texts until ``release``."""
        if self.shared is None:
            rows = [] if self.table is None else list(zip(*(c.to_pylist() for c in self.table.toArrow().columns), strict=True))
            self.shared = spark.sparkContext.broadcast(Lookup(rows, self.rare))
        return self.shared

    def release(self) -> None:
        if self.shared is not None:
            self.shared.destroy()
            self.shared = None


def _labelled(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids with their class; ids with labels of both kinds count as bad."""
    named = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).dropna()
    one = named.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


_COUNTS = "part int, keys binary, raw binary, target binary"
_MERGED = (
    "part int, keys binary, raw binary, target binary, kinds bigint, raw_sum bigint, target_sum bigint, rare_raw bigint, rare_target bigint"
)


def counts(docs: DataFrame, taken: DataFrame, bits: int, buckets: int, min_count: int) -> DataFrame:
    """How often each key occurs over all documents and over the good labelled ones, one row per part of the keys.

    ``keys`` are the lower bits of the keys seen ``min_count`` times or more, ascending, ``raw`` and ``target`` their counts, each
    as packed numbers of 32 or 64 bits; the others are summed in ``rare_raw`` and ``rare_target``. Part -1 holds the buckets of forms.
    """

    def counted(waiting: list[np.ndarray], wanted: list[np.ndarray]) -> Batches:
        """Empties both lists; whole parts are counted at a time, so that no array but that of the keys is large."""
        keys, some = np.concatenate(waiting), np.concatenate([np.zeros(0, np.int64), *wanted])
        waiting.clear()
        wanted.clear()
        wide = max(1, (1 << bits - PART_BITS) * COUNTED // len(keys)) << PART_BITS
        for low in range(0, 1 << bits, wide):
            own = keys[(keys >= low) & (keys < low + wide)]
            if len(own):
                yield parts_of(own, some[(some >= low) & (some < low + wide)])

    def parts_of(keys: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        """One row per part: differences of keys, counts, and counts of the target with the differences of their places."""
        keys, raw = np.unique(keys, return_counts=True)
        target = np.zeros(len(keys), np.int64)
        some, n = np.unique(some, return_counts=True)
        target[np.searchsorted(keys, some)] = n
        part = keys >> PART_BITS
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(keys))
        firsts = np.concatenate(([0], ends[:-1]))
        low = keys & (1 << PART_BITS) - 1
        steps = np.diff(low, prepend=0)
        steps[firsts] = low[firsts]
        held = np.flatnonzero(target)
        held_ends = np.searchsorted(held, ends)
        places = held - np.repeat(firsts, np.diff(np.concatenate(([0], held_ends))))
        both = np.stack((places, target[held]), axis=1).ravel()
        blobs = [packed_numbers(steps, ends), packed_numbers(raw, ends), packed_numbers(both, 2 * held_ends)]
        return pa.RecordBatch.from_arrays([pa.array(part[firsts], pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names)

    names = ["part", "keys", "raw", "target"]

    def run(batches: Batches) -> Batches:
        raw, target, forms = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), Forms()
        waiting, wanted, size = [], [], 0
        for batch in batches:
            for text, good in zip(texts(batch, 0), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                hashed, places = ngrams(text, bits, buckets, forms)
                found = np.bincount(places, minlength=buckets)
                raw += found
                waiting.append(hashed)
                size += len(hashed)
                if good:
                    target += found
                    wanted.append(hashed)
                if size >= CHUNK:
                    yield from counted(waiting, wanted)
                    size = 0
        if size:
            yield from counted(waiting, wanted)
        place = np.flatnonzero(raw)
        if len(place):
            held = np.flatnonzero(target[place])
            both = np.stack((held, target[place][held]), axis=1).ravel()
            columns = (np.diff(place, prepend=0), raw[place], both)
            blobs = [packed_numbers(c, np.array([len(c)]))[0] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names)

    def merged(part: int, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        kept = np.flatnonzero(raw >= (min_count if part >= 0 else 1))
        sums = [int(raw[kept].sum()), int(target[kept].sum())]
        rare = [int(raw.sum()) - sums[0], int(target.sum()) - sums[1]]
        blobs = [kept.astype("<i4").tobytes(), raw[kept].astype("<i8").tobytes(), target[kept].astype("<i8").tobytes()]
        row = (part, *blobs, len(kept), *sums, *rare)
        kinds = (pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 5)
        merged_names = [c.split()[0] for c in _MERGED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], merged_names)

    def merge(batches: Batches) -> Batches:
        now = None
        raw, target = (np.zeros(max(buckets, 1 << PART_BITS), np.int64) for _ in range(2))
        for batch in batches:
            for part, keys, n, both in zip(*(texts(batch, i) for i in range(4)), strict=True):
                if part != now:
                    if now is not None:
                        yield merged(now, raw, target)
                        raw[:] = 0
                        target[:] = 0
                    now = part
                key, pairs = np.cumsum(unpacked_numbers(keys)), unpacked_numbers(both).reshape(-1, 2)
                raw[key] += unpacked_numbers(n)
                target[key[pairs[:, 0]]] += pairs[:, 1]
        if now is not None:
            yield merged(now, raw, target)

    joined = docs.join(F.broadcast(taken), "doc_id", "left").select("text", "good")
    return joined.mapInArrow(released(run), _COUNTS).repartition("part").sortWithinPartitions("part").mapInArrow(released(merge), _MERGED)


def log_ratios(raw: np.ndarray, target: np.ndarray, raw_sum: int, target_sum: int, kinds: int) -> np.ndarray:
    """Smoothed log(target / raw) in units."""
    share = lambda n, whole: np.log((n + _SMOOTH) / (whole + _SMOOTH * kinds))
    return np.rint((share(target, target_sum) - share(raw, raw_sum)) * UNIT).astype(np.int32)


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, loss: float = LOSS,
    min_count: int = MIN_COUNT, model_keys: int = MODEL_KEYS,
) -> Model:
    """Models over ``docs`` (``doc_id``, ``text``) and the curve that gives the weights.

    The raw counts cover all documents and stay on the executors, as do their log ratios; totals and the buckets of forms come to the driver. The sample
    is bounded by ``sample`` ids. Half of it is counted, on the other half the curve is fitted. The cut is the least of three: the mean
    log ratio below which ``loss`` of the good ones lies, that which splits the labelled ones with the fewest errors, and the middle of the curve.
    """
    bits = key_bits(docs)
    nothing = Model(np.zeros(buckets, np.int32), bits)
    taken = _labelled(labels, sample)
    rows = taken.collect()
    if {r["good"] for r in rows} != {True, False}:
        return nothing
    taken = docs.sparkSession.createDataFrame(rows, taken.schema)
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    found = materialised(counts(plain, taken.withColumn("good", F.col("good") & half), bits, buckets, min_count), "counts")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "raw_sum", "target_sum", "rare_raw", "rare_target")]
    size, raw_sum, target_sum, rare_raw, rare_target = found.filter("part >= 0").agg(*sums).first()
    if not target_sum + rare_target:
        return nothing
    totals = (raw_sum + rare_raw, target_sum + rare_target, size + (rare_raw > 0))
    one = found.filter("part < 0").first()
    place, raw, target = (np.frombuffer(one[c], t) for c, t in (("keys", "<i4"), ("raw", "<i8"), ("target", "<i8")))
    all_raw, all_target = np.zeros(buckets), np.zeros(buckets)
    all_raw[place], all_target[place] = raw, target
    forms = log_ratios(all_raw, all_target, all_raw.sum(), all_target.sum(), buckets)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, keys, raw, target in zip(*(texts(batch, i) for i in range(4)), strict=True):
                found = log_ratios(np.frombuffer(raw, "<i8"), np.frombuffer(target, "<i8"), *totals)
                columns = [pa.array([part], pa.int32()), pa.array([keys], pa.binary()), pa.array([found.astype("<i4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "ratios"])

    table = found.filter("part >= 0 and kinds > 0").select("part", "keys", "raw", "target")
    table = table.mapInArrow(run, "part int, keys binary, ratios binary")
    rare = int(log_ratios(np.array([rare_raw]), np.array([rare_target]), *totals)[0])
    model = Model(forms, bits, table, size, rare)
    held = plain.join(F.broadcast(taken.filter(~half)), "doc_id")
    seen = means(held, model, "mean", model_keys).groupBy("doc_id").agg(F.min("mean").alias("mean"), F.first("good").alias("good"))
    model.cut, model.slope = curve([(r["mean"] or 0.0, r["good"]) for r in seen.collect()], loss)
    return model


def curve(seen: list[tuple[float, bool]], loss: float) -> tuple[float | None, float]:
    """Cut and slope of the log odds over the means of labelled documents.

    The slope is that of a logistic curve whose goals are drawn in from 0 and 1 as if each class had one more document of the other,
    so that it is finite also where a cut tells the classes apart.
    """
    if not any(good for _, good in seen):
        return None, 0.0
    seen = sorted(seen)
    mean, is_good = np.array([m for m, _ in seen]), np.array([g for _, g in seen])
    good, bad = np.sort(mean[is_good]), np.sort(mean[~is_good])
    at = np.unique(mean)
    errors = np.searchsorted(good, at, "left") + len(bad) - np.searchsorted(bad, at, "left")
    goals = np.where(is_good, (len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2))
    width = float(mean.std()) or 1.0
    x = np.stack((np.ones(len(mean)), (mean - mean.mean()) / width), axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (goals - p) - 1e-6 * beta)
        beta += step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    even = float(mean.mean()) - width * float(beta[0] / beta[1]) if beta[1] > 0 else np.inf
    cut = min(at[int(np.argmin(errors))], good[int(loss * len(good))], even)
    return float(cut), max(0.0, float(beta[1])) / width


class Lookup:
    """Ratios of the keys of some parts. Keys are spread evenly, so a table of their upper bits leads to within a few places."""

    def __init__(self, rows: list[tuple], rare: int) -> None:
        rows = sorted(rows)
        parts = [np.int64(p) << PART_BITS | np.frombuffer(k, "<i4").astype(np.int64) for p, k, _ in rows]
        keys = np.concatenate([np.zeros(0, np.int64), *parts])
        self.rare = rare
        self.n = len(keys)
        if not self.n:
            return
        self.first, self.last = int(keys[0]), int(keys[-1])
        span = self.last - self.first + 1
        self.shift = max(0, span.bit_length() - min(22, self.n.bit_length()))
        steps = self.first + (np.arange((span >> self.shift) + 2, dtype=np.int64) << self.shift)
        self.edges = np.searchsorted(keys, steps).astype(np.int32)
        narrow = np.uint32 if self.last < (1 << 32) - 1 else np.int64
        self.keys = np.append(keys, np.iinfo(narrow).max).astype(narrow)
        self.ratios = np.frombuffer(b"".join(r for _, _, r in rows) + np.int32(rare).tobytes(), "<i4")

    def total(self, keys: np.ndarray) -> int:
        """Sum of the ratios of ``keys``; those it lacks are rare."""
        if not self.n:
            return self.rare * len(keys)
        inside = np.clip(keys, self.first, self.last)
        at = self.edges[(inside - self.first) >> self.shift]
        below = np.flatnonzero(self.keys[at] < inside)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < inside[below]]
        return int(np.where(self.keys[at] == keys, self.ratios[at], self.rare).sum(dtype=np.int64))


def means(docs: DataFrame, model: Model, name: str, model_keys: int = MODEL_KEYS) -> DataFrame:
    """``docs`` with the mean log ratio of the n-grams of ``text`` as column ``name``, null without n-grams.

    A model of up to ``model_keys`` keys goes to every task. The keys of a larger one are dealt out in pieces of that size, and each
    document's keys go to the pieces that hold them; sums of whole units make both ways give the same.
    """
    place = docs.columns.index("text")
    bits, buckets, forms_ratio = model.bits, len(model.forms), model.forms
    pieces = max(1, -(-model.size // model_keys))
    if pieces == 1:
        shared = model.lookup(docs.sparkSession)

        def whole(batches: Batches) -> Batches:
            forms, lookup = Forms(), shared.value
            for batch in batches:
                found = []
                for text in texts(batch, place):
                    keys, places = ngrams(text, bits, buckets, forms)
                    total = int(forms_ratio[places].sum(dtype=np.int64)) + lookup.total(keys)
                    found.append(total / UNIT / (len(keys) + len(places)) if len(keys) else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

        return docs.mapInArrow(released(whole), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    return _means_in_pieces(docs, model, name, pieces)


def _means_in_pieces(docs: DataFrame, model: Model, name: str, pieces: int) -> DataFrame:
    """``means`` for a model that no task holds whole."""
    place = docs.columns.index("text")
    bits, buckets, forms_ratio, rare = model.bits, len(model.forms), model.forms, model.rare
    row, form, n, sent = (fresh([*docs.columns, name], c) for c in ("row", "form", "n", "sent"))
    # parts of the keys in each piece
    wide = -(-(1 << bits - PART_BITS) // pieces)

    def keyed(batches: Batches) -> Batches:
        forms, part, number = Forms(), TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("keys", pa.binary())]))
        for batch in batches:
            rows, totals, sizes, dealt = [], [], [], []
            for text in texts(batch, place):
                keys, places = ngrams(text, bits, buckets, forms)
                rows.append(part << 40 | number)
                number += 1
                totals.append(int(forms_ratio[places].sum(dtype=np.int64)))
                sizes.append(len(keys) + len(places))
                keys = np.sort(keys)
                of, firsts = np.unique((keys >> PART_BITS) // wide, return_index=True)
                ends = np.append(firsts, len(keys))[1:]
                dealt.append([{"piece": int(p), "keys": keys[a:b].astype("<i8").tobytes()} for p, a, b in zip(of, firsts, ends, strict=True)])
            made = [pa.array(c, t) for c, t in ((rows, pa.int64()), (totals, pa.int64()), (sizes, pa.int64()), (dealt, kind))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, row, form, n, sent])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent_kind = f"{quoted(row)} bigint, {quoted(form)} bigint, {quoted(n)} bigint, {quoted(sent)} array<struct<piece:int,keys:binary>>"
    rows = materialised(docs.mapInArrow(keyed, f"{schema}, {sent_kind}"), "keys")
    dealt = rows.select(F.col(quoted(row)).alias("row"), F.inline(quoted(sent)))
    # each piece is cut in salts; the model's rows come before the documents' keys in each
    salts = max(1, docs.sparkSession.sparkContext.defaultParallelism // pieces)
    payload = dealt.select("piece", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "row", "keys", F.lit(None).cast("binary").alias("ratios"))
    own = model.table.select(
        F.floor(F.col("part") / wide).cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), F.lit(0).alias("kind"),
        F.col("part").cast("bigint").alias("row"), "keys", "ratios",
    )

    def added(batches: Batches) -> Batches:
        now, held, lookup = None, [], None
        for batch in batches:
            out = defaultdict(int)
            for piece, salt, kind, number, keys, ratios in zip(*(texts(batch, i) for i in range(6)), strict=True):
                if (piece, salt) != now:
                    now, held, lookup = (piece, salt), [], None
                if kind == 0:
                    held.append((number, keys, ratios))
                    continue
                if lookup is None:
                    lookup, held = Lookup(held, rare), []
                out[number] += lookup.total(np.frombuffer(keys, "<i8"))
            columns = [pa.array(list(c), pa.int64()) for c in (out.keys(), out.values())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "total"])

    met = own.unionByName(payload).repartition("piece", "salt").sortWithinPartitions("piece", "salt", "kind")
    sums = met.mapInArrow(added, "row bigint, total bigint").groupBy(F.col("row").alias("of")).agg(F.sum("total").alias("total"))
    joined = rows.join(sums, F.col(quoted(row)) == F.col("of"), "left")
    units = F.col(quoted(form)) + F.coalesce("total", F.lit(0))
    mean = F.when(F.col(quoted(n)) > 0, units.cast("double") / F.lit(float(UNIT)) / F.col(quoted(n)))
    return joined.select(*map(quoted, docs.columns), mean.alias(name))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on ``key`` and ``seed`` only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def top_k(scored: DataFrame, key: str, ties: list[str], k: int, bins: int = 4096) -> tuple[float, tuple | None]:
    """The k-th largest key as (threshold, last tied row that is still in, by ``ties`` ascending).

    Counts rows in bins of the key's range and looks closer at the bin that holds the k-th one until its keys
    are equal; only the counts of the bins come to the driver. Rows above the threshold are in; of those equal
    to it, rows up to the returned one are in (None: all of them).
    """
    value = F.col(key)
    low, high = scored.agg(F.min(value), F.max(value)).first()
    wanted = k
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            # the range holds a few neighbouring doubles
            counts = [
                (r[0], r[0], r[1])
                for r in scored.filter(value.between(low, high)).groupBy(value).count().orderBy(value.desc()).collect()
            ]
        else:
            place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
            counts = [
                (r["a"], r["b"], r["n"])
                for r in scored.filter(value.between(low, high))
                .groupBy(place.alias("place"))
                .agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("n"))
                .orderBy(F.desc("place"))
                .collect()
            ]
        for low, high, n in counts:
            if wanted <= n:
                break
            wanted -= n
    equal = scored.filter(value == F.lit(low))
    if equal.count() <= wanted:
        return low, None
    last = equal.select(*ties).orderBy(*ties).limit(wanted).orderBy(*[F.desc(t) for t in ties]).limit(1).first()
    return low, tuple(last)


def select(
    docs: DataFrame, labels: DataFrame, name: str = "kept", buckets: int = BUCKETS, sample: int = SAMPLE,
    loss: float = LOSS, seed: int = SEED, carry: list[str] | None = None, k: int | None = None, model_keys: int = MODEL_KEYS,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``log_weight``, ``gumbel_key`` and ``kept``.

    ``k`` documents are drawn without replacement in proportion to their weights; by default as many as have a weight above the cut, that is
    whose log weight is not below zero. ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``. Clashing names get
    underscores in front. Null and wordless texts have log weight zero. The noise depends on ``doc_id`` and ``seed``; equal keys are
    decided by ``doc_id``; repeated rows are alike in all and so stay or go together with the last tied row. Without labelled rows of both
    kinds that occur in ``docs``, all weigh alike, and every row is kept unless ``k`` is given. An empty table gives no rows.
    """
    carry = list(docs.columns) if carry is None else carry
    weight, key, kept = (fresh(carry, n) for n in ("log_weight", "gumbel_key", name))
    model = fit(docs, labels, buckets, sample, loss, model_keys=model_keys)
    slim = docs.select(*[quoted(c) for c in dict.fromkeys([*carry, "doc_id", "text"])])
    log_weight = F.lit(0.0)
    if model.cut is not None:
        slim = means(slim, model, weight, model_keys)
        log_weight = F.coalesce((F.col(quoted(weight)) - F.lit(model.cut)) * F.lit(model.slope), F.lit(0.0))
    scored = slim.withColumn(weight, log_weight).select(*[quoted(c) for c in dict.fromkeys([*carry, "doc_id", weight])])
    scored = materialised(scored.withColumn(key, F.col(quoted(weight)) + gumbel(F.col("doc_id"), seed)), "weighed")
    model.release()
    out = [quoted(c) for c in (*carry, weight, key)]
    if k is None:
        k = scored.filter(F.col(quoted(weight)) >= 0).count()
    if k == 0 or k >= scored.count():
        return scored.select(*out, F.lit(k > 0).alias(kept))
    least, last = top_k(scored, key, ["doc_id"], k)
    value = F.col(quoted(key))
    inside = value > F.lit(least)
    tied = value == F.lit(least)
    if last is not None:
        # nulls sort first
        tied &= F.lit(True) if last[0] is None else F.coalesce(F.col("doc_id") <= F.lit(last[0]), F.lit(True))
    return scored.select(*out, (inside | tied).alias(kept))
