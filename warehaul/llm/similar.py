"""Texts whose word shingles overlap: wide SimHash fingerprints, positional bytes, count filter, exact check.

A bit of two fingerprints of shingle sets with Jaccard similarity s differs with chance acos(2s / (1 + s)) / pi.
At s = 0.8 that is 0.15, so 155 of 1024 bits and 94 of 128 bytes differ, and no key can be free of misses as
for a few bits of 64. A posting here is the value at three byte positions; six permutations of the positions
give 252 of them. Two texts at s = 0.8 share 4.4 postings on average and none in one case of about forty
(at 0.85 in one of some thousand). Pairs that meet are counted by shared positional bytes and differing bits, and
what is left is decided by the exact similarity of the shingle sets, so nothing below s is ever linked.

No list emits all its pairs. Lists of two give their pair. Of the longer ones, one in ``STARRED`` links its members to one of
them, as a star, and all name their members, the crowd. The links give components. Shingles that no other text of the crowd has
then bound what a text may share: a text that has less than ``s`` of its shingles in common is like no other and goes, and two
texts with c in common of each one's n meet only where (1 + s) / s * c is at least the sum of their n. What is left meets
once more by all keys, with fingerprints and roots at hand, so that only pairs that pass the counts and join two components
leave a task. Texts whose numbers of shingles forbid the similarity never meet. Lists of unlike texts hold N / 2^24 of them;
from ``MANY`` texts on a posting is four bytes and there are as many more of them as the same recall needs.

Postings travel packed, some five bytes each: sorted keys as differences, texts as places in their batch, sizes in
a byte. A key with more than ``HOT`` members in one batch is linked where it is; only one member goes to the key's part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from warehaul.llm.common import Batches, per_batch, released, texts, words
from warehaul.llm.components import components
from warehaul.llm.resample import packed_numbers, unpacked_numbers
from warehaul.session import materialised

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, a multiple of 64.
WIDTH = 1024
#: Number of texts from which postings are four bytes wide, and the permutations for three and for four.
MANY = 1 << 26
PERMUTATIONS = {3: 6, 4: 29}
#: Members of a key in one batch that are linked there.
HOT = 64
#: Postings of a part, which one task unpacks at a time, and texts of a batch.
PART_POSTINGS = 1 << 23
BATCH = 1 << 14
#: One in so many of the lists of more than two gives stars; the others only name their members.
STARRED = 6
#: Numbers of a block in which members are named.
BLOCK = 1 << 14
#: Shingles, and postings of the crowd, that one task counts or compares at a time, and pairs that are compared at once.
CROWD_SHINGLES = 1 << 19
CROWD_POSTINGS = 1 << 16
PAIRS = 1 << 14
#: Steps of the size code in the similarity; codes of two sizes that allow it differ by one more at most.
SIZE_STEPS = 4
#: Postings that are sorted at once, and shingles of a batch of sets; arrays of a task stay a few MB each.
RANGE = 1 << 18
#: Size code of a member that stands for the others of its batch.
STANDS_FOR = 255
#: Standard deviations that a pair at the similarity may lie beyond the mean of the counts.
SLACK = 3.5
#: Class of the texts without words.
WORDLESS = 0


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles of ``size`` words, A-Z in lower case; a shorter text is one."""
    found = [w.lower() for w in words(text)]
    if len(found) < size:
        return np.array([xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - size + 1]
    spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(starts)))


def _mixed(values: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned values."""
    with np.errstate(over="ignore"):
        values = values + np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = WIDTH) -> bytes:
    """SimHash of ``width`` bits of a set of hashes."""
    salts = _mixed(np.arange(width // 64, dtype=np.uint64))
    counts = np.zeros(width, np.int64)
    for low in range(0, len(hashes), 255):  # a byte holds the count of 255
        bits = np.unpackbits(_mixed(hashes[low : low + 255, None] ^ salts).view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def text_class(text: Column) -> Column:
    """Equal for equal texts; all texts without words are one class."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(WORDLESS)).otherwise(F.xxhash64(text))


def _places(width: int, permutations: int, key_bytes: int) -> np.ndarray:
    """Byte positions of every posting key."""
    rng, n = np.random.Generator(np.random.PCG64(42)), width // 8
    used = n // key_bytes * key_bytes
    return np.concatenate([rng.permutation(n)[:used].reshape(-1, key_bytes) for _ in range(permutations)])


def _classes(docs: DataFrame, size: int, width: int) -> DataFrame:
    """``num``, ``class``, ``fp`` and the number of shingles of every text with words, once per class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, counts = [], []
        for text in texts(batch, 1):
            found = shingles(text, size)
            prints.append(fingerprint(found, width))
            counts.append(len(found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64())], ["class", "fp", "n"]
        )

    plain = docs.select("class", "text").filter(F.col("class") != WORDLESS)
    once = plain.mapInArrow(released(per_batch(run)), "class bigint, fp binary, n bigint").dropDuplicates(["class"])
    return materialised(once.withColumn("num", F.monotonically_increasing_id()), "classes")


def _ranges(keys: np.ndarray, edges: list[int]) -> Iterator[np.ndarray]:
    """Places of the keys from each edge to the next, range by range; empty ranges are left out."""
    for low, high in pairwise(edges):
        at = np.flatnonzero((keys >= low) & (keys < high))
        if len(at):
            yield at


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each once."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[once], v[once]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))[: len(keys)]
    return starts, np.diff(np.append(starts, len(keys)))


def _postings(classes: DataFrame, places: np.ndarray, similarity: float, parts: int, hot: int) -> DataFrame:
    """Packed postings: one row per batch of texts and part of the keys, and one per batch and hot key.

    ``steps`` are differences of sorted keys, ``members`` the distances of the texts' numbers from ``base``, ``sizes``
    their size codes. Parts from ``parts`` on hold one hot key each row, and deal them out evenly.
    """
    bits = 8 * places.shape[1] + int(len(places) - 1).bit_length()
    mask, odd = np.uint64((1 << bits) - 1), np.uint64(0x9E3779B97F4A7C15)

    def packed(nums: np.ndarray, values: np.ndarray, codes: np.ndarray) -> Batches:
        keys = np.zeros((len(places), len(nums)), np.uint64)
        for number, (key, place) in enumerate(zip(keys, places, strict=True)):
            for byte in place:
                key <<= np.uint64(8)
                key |= values[:, byte]
            key |= np.uint64(number << 8 * places.shape[1])
            # one to one on so many bits, so that equal ranges of keys hold like numbers of postings
            key *= odd
            key &= mask
            key ^= key >> np.uint64(bits // 2)
            key *= odd
            key &= mask
        keys = keys.ravel()
        # whole parts at a time
        wide = max(1, parts * RANGE // len(keys))
        firsts = [*range(0, parts, wide), parts]
        for at in _ranges(keys, [-(-(first << bits) // parts) for first in firsts]):
            yield from ranged(nums, keys[at], at % len(nums), codes)

    def ranged(nums: np.ndarray, keys: np.ndarray, held: np.ndarray, codes: np.ndarray) -> Batches:
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], held[order]
        sizes = codes[held]
        rows = []
        starts, lengths = _runs(keys)
        many = np.flatnonzero(lengths > hot)
        if len(many):
            staying = np.ones(len(keys), bool)
            for start, n in zip(starts[many].tolist(), lengths[many].tolist(), strict=True):
                own = held[start : start + n]
                spread = int(_mixed(keys[start : start + 1] ^ np.uint64(nums[0]))[0] % np.uint64(parts))
                step = packed_numbers(keys[start : start + 1], np.array([1]), 9)[0]
                rows.append((parts + spread, step, own.astype("<u2").tobytes(), sizes[start : start + n].tobytes()))
                staying[start + 1 : start + n] = False
            sizes[starts[many]] = STANDS_FOR
            keys, held, sizes = keys[staying], held[staying], sizes[staying]
        part = (keys * np.uint64(parts) >> np.uint64(bits)).astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(keys))
        firsts = np.concatenate(([0], ends[:-1]))
        steps = np.diff(keys, prepend=np.uint64(0))
        steps[firsts] = keys[firsts]
        away = (nums - nums[0])[held].astype("<u2")
        blobs = packed_numbers(steps, ends, 9)
        for first, end, step in zip(firsts.tolist(), ends.tolist(), blobs, strict=True):
            rows.append((int(part[first]), step, away[first:end].tobytes(), sizes[first:end].tobytes()))
        for low in range(0, len(rows), 256):
            some = list(zip(*rows[low : low + 256], strict=True))
            base = pa.array(np.full(len(some[0]), nums[0]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[0], pa.int32()), base, *(pa.array(c, pa.binary()) for c in some[1:])],
                ["part", "base", "steps", "members", "sizes"],
            )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            nums = batch.column(0).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(nums), -1)
            codes = np.log(batch.column(2).to_numpy()) * (SIZE_STEPS / -np.log(similarity))
            codes = np.minimum(np.rint(codes), STANDS_FOR - 1).astype(np.uint8)
            order = np.argsort(nums)
            low = 0
            while low < len(nums):
                # distances from the first number take two bytes, also where a batch spans two files
                high = min(low + BATCH, int(np.searchsorted(nums[order], nums[order[low]] + (1 << 16))))
                some = order[low:high]
                yield from packed(nums[some], values[some], codes[some])
                low = high

    schema = "part int, base bigint, steps binary, members binary, sizes binary"
    return classes.select("num", "fp", "n").mapInArrow(released(run), schema)


def _met(postings: DataFrame, parts: int) -> DataFrame:
    """Pairs of the lists of two and of the stars, as ``u`` and ``v``; and the members of longer lists, as ``base`` and their
    distances from it, each once for a task and block of numbers."""

    def batches_of(u: np.ndarray, v: np.ndarray) -> Batches:
        for low in range(0, len(u), 100_000):
            cut = slice(low, low + 100_000)
            none = [pa.nulls(len(u[cut]), t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(u[cut]), pa.array(v[cut]), *none], ["u", "v", "base", "members"])

    def named(nums: np.ndarray) -> Batches:
        nums = np.unique(nums)
        starts, lengths = _runs(nums // BLOCK)
        for low in range(0, len(starts), 256):
            cut = slice(low, low + 256)
            ends = zip(starts[cut].tolist(), (starts + lengths)[cut].tolist(), strict=True)
            blobs = [(nums[a:b] % BLOCK).astype("<u2").tobytes() for a, b in ends]
            none = pa.nulls(len(blobs), pa.int64())
            base = pa.array(nums[starts[cut]] // BLOCK * BLOCK)
            yield pa.RecordBatch.from_arrays([none, none, base, pa.array(blobs, pa.binary())], ["u", "v", "base", "members"])

    def stars(keys: np.ndarray, nums: np.ndarray, sizes: np.ndarray, all_long: bool) -> Batches:
        """The lists range by range of their keys; a pair comes once however many of the lists have it."""
        low, high = int(keys.min()), int(keys.max())
        wide = max(1, (high - low + 1) * RANGE // len(keys))
        pairs, members = [], []
        for at in _ranges(keys, [*range(low, high + 1, wide), high + 1]):
            order = at[np.argsort(keys[at], kind="stable")]
            u, v, own = ranged(keys[order], nums[order], sizes[order].astype(np.int64), all_long)
            pairs.append((u, v))
            members.append(own)
        yield from named(np.concatenate(members))
        yield from batches_of(*_distinct(*map(np.concatenate, zip(*pairs, strict=True))))

    def ranged(keys: np.ndarray, nums: np.ndarray, sizes: np.ndarray, all_long: bool) -> tuple[np.ndarray, ...]:
        """Pairs of sorted lists, and the members of those that hold more than one pair."""
        starts, lengths = _runs(keys)
        stands = np.repeat(np.logical_or.reduceat(sizes == STANDS_FOR, starts), lengths)
        # members that may meet another one of the list, which then is so for a neighbour by size
        order = np.lexsort((sizes, keys))
        near = (keys[1:] == keys[:-1]) & (np.diff(sizes[order]) <= SIZE_STEPS + 1)
        meets = (stands & (np.repeat(lengths, lengths) > 1)) | all_long
        meets[order[1:]] |= near
        meets[order[:-1]] |= near
        keys, nums, sizes, stands = keys[meets], nums[meets], sizes[meets], stands[meets]
        if not len(keys):
            return nums, nums, nums
        starts, lengths = _runs(keys)
        heads = np.repeat(starts, lengths)
        long = (np.repeat(lengths, lengths) > 2) | stands | all_long
        linked = ~long | (_mixed(keys.astype(np.uint64)) % np.uint64(STARRED) == 0)
        either = (sizes == STANDS_FOR) | (sizes[heads] == STANDS_FOR)
        linked &= (either | (np.abs(sizes - sizes[heads]) <= SIZE_STEPS + 1)) & (nums != nums[heads])
        a, b = nums[heads[linked]], nums[linked]
        return *_distinct(np.minimum(a, b), np.maximum(a, b)), np.unique(nums[long])

    def gathered(waiting: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
        waiting.clear()
        return columns

    def run(batches: Batches) -> Batches:
        now, waiting = None, []
        for batch in batches:
            for i, (part, base) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                steps, members, sizes = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                keys, nums = np.cumsum(unpacked_numbers(steps)), np.frombuffer(members, "<u2").astype(np.int64) + base
                row = (keys if part < parts else np.repeat(keys, len(nums)), nums, np.frombuffer(sizes, np.uint8))
                if part >= parts:
                    yield from stars(*row, True)
                    continue
                if part != now and waiting:
                    yield from stars(*gathered(waiting), False)
                now = part
                waiting.append(row)
        if waiting:
            yield from stars(*gathered(waiting), False)

    dealt = postings.repartition("part").sortWithinPartitions("part", "base")
    return dealt.mapInArrow(released(run), "u bigint, v bigint, base bigint, members binary")


def _crowd(found: DataFrame) -> DataFrame:
    """``num`` of the members that ``_met`` names, each once."""

    def run(batches: Batches) -> Batches:
        now, seen = None, np.zeros(BLOCK, bool)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen) + now)], ["num"])

        for batch in batches:
            for base, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now not in (None, base):
                    yield block()
                    seen[:] = False
                now = base
                seen[np.frombuffer(members, "<u2")] = True
        if now is not None:
            yield block()

    members = found.filter("base IS NOT NULL").select("base", "members")
    return members.repartition("base").sortWithinPartitions("base").mapInArrow(released(run), "num bigint")


def _bounds(similarity: float, width: int) -> tuple[float, float]:
    """Equal bytes at least, and differing bits at most, of a pair at the similarity."""
    apart = acos(2 * similarity / (1 + similarity)) / pi
    same = (1 - apart) ** 8
    least = width / 8 * same - SLACK * sqrt(width / 8 * same * (1 - same))
    return least, width * apart + SLACK * sqrt(width * apart * (1 - apart))


def _counted(pairs: DataFrame, classes: DataFrame, similarity: float, width: int) -> DataFrame:
    """Distinct pairs that pass the counts, with their differing bits."""
    least, most = _bounds(similarity, width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, width // 8)
            for i in (2, 3)
        )
        bits = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        passed = pa.array(((a == b).sum(axis=1) >= least) & (bits <= most))
        out = [batch.column(0), batch.column(1), pa.array(bits)]
        return pa.RecordBatch.from_arrays(out, ["u", "v", "bits"]).filter(passed)

    left = classes.select(F.col("num").alias("u"), F.col("fp").alias("a"), F.col("n").alias("m"))
    right = classes.select(F.col("num").alias("v"), F.col("fp").alias("b"), "n")
    near = F.least("m", "n") >= F.greatest("m", "n") * F.lit(similarity - 1e-9)
    met = pairs.distinct().join(left, "u").join(right, "v").filter(near).select("u", "v", "a", "b")
    return met.mapInArrow(released(per_batch(run)), "u bigint, v bigint, bits bigint")


def _sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``num`` and shingles of the texts in ``ids``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            low, found, held = 0, [], 0
            for place, text in enumerate(texts(batch, 1)):
                found.append(shingles(text, size).view(np.int64))
                held += len(found[-1])
                if held >= RANGE or place == batch.num_rows - 1:
                    nums = batch.column(0).slice(low, len(found))
                    yield pa.RecordBatch.from_arrays([nums, pa.array(found, pa.list_(pa.int64()))], ["num", "shingles"])
                    low, found, held = place + 1, [], 0

    named = classes.select("num", "class").join(ids.distinct(), "num")
    once = docs.select("class", "text").join(named, "class").groupBy("num").agg(F.first("text").alias("text"))
    return materialised(once.mapInArrow(released(run), "num bigint, shingles array<bigint>"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have at least the similarity."""
    left = sets.select(F.col("num").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("num").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b")).cast("bigint")
    # in whole numbers of a millionth, so that a share of exactly the similarity is in
    enough = shared * 1_000_000 >= (F.size("a") + F.size("b") - shared) * round(similarity * 1_000_000)
    return pairs.select("u", "v").distinct().join(left, "u").join(right, "v").filter(enough).select("u", "v")


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    known = roots.toDF(f"{name}_node", f"{name}_known")
    out = df.join(known, F.col(column) == F.col(f"{name}_node"), "left")
    return out.withColumn(name, F.coalesce(f"{name}_known", column)).drop(f"{name}_node", f"{name}_known")


def _alone(sets: DataFrame) -> DataFrame:
    """``num`` and the number of shingles that no other text in ``sets`` has, where there are any.

    Counted by 32 bits of the hashes, so that at most too few are found. A batch sends a shingle once however many of its
    texts have it.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = max(1, -(-total // CROWD_SHINGLES))

    def sent(batches: Batches) -> Batches:
        for batch in batches:
            nums, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(lengths)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(RANGE, len(flat), RANGE)) + 1, [0, len(nums)]))
            for low, high in pairwise(cuts.tolist()):
                hashes = flat[ends[low] - lengths[low] : ends[high - 1]].view(np.uint64).astype(np.uint32)
                owners = np.repeat(nums[low:high], lengths[low:high])
                order = np.argsort(hashes, kind="stable")
                hashes, owners = hashes[order], owners[order]
                starts, n = _runs(hashes)
                hashes, owners = hashes[starts], np.where(n == 1, owners[starts], -1)
                part = (hashes.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                firsts, n = _runs(part)
                spans = list(zip(firsts.tolist(), (firsts + n).tolist(), strict=True))
                blobs = [[c[a:b].tobytes() for a, b in spans] for c in (hashes, owners)]
                columns = [pa.array(part[firsts], pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "hashes", "owners"])

    def single(waiting: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        hashes, owners = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*waiting, strict=True), (np.uint32, np.int64), strict=True))
        order = np.argsort(hashes, kind="stable")
        starts, n = _runs(hashes[order])
        found = owners[order[starts[n == 1]]]
        found, n = np.unique(found[found >= 0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["num", "alone"])

    def counted(batches: Batches) -> Batches:
        now, waiting = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and waiting:
                    yield single(waiting)
                    waiting = []
                now = part
                waiting.append(row)
        if waiting:
            yield single(waiting)

    dealt = sets.mapInArrow(released(sent), "part int, hashes binary, owners binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(counted), "num bigint, alone bigint").groupBy("num").agg(F.sum("alone").alias("alone"))


def _apart(texts: DataFrame, places: np.ndarray, similarity: float, width: int, parts: int) -> DataFrame:
    """Pairs that share a key, pass the counts and join two roots, once each. ``texts``: ``num``, ``root``, ``n``, ``c``, ``fp``.

    Two texts at the similarity share at least s / (1 + s) of the sum of their n, and no more than either one's ``c``.
    """
    parts = max(1, min(parts, -(-texts.count() * len(places) // CROWD_POSTINGS)))
    least, most = _bounds(similarity, width)
    kind = np.dtype([("num", "<i8"), ("root", "<i8"), ("n", "<f8"), ("need", "<f8"), ("fp", "u1", (width // 8,))])

    def sent(batches: Batches) -> Batches:
        for batch in batches:
            rows = np.zeros(batch.num_rows, kind)
            for place, name in enumerate(("num", "root", "n")):
                rows[name] = batch.column(place).to_numpy()
            rows["need"] = batch.column(3).to_numpy() * ((1 + similarity) / similarity) - rows["n"] + 1e-6
            rows["fp"] = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(rows), -1)
            for low in range(0, len(rows), 1024):
                yield from packed(rows[low : low + 1024])

    def packed(rows: np.ndarray) -> Batches:
        keys = np.zeros((len(places), len(rows)), np.uint64)
        for number, (key, place) in enumerate(zip(keys, places, strict=True)):
            key |= np.uint64(number)
            for byte in place:
                key <<= np.uint64(8)
                key |= rows["fp"][:, byte]
        keys, held = keys.ravel(), np.tile(np.arange(len(rows)), len(places))
        part = (_mixed(keys) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        firsts, lengths = _runs(part[order])
        for first, n in zip(firsts.tolist(), lengths.tolist(), strict=True):
            at = order[first : first + n]
            own, places_of = np.unique(held[at], return_inverse=True)
            blobs = [keys[at].tobytes(), places_of.astype("<u2").tobytes(), rows[own].tobytes()]
            columns = [pa.array(part[at[:1]], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "members", "texts"])

    def tested(rows: np.ndarray, a: np.ndarray, b: np.ndarray, number: int) -> Batches:
        """Of the pairs ``a``, ``b`` that meet at the key of this number, those that pass the counts and meet at none before."""
        for low in range(0, len(a), PAIRS):
            x, y = rows[a[low : low + PAIRS]], rows[b[low : low + PAIRS]]
            other = x["fp"] ^ y["fp"]
            passed = (np.bitwise_count(other).sum(axis=1, dtype=np.int64) <= most) & ((other == 0).sum(axis=1) >= least)
            x, y, other = x[passed], y[passed], other[passed]
            new = np.ones(len(x), bool)
            for place in places[:number]:
                new &= other[:, place].any(axis=1)
            u, v = x["num"][new], y["num"][new]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def meeting(waiting: list[tuple[bytes, bytes, bytes]]) -> Batches:
        own = [np.frombuffer(t, kind) for _, _, t in waiting]
        bases = np.cumsum([0, *map(len, own)])[:-1]
        rows = np.concatenate(own)
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _, _ in waiting])
        held = np.concatenate([np.frombuffer(m, "<u2") + base for (_, m, _), base in zip(waiting, bases, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, held = keys[order], held[order]
        starts, lengths = _runs(keys)
        roots = rows["root"][held]
        several = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
        for start, n in zip(starts[several].tolist(), lengths[several].tolist(), strict=True):
            at = held[start : start + n]
            root, size, need = (rows[c][at] for c in ("root", "n", "need"))
            names, counts = np.unique(root, return_counts=True)
            main = root == names[counts.argmax()]
            outside = np.flatnonzero(~main & (need >= size.min()))
            number = int(keys[start] >> np.uint64(8 * places.shape[1]))
            step = max(1, (1 << 20) // n)
            for some in (outside[low : low + step, None] for low in range(0, len(outside), step)):
                may = (root[some] != root) & (size <= need[some]) & (size[some] <= need) & (main | (np.arange(n) > some))
                a, b = np.nonzero(may)
                yield from tested(rows, at[some[a, 0]], at[b], number)

    def run(batches: Batches) -> Batches:
        now, waiting = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and waiting:
                    yield from meeting(waiting)
                    waiting = []
                now = part
                waiting.append(row)
        if waiting:
            yield from meeting(waiting)

    dealt = texts.select("num", "root", "n", "c", "fp").mapInArrow(
        released(sent), "part int, keys binary, members binary, texts binary"
    ).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(run), "u bigint, v bigint")


def linked(
    docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, width: int = WIDTH,
    key_bytes: int | None = None, hot: int = HOT,
) -> DataFrame:
    """``node`` and ``root`` of the classes in ``docs`` (``class``, ``text``) that reach each other through
    links of at least the similarity; classes without a link are left out, and so are null and wordless texts, which are
    ``WORDLESS``. Repeated rows count once. An empty table gives no rows."""
    spark = docs.sparkSession
    classes = _classes(docs, size, width)
    n = classes.count()
    key_bytes = key_bytes or (3 if n < MANY else 4)
    places = _places(width, PERMUTATIONS[key_bytes], key_bytes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(places) // PART_POSTINGS))
    found = materialised(_met(_postings(classes, places, similarity, parts, hot), parts), "postings")
    likely = materialised(_counted(found.filter("u IS NOT NULL").select("u", "v"), classes, similarity, width), "pairs")
    crowd = materialised(_crowd(found), "crowd")
    ends = (likely.select(F.col(c).alias("num")) for c in ("u", "v"))
    sets = _sets(reduce(DataFrame.unionByName, ends, crowd), docs, classes, size)
    # the likeliest link of every text first; then only pairs that are still apart need the exact check
    best = [
        likely.groupBy(a).agg(F.min_by(b, F.struct("bits", b)).alias(b)).select("u", "v") for a, b in (("u", "v"), ("v", "u"))
    ]
    first = materialised(reduce(DataFrame.unionByName, best).distinct(), "pairs")
    links = materialised(_verified(first, sets, similarity), "links")
    roots = components(links)
    rest = likely.select("u", "v").join(first, ["u", "v"], "left_anti")
    # members of longer lists meet unless they share too little with all others or are in one component
    common = classes.join(crowd, "num").join(_alone(sets), "num", "left").withColumn("c", F.expr("n - coalesce(alone, 0)"))
    common = common.filter(F.col("c") >= F.col("n") * F.lit(similarity - 1e-9))
    texts = materialised(_rooted(common, roots, "num", "root").select("num", "root", "n", "c", "fp"), "crowd")
    rest = _rooted(_rooted(rest, roots, "u", "ru"), roots, "v", "rv").filter("ru <> rv").select("u", "v")
    rest = materialised(rest.unionByName(_apart(texts, places, similarity, width, parts)).distinct(), "pairs")
    if not rest.isEmpty():
        more = materialised(_verified(rest, sets, similarity), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    ends = classes.select(F.col("num").alias("node"), F.col("class").alias("node_class"))
    tops = classes.select(F.col("num").alias("root"), F.col("class").alias("root_class"))
    return roots.join(ends, "node").join(tops, "root").selectExpr("node_class AS node", "root_class AS root")
