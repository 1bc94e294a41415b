"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become integers and are sorted by their place on a Hilbert curve through all their dimensions, so that near ones are
neighbours. Runs of the sorted rows are blocks: one Parquet row each, with ids, labels and vectors packed, beside a zone map of least
and greatest value per dimension and label. A search first reads the zone maps alone: interval arithmetic bounds the inner
product of an anchor with any row of a block from both sides, and only blocks whose bounds meet one of the anchor's windows of
scores are read. Anchors and blocks meet in bounded bundles, and each bundle keeps the best few rows per window, so nothing grows
with the square of a group. All scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warehaul.llm.common import Batches, quoted, texts
from warehaul.session import materialised

SCALE = 256
#: Rows of a block, anchors of a bundle, blocks that meet a bundle in one task, zone maps that do.
BLOCK, BUNDLE, RUN, ZONES = 512, 256, 32, 2048
#: Scaled components above this take no part; with up to 32,768 dimensions a hundred times a score then fits 64 bits.
LARGEST = 1 << 20
_LEAST, _MOST = -(1 << 62), 1 << 62
_EXACT = 1 << 53


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (below ``1 << bits`` per dimension), as big-endian bytes.

    Skilling's transform (AIP Conf. Proc. 707, 2004), over all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        q = np.uint32(1 << bit)
        p = q - np.uint32(1)
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inside, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> np.uint32(bit)) & 1 != 0, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(bit)) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _product(up, low) + _product(down, high), _product(up, high) + _product(down, low)


def scaled(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``label`` and ``q`` (floor of ``scale`` times each component) of the rows that take part."""
    q = F.transform(F.col(quoted(vector_column)), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = lambda x: x.isNotNull() & (F.abs(F.lit(scale) * x.cast("double")) < LARGEST)  # noqa: E731  false of NaN and infinity
    vector, label, key = (F.col(quoted(c)) for c in (vector_column, label_column, id_column))
    whole = vector.isNotNull() & label.isNotNull() & key.isNotNull() & F.forall(vector, sound)
    kept = vectors.filter(F.coalesce(whole, F.lit(False)))
    return kept.select(key.cast("bigint").alias("id"), label.cast("bigint").alias("label"), q.cast("array<bigint>").alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones are filled with zeros."""
    sizes = np.array(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, "<i8").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _vector_bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, "<i4").tobytes()


def _vectors(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64).reshape(rows, -1)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


_BLOCKS = "block bigint, ids binary, labels binary, vectors binary, low binary, high binary, label_low bigint, label_high bigint"


def blocked(rows: DataFrame, dims: int, mean: float, deviation: float, bits: int = 2, size: int = BLOCK) -> DataFrame:
    """The blocks of ``rows`` (``id``, ``label``, ``q``) in Hilbert order, with their zone maps; a Parquet table in the shared folder.

    The cells of the curve are ``1 << bits`` per dimension within 1.5 deviations of the mean. Rows are range-partitioned by place and id, so
    that equal vectors, however many, are spread.
    """

    def placed(batches: Batches) -> Batches:
        for batch in batches:
            q = _matrix(batch.column(2), dims)
            cells = np.floor((q - (mean - 1.5 * deviation)) / (3 * deviation or 1) * (1 << bits))
            key = hilbert(np.clip(cells, 0, (1 << bits) - 1), bits) if dims else np.zeros((len(q), 1), np.uint8)
            places = pa.array([k.tobytes() for k in key], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "place"])

    def packed(batches: Batches) -> Batches:
        part, number = TaskContext.get().partitionId(), 0
        ids, labels, q = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims), np.int64)

        def block(i: np.ndarray, v: np.ndarray, m: np.ndarray) -> tuple:
            zone = (_vector_bytes(m.min(axis=0)), _vector_bytes(m.max(axis=0)), int(v.min()), int(v.max()))
            return part << 32 | number, _bytes(i), _bytes(v), _vector_bytes(m), *zone

        for batch in batches:
            ids = np.concatenate((ids, batch.column(0).to_numpy()))
            labels = np.concatenate((labels, batch.column(1).to_numpy()))
            q = np.concatenate((q, _matrix(batch.column(2), dims)))
            while len(ids) >= size:
                yield _record([block(ids[:size], labels[:size], q[:size])], _BLOCKS)
                ids, labels, q, number = ids[size:], labels[size:], q[size:], number + 1
        if len(ids):
            yield _record([block(ids, labels, q)], _BLOCKS)

    keyed = rows.mapInArrow(placed, "id bigint, label bigint, q array<bigint>, place binary")
    ordered = keyed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").select("id", "label", "q")
    return materialised(ordered.mapInArrow(packed, _BLOCKS), "blocks")


_ANCHORS = "bundle bigint, ids binary, keys binary, labels binary, vectors binary, low binary, high binary"


def bundled(anchors: DataFrame, dims: int, size: int = BUNDLE) -> DataFrame:
    """Anchors (``id``, ``key``, ``label``, ``q``, ``low``, ``high``: arrays of as many windows each) packed in bundles as they come."""

    def run(batches: Batches) -> Batches:
        part, number, waiting = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while waiting:
                own, waiting = waiting[:size], waiting[size:]
                *numbers, q, low, high = zip(*own, strict=True)
                vectors = np.zeros((len(q), dims), np.int64)
                for i, v in enumerate(q):
                    vectors[i, : len(v)] = v
                windows = [_bytes(np.array(w, np.int64)) for w in (low, high)]
                plain = [_bytes(np.array(x, np.int64)) for x in numbers]
                yield _record([(part << 32 | number, *plain, _vector_bytes(vectors), *windows)], _ANCHORS)
                number += 1

    return anchors.select("id", "key", "label", "q", "low", "high").mapInArrow(run, _ANCHORS)


def needed(bundles: DataFrame, blocks: DataFrame, same: bool, zones: int = ZONES) -> DataFrame:
    """``bundle``, ``block`` and ``run`` of the blocks whose bounds meet a window of an anchor of the bundle.

    Reads the zone maps only. They are packed ``zones`` at a time; each bundle, as the stated query set, goes past every such pack. About
    ``RUN`` blocks, from wherever on the curve, make a run that meets a bundle in one task.
    """
    n = blocks.count()
    runs = max(1, -(-n // RUN))
    schema = "pack bigint, blocks binary, lows binary, highs binary, label_lows binary, label_highs binary"

    def gathered(batches: Batches) -> Batches:
        part, number, waiting = TaskContext.get().partitionId(), 0, []

        def pack() -> pa.RecordBatch:
            block, low, high, label_low, label_high = zip(*waiting, strict=True)
            numbers = (_bytes(np.array(x)) for x in (label_low, label_high))
            return _record([(part << 32 | number, _bytes(np.array(block)), b"".join(low), b"".join(high), *numbers)], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                if len(waiting) == zones:
                    yield pack()
                    waiting, number = [], number + 1
        if waiting:
            yield pack()

    maps = blocks.select("block", "low", "high", "label_low", "label_high").repartition(max(1, -(-n // zones)), "block")
    packs = materialised(maps.mapInArrow(gathered, schema), "zones")
    # every bundle goes to each of as many groups as there are packs
    groups = max(1, packs.count())
    grouped = packs.withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(groups)))
    every = bundles.select("bundle", "labels", "vectors", "low", "high")
    dealt = every.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    met = dealt.join(grouped, "group").repartition("bundle", "pack").select(
        "bundle", "labels", "vectors", F.col("low").alias("least"), F.col("high").alias("most"), "blocks", "lows", "highs", "label_lows", "label_highs"
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in zip(*(texts(batch, i) for i in range(batch.num_columns)), strict=True):
                bundle, labels = row[0], _numbers(row[1])
                least, most = (_numbers(x).reshape(len(labels), -1) for x in row[3:5])
                block, label_low, label_high = map(_numbers, (row[5], *row[8:]))
                lower, upper = bounds(_vectors(row[2], len(labels)), *(_vectors(x, len(block)) for x in row[6:8]))
                if same:
                    open_ = (label_low <= labels[:, None]) & (labels[:, None] <= label_high)
                else:
                    open_ = (label_low != labels[:, None]) | (labels[:, None] != label_high)
                hit = np.zeros(len(block), bool)
                for w in range(least.shape[1]):
                    hit |= (open_ & (lower <= most[:, w : w + 1]) & (upper >= least[:, w : w + 1])).any(axis=0)
                found = block[hit].tolist()
                yield _record([(bundle, b) for b in found], "bundle bigint, block bigint")

    return met.mapInArrow(run, "bundle bigint, block bigint").withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs)))


def best(order: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``order`` the first ``k`` by score descending, then id."""
    if len(order) > k:
        least = np.partition(scores[order], len(order) - k)[len(order) - k]
        order = order[scores[order] >= least]
    return order[np.lexsort((ids[order], -scores[order]))][:k]


_FOUND = "anchor bigint, key bigint, spot int, found bigint, score bigint"


def _scored(anchors: tuple, blocks: list[tuple], same: bool, k: int) -> Iterator[tuple]:
    """The first ``k`` rows per anchor and window among some blocks."""
    anchor_ids, keys, anchor_labels, vectors, least, most = anchors
    ids, labels = (np.concatenate([_numbers(b[i]) for b in blocks]) for i in (0, 1))
    scores = _product(vectors, _vectors(b"".join(b[2] for b in blocks), len(ids)))
    for i, (anchor, key, label) in enumerate(zip(*(x.tolist() for x in (anchor_ids, keys, anchor_labels)), strict=True)):
        meant = np.flatnonzero(((labels == label) == same) & (ids != anchor))
        own = scores[i, meant]
        for w in range(least.shape[1]):
            inside = meant[(own >= least[i, w]) & (own <= most[i, w])]
            yield from ((anchor, key, w, int(ids[j]), int(scores[i, j])) for j in best(inside, ids, scores[i], k))


def searched(anchors: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """Per anchor and window the first ``k`` rows by score, then id: ``anchor``, ``key``, ``spot``, ``found``, ``score``, ``rank``.

    ``anchors`` has ``id``, ``key`` (which tells anchors of one id apart), ``label``, ``q`` and the windows ``low`` and ``high``. ``same``: rows
    of the anchor's label, else of others; never the anchor's own id.
    """
    bundles = materialised(bundled(anchors, dims), "bundles")
    pairs = materialised(needed(bundles, blocks, same), "needed")
    payload = blocks.select("block", "ids", "labels", "vectors")
    right = pairs.join(payload, "block").select(F.col("bundle").alias("to"), F.col("run").alias("part"), "ids", "labels", "vectors")
    left = pairs.select("bundle", "run").distinct().join(bundles, "bundle")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a = left.slice(0, 1).to_pylist()[0]
            numbers = [_numbers(a[c]) for c in ("ids", "keys", "labels")]
            windows = [_numbers(a[c]).reshape(len(numbers[0]), -1) for c in ("low", "high")]
            own = [(r["ids"], r["labels"], r["vectors"]) for r in right.select(["ids", "labels", "vectors"]).to_pylist()]
            out = list(_scored((*numbers, _vectors(a["vectors"], len(numbers[0])), *windows), own, same, k))
        return pa.Table.from_batches([_record(out, _FOUND)])

    found = left.groupBy("bundle", "run").cogroup(right.groupBy("to", "part")).applyInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "key", "spot").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def seeds(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """The anchors (ids divisible by ``every``) with ``low`` and ``high``, the window that holds their ``k`` best rows of their label.

    The k-th best score within the anchor's own block is a lower bound of the k-th best of all. ``key`` tells anchors of one id apart.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for raw in zip(*(texts(batch, i) for i in range(3)), strict=True):
                ids, labels = _numbers(raw[0]), _numbers(raw[1])
                vectors = _vectors(raw[2], len(ids))
                at = np.flatnonzero(ids % every == 0)
                scores = _product(vectors[at], vectors)
                out = []
                for i, own in zip(at.tolist(), scores, strict=True):
                    near = best(np.flatnonzero((labels == labels[i]) & (ids != ids[i])), ids, own, k)
                    least = int(own[near[-1]]) if len(near) == k else _LEAST
                    out.append((ids[i], labels[i], vectors[i].tolist(), [least], [_MOST]))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "q", "low", "high"])

    kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
    schema = "id bigint, label bigint, q array<bigint>, low array<bigint>, high array<bigint>"
    found = blocks.select("ids", "labels", "vectors").mapInArrow(run, schema)
    return found.distinct().withColumn("key", F.xxhash64("label", "q"))


def mined(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = SCALE,
    block: int = BLOCK, bits: int = 2,
) -> DataFrame:
    """Hard negatives of the anchors (ids divisible by ``every``): ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, both scores.

    A score is the inner product of vectors scaled by ``scale`` and rounded down; higher ones come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of its label. Of each pair come the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a null id, label, vector or component, or one that is not finite, take no part, nor do components beyond ``LARGEST``
    once scaled. Components that a shorter vector lacks are zero. Rows that share an anchor's id are neither its positives nor its
    negatives; otherwise repeated rows count each, and an anchor that is repeated exactly counts once. Other columns are not read. An empty table, or
    one without anchors, gives no rows.
    """
    rows = scaled(vectors, id_column, vector_column, label_column, scale)
    x = F.aggregate("q", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    seen = rows.agg(F.max(F.size("q")).alias("dims"), F.sum(F.size("q")).alias("n"), F.sum(x).alias("x"), F.sum(square).alias("xx")).first()
    dims, n = seen["dims"] or 0, seen["n"] or 1
    mean = (seen["x"] or 0.0) / n
    deviation = max(0.0, (seen["xx"] or 0.0) / n - mean * mean) ** 0.5
    table = blocked(rows, dims, mean, deviation, bits, block)
    anchors = materialised(seeds(table, every, positives), "anchors")
    met = searched(anchors, table, dims, True, positives)
    # of each positive its window of scores, rounded inwards
    met = materialised(
        met.select(
            F.col("anchor").alias("of"), F.col("key").alias("of_key"), F.col("rank").alias("nth"), "found", "score",
            F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)").alias("least"),
            F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("most"),
        ),
        "positives",
    )
    own = F.array_sort(F.collect_list(F.struct("nth", "least", "most"))).alias("own")
    windows = met.groupBy("of", "of_key").agg(own)
    # as many windows for each anchor; those it lacks hold nothing
    side = lambda name, none: F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("own", i)[name], F.lit(none))
    )
    sought = anchors.drop("low", "high").join(windows, (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")))
    sought = sought.select("id", "key", "label", "q", side("least", _MOST).alias("low"), side("most", _LEAST).alias("high"))
    found = searched(sought, table, dims, False, negatives)
    named = met.select("of", "of_key", "nth", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    same = (F.col("anchor") == F.col("of")) & (F.col("key") == F.col("of_key")) & (F.col("spot") + 1 == F.col("nth"))
    return found.join(named, same).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
