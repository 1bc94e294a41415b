"""Hard negatives against all pairs, and the parts of the search."""

import math

import numpy as np
import pytest

from warehaul.llm import negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, place int"


def plain(rows, every=100, positives=5, wanted=10):
    """``mined`` over (id, vector, label) rows, by all pairs."""
    sound = [
        (i, [math.floor(256 * x) for x in v], c)
        for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 4096 for x in v)
    ]
    out = []
    for i, a, c in {(i, tuple(v), c) for i, v, c in sound if i % every == 0}:
        score = lambda v, a=a: sum(x * y for x, y in zip(a, v, strict=False))
        scored = sorted(((-score(v), j, d) for j, v, d in sound if j != i))
        mine = [(s, j) for s, j, d in scored if d == c][:positives]
        for s, j in mine:
            near = [(t, k) for t, k, d in scored if d != c and 30 * -s <= 100 * -t <= 90 * -s][:wanted]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, negatives.mined(df, **options).collect()))


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((1, 3), (2, 4), (3, 2), (5, 2), (4, 1)):
        side = 1 << bits
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(side)] * dims, indexing="ij")], axis=1)
        keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
        assert len(set(keys)) == side**dims
        path = cells[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-90, 90, (200, 7)), rng.integers(-90, 90, (20, 7))
    low, high = (np.array([f(rows[i : i + 10], axis=0) for i in range(0, 200, 10)]) for f in (np.min, np.max))
    lower, upper = negatives.bounds(anchors, low, high)
    products = (anchors @ rows.T).reshape(20, 20, 10)
    assert (lower <= products.min(axis=2)).all() and (products.max(axis=2) <= upper).all()


def test_zone_maps_leave_blocks_out(spark):
    # four far clusters of labels of their own: the windows of an anchor reach some of the blocks only
    rng = np.random.default_rng(1)
    centres = [(8, 0, 0), (7, 2, 0), (-8, 0, 0), (0, 0, 9)]
    rows = [(i, (np.array(centres[i % 4]) + rng.normal(0, 0.1, 3)).tolist(), i % 4) for i in range(1, 2000)] + [(2000, [8.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    scaled = negatives.scaled(df, "vec_id", "embedding", "label")
    table = negatives.blocked(scaled, 3, 0.0, 1500.0, bits=4, size=32)
    assert table.selectExpr("sum(octet_length(ids) div 8)").first()[0] == 2000
    anchors = negatives.seeds(table, 2000, 5)
    bundles = negatives.bundled(anchors, 3)
    kept = negatives.needed(bundles, table, True).count()
    assert 0 < kept < table.count() / 2
    stored = [(i, np.float32(v).tolist(), c) for i, v, c in rows]
    assert mined(df, every=2000, block=32, bits=4) == plain(stored, every=2000)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(9)
    rows = [(int(i), np.float32(rng.normal(0, 0.2, 6)).tolist(), int(rng.integers(0, 3))) for i in range(-150, 450)]
    same = np.float32(rng.normal(0, 0.3, 6)).tolist()
    rows += [(1000 + i, same, 7) for i in range(300)] + [(2000, same, 1), (2001, same, 1)]
    rows += [(3000, None, 1), (3001, [0.1, None, 0.2], 1), (3100, [float("nan")] * 6, 1), (3200, [float("inf")] * 6, 1), (3300, same, None)]
    rows += [(None, same, 1), (3400, [], 1), (3500, [0.5, 0.5], 2), (3501, [0.4, 0.6, 0.1, 0.0, 0.0, 0.0, 0.9], 0), (3600, [5000.0], 1)]
    rows += [(3700, [0.0] * 6, 2), (3800, [-x for x in same], 9), (5, same, 1), (200, same, 1), *rows[:40]]
    return rows


def test_mined_as_all_pairs(spark, odd):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], SCHEMA).repartition(3)
    want = plain([(i, v and [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in odd])
    assert len(want) > 300
    assert mined(df, block=16) == want
    assert mined(df, block=1000, bits=3) == want
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 100 <> 0")) == []


def test_mined_with_packs_of_few_zone_maps(spark, odd, monkeypatch):
    monkeypatch.setattr(negatives.needed, "__defaults__", (3,))
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], SCHEMA).repartition(3)
    assert mined(df, block=16) == plain([(i, v and [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in odd])


def test_mined_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert mined(df) == plain(rows)
