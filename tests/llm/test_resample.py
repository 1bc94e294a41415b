"""Importance resampling against plain counts, ratios and draws."""

import math
import random
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from warehaul.llm import resample

SF = "/root/testdata/sf0.001"
MULTIPLIER, WRAP = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain_keys(text, bits):
    """Keys of the words and pairs, and the n-grams of forms, as numbers and tuples."""
    found = (text or "").encode().split()
    one = [crc32(w) * MULTIPLIER & WRAP for w in found]
    two = []
    for a, b in pairwise(found):
        mixed = ((crc32(a) * MULTIPLIER & WRAP) ^ (crc32(b) + 1)) * MULTIPLIER & WRAP
        two.append(mixed ^ mixed >> 29)
    return [h >> 64 - bits for h in one + two]


def plain_forms(text, buckets):
    found = (text or "").encode().split()
    forms = [resample._form(w) for w in found]
    forms = [crc32(b"repeated") if i and w == found[i - 1] else f for i, (w, f) in enumerate(zip(found, forms, strict=True))]
    two = [(a * MULTIPLIER & WRAP) + b & WRAP for a, b in pairwise(forms)]
    return [(x * MULTIPLIER & WRAP) >> 40 for x in forms + two], buckets


def ratio(raw, target, raw_sum, target_sum, kinds):
    share = lambda n, whole: math.log((n + 0.5) / (whole + 0.5 * kinds))
    return share(target, target_sum) - share(raw, raw_sum)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, " \n"), (None, "no id at all"), (903, "one"), (3, "a repeated id")], docs.schema)
    return docs.unionByName(odd).repartition(3).cache(), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def plain(spark, tables):
    """Mean log ratio of every text by plain counting, and the counts."""
    docs, labels = tables
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    good = {}
    for r in labels.collect():
        good[r.doc_id] = min(good.get(r.doc_id, 1), r.quality)
    halves = {r.doc_id: r.half for r in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).alias("half")).collect()}
    bits = resample.key_bits(docs)
    buckets = resample.BUCKETS
    keys = {(i, t): (plain_keys(t, bits), [b % buckets for b in plain_forms(t, buckets)[0]]) for i, t in texts}
    raw, target, raw_forms, target_forms = Counter(), Counter(), Counter(), Counter()
    for i, t in texts:
        raw.update(keys[i, t][0])
        raw_forms.update(keys[i, t][1])
        if good.get(i) and halves[i]:
            target.update(keys[i, t][0])
            target_forms.update(keys[i, t][1])
    kept = {k for k, n in raw.items() if n >= resample.MIN_COUNT}
    totals = (sum(raw.values()), sum(target.values()), len(kept) + 1)
    rare = ratio(sum(n for k, n in raw.items() if k not in kept), sum(n for k, n in target.items() if k not in kept), *totals)
    forms = (sum(raw_forms.values()), sum(target_forms.values()), buckets)

    def mean(i, t):
        words, places = keys[i, t]
        if not words:
            return None
        total = sum(ratio(raw[k], target[k], *totals) if k in kept else rare for k in words)
        total += sum(ratio(raw_forms[b], target_forms[b], *forms) for b in places)
        return total / (len(words) + len(places))

    held = [(mean(i, t) or 0.0, good[i] == 1) for i, t in texts if i in good and not halves[i] and t != "a repeated id"]
    return {(i, t): mean(i, t) for i, t in texts}, {k: (raw[k], target[k]) for k in kept}, held


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.integers(0, 200, 500), rng.integers(0, 1 << 35, 500), [0, 127, 128, (1 << 35) - 1]))
    ends = np.array([0, 3, 3, 700, len(values)])
    blobs = resample.packed_numbers(values, ends)
    back = [resample.unpacked_numbers(b) for b in blobs]
    assert [len(b) for b in back] == np.diff([0, *ends]).tolist() and (np.concatenate(back) == values).all()
    assert resample.packed_numbers(values[:0], np.array([0])) == [b""]


def test_counts_and_means_as_plain_counting(tables, plain):
    docs, labels = tables
    model = resample.fit(docs, labels)
    means, counted, held = plain
    assert model.size == len(counted)
    got = {(r.doc_id, r.text): r["mean"] for r in resample.means(docs, model, "mean").collect()}
    assert got.keys() == means.keys()
    for key, want in means.items():
        assert (got[key] is None) == (want is None) and (want is None or abs(got[key] - want) < 1e-4), key
    cut, slope = resample.curve(held, resample.LOSS)
    assert abs(model.cut - cut) < 1e-3 and abs(model.slope / slope - 1) < 0.05 and slope > 0
    weights = {(r.doc_id, r.text): r.log_weight for r in resample.select(docs, labels).collect()}
    for key, want in means.items():
        assert abs(weights[key] - (0.0 if want is None else (got[key] - model.cut) * model.slope)) < 1e-9


def test_merged_counts_as_plain_counting(spark, tables, plain):
    docs, labels = tables
    bits = resample.key_bits(docs)
    taken = resample._labelled(labels, 10_000)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    found = {}
    for r in resample.counts(docs, taken.withColumn("good", F.col("good") & half), bits, resample.BUCKETS, resample.MIN_COUNT).collect():
        if r.part >= 0:
            columns = [np.frombuffer(b, t).tolist() for b, t in ((r["keys"], "<i4"), (r.raw, "<i8"), (r.target, "<i8"))]
            found |= {r.part << resample.PART_BITS | k: (a, b) for k, a, b in zip(*columns, strict=True)}
    assert found == plain[1]


@pytest.mark.parametrize("model_keys", [50, 400])
def test_a_model_in_pieces_gives_the_same(tables, model_keys):
    docs, labels = tables
    named = docs.selectExpr("doc_id", "text", "1 AS row", "'x' AS log_weight")
    whole = resample.select(named, labels).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, resample.select(named, labels, model_keys=model_keys).collect()))
    assert resample.fit(docs, labels).size > 2 * model_keys


def test_draws_are_in_proportion_to_weights_without_replacement(spark):
    weights = [0.2, 1.0, 2.0, 5.0]
    runs = 20_000
    drawn = spark.range(runs * 4).select((F.col("id") % 4).alias("doc"), F.floor(F.col("id") / 4).alias("run"), "id")
    log = F.log(F.element_at(F.array(*map(F.lit, weights)), (F.col("doc") + 1).cast("int")))
    keyed = drawn.withColumn("key", log + resample.gumbel(F.col("id")))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("key")))).filter("n <= 2")
    got = Counter(tuple(r.d) for r in first.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("n", "doc"))).alias("x")).select(F.col("x.doc").alias("d")).collect())
    for a in range(4):
        for b in range(4):
            if a != b:
                want = weights[a] / sum(weights) * weights[b] / (sum(weights) - weights[a])
                assert abs(got[a, b] / runs - want) < 4 * math.sqrt(want / runs) + 1e-4


def test_k_and_seed_decide_who_is_drawn(tables):
    docs, labels = tables
    docs = docs.filter("doc_id is not null and doc_id <> 3")
    for k in (0, 1, 50, 10_000):
        assert resample.select(docs, labels, k=k).filter("kept").count() == min(k, docs.count())
    # at a k within the good ones the noise decides, differently for each seed
    sets = [{r.doc_id for r in resample.select(docs, labels, k=50, seed=s).filter("kept").collect()} for s in (1, 2)]
    assert 0 < len(sets[0] & sets[1]) < 50
    top = {r.doc_id for r in resample.select(docs, labels, k=50).orderBy(F.desc("log_weight"), "doc_id").limit(50).collect()}
    assert sets[0] != top


def test_curve_of_odd_samples():
    rng = random.Random(4)
    assert resample.curve([], 0.01) == (None, 0.0) and resample.curve([(1.0, False)], 0.01) == (None, 0.0)
    apart = [(rng.gauss(3, 1), True) for _ in range(200)] + [(rng.gauss(-30, 1), False) for _ in range(50)]
    cut, slope = resample.curve(apart, 0.01)
    assert -25 < cut < 0 and 0 < slope < 10
    assert resample.curve([(-m, g) for m, g in apart], 0.01)[1] == 0.0
    assert resample.curve([(1.0, True), (1.0, False)], 0.01)[1] >= 0
