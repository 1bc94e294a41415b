"""Operators on documents against plain versions, with odd rows of every kind."""

import random

import pytest

from tests.llm import brute
from warehaul.llm import decontaminate, licences, linelabels, personal, pieces, resample, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row string, spans int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000)) + " +1 (377) 555-0271 a.b@c.example.org"
ODD = [
    None, "", " ", "\n\n", "one", "one two", LONG,
    "a a a a a a a a", "x\tb\x0bc\x0cd\re\n\nsame line\nsame line\nsame line",
    "+1 (377) 555-0271 and 4929348385146306, 999.1.1.1 255.0.10.1 1.2.3.4.5 x@y.zz_b@c.dd 4929 3483-8514 6306 12345678901234",
    'token = "7f5790b897549d620aedfc0705a565f96e3741e8" for 555-0199 call (212) 555-0199 or 078-05-1120 or 219-09-9999',
    "GNU General Public License; Apache License apache  license. CC-BY mit\nLicense MIT license mit licence",
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "é漢字 ▁ 😀\x00\u2028 end", "a@b@c.de..f +12 34",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", "r", 1) for i, t in enumerate(ODD)]
    rows += [rows[9], (None, "no id", None, None, None, None, None, None), (100, ODD[9].upper(), "en", "s", 1, "k", "r", 1)]
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "'k' AS kept", "'r' AS row", "1 AS spans"
    )
    return spark.createDataFrame(rows, SCHEMA).unionByName(real).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic")


def _sorted(rows):
    return sorted(rows, key=repr)


def test_line_labels_measure_as_the_plain_rules_do(docs, labels):
    got = linelabels.judged(docs.filter("doc_id < 1010 or doc_id is null"), labels, carry=["doc_id", "kept"]).collect()
    texts = docs.filter("doc_id < 1010 or doc_id is null").collect()
    want = [(r.doc_id, *brute.quality(r.text if r.text != LONG else "")) for r in texts if r.text != LONG]
    seen = [tuple(r)[:1] + tuple(r)[2:8] for r in got if r.doc_id != ODD.index(LONG)]
    assert _sorted(seen) == _sorted(want)
    assert got[0].asDict().keys() >= {"kept", "_kept", "content_share"}
    assert not any(r["_kept"] and r.base_failed for r in got)


def test_line_labels_tell_good_from_bad(spark, docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.filter("doc_id % 2 = 0")
    found = linelabels.judged(docs, labels.filter("doc_id % 2 = 1"), carry=["doc_id"]).join(held, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_line_labels_without_labels_keep_what_passes_the_base_rules(spark, docs, labels):
    got = linelabels.judged(docs.filter("doc_id >= 1000"), labels.limit(0), carry=["doc_id"]).collect()
    assert all(r.kept != r.base_failed for r in got) and any(r.kept for r in got)


def test_chain_decodes_the_best_sequence():
    import numpy as np

    rng = np.random.default_rng(1)
    chain = linelabels.Chain(rng.normal(size=(2, linelabels.N_WEIGHTS)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        features = rng.integers(0, linelabels.N_WEIGHTS, (n, len(linelabels.FEATURES)))
        scores = chain.scores(features)

        def score(labels, scores=scores):
            moves = sum(chain.transition[a, b] for a, b in zip(labels, labels[1:], strict=False))
            return moves + sum(s[y] for s, y in zip(scores, labels, strict=True))

        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=score)
        assert chain.viterbi(features) == best


def test_personal_data_base_is_exact(docs):
    got = [(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in personal.summary(docs).collect()]
    want = []
    for r in docs.collect():
        kinds = [k for k, _, _ in brute.personal(r.text)]
        want.append((r.doc_id, brute.personal_digest(r.text), *(kinds.count(k) for k in brute.KINDS)))
    assert _sorted(got) == _sorted(want)


def test_personal_data_adds_spans_and_keeps_the_base(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal.summary(docs).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(brute.personal(texts[r.doc_id]))
        if r.doc_id == 10:
            assert "secret" in {k for k, _, _ in spans}


def test_masked_texts_hold_no_personal_data(docs):
    before = {r.doc_id: r for r in docs.filter("doc_id <> 9").collect()}
    out = personal.masked(docs.filter("doc_id <> 9"))
    assert out.columns == docs.columns
    for r in out.collect():
        old = before[r.doc_id]
        if not brute.personal(old.text):
            assert r.text == old.text or "<" in r.text
        else:
            assert not brute.personal(r.text) and r.n_chars == len(r.text)


def test_personal_data_of_no_rows(docs):
    assert personal.summary(docs.limit(0)).collect() == []


def test_expectation_maximisation_finds_the_bad_labeler():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    accuracy = (0.95, 0.9, 0.5, 0.85)
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    posterior, chances = personal.expectation_maximisation(votes, np.zeros(4000, int), np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert [round(float(c[1][2]), 1) for c in chances] == pytest.approx([0.95, 0.9, 0.5, 0.85], abs=0.06)


def test_resampling_keeps_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = resample.select(docs, labels.filter("doc_id % 3 > 0"), carry=["doc_id"])
    held = found.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_resampling_tells_words_of_one_form(spark):
    rng = random.Random(8)
    kinds = {g: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)] for g in (0, 1)}
    rows = [(i, " ".join(rng.choices(kinds[int(i % 4 > 0)], k=200))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id bigint, quality int")
    held = resample.select(docs, labels, carry=["doc_id"]).filter("doc_id >= 400").collect()
    good, bad = [r.kept for r in held if r.doc_id % 4], [r.kept for r in held if r.doc_id % 4 == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_resampling_model_grows_with_the_texts(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        sizes.append(resample.fit(docs, labels).size)
    assert sizes[1] > 2 * sizes[0] > 0


def test_resampling_of_odd_rows(docs, labels):
    found = resample.select(docs, labels)
    assert found.columns == [*docs.columns, "log_weight", "gumbel_key", "_kept"]
    assert found.count() == docs.count()
    assert {r.log_weight for r in found.filter("doc_id in (0, 1, 2)").collect()} == {0.0}
    assert all(r["_kept"] for r in resample.select(docs, labels.limit(0)).collect())
    assert resample.select(docs.limit(0), labels).collect() == []


def test_top_k_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 1e9, -3.0]) for _ in range(500)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, key double")
    order = sorted(range(500), key=lambda i: (-values[i], i))
    for k in (1, 7, 100, 250, 400, 500):
        least, last = resample.top_k(table, "key", ["doc_id"], k, bins=8)
        taken = {i for i, v in enumerate(values) if v > least or (v == least and (last is None or i <= last[0]))}
        assert taken == set(order[:k])


def test_licences_as_plain_search_finds_them(docs):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = licences.scan(docs).select(*columns, "labels", "score").collect()
    want = [(r.doc_id, *brute.licences(r.text, licences.PHRASES)) for r in docs.collect()]
    assert _sorted(tuple(r)[:6] for r in got) == _sorted(want)
    one = next(r for r in got if r.doc_id == 12)
    assert one.labels == "apache,apache-2.0,mit,mit-notice" and one.score == 1.0
    assert all(r.score == 0 for r in got if not r.n_words)
    assert licences.scan(docs.limit(0)).collect() == []


def test_licence_notices_with_words_put_in_and_left_out(spark):
    notice = next(n for n in licences.NOTICES if len(n.split()) > 14).split()
    texts = [" ".join(notice), " ".join([*notice[:5], "really", *notice[5:]]), " ".join(notice[:6] + notice[7:]), " ".join(notice[:5])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan(table).collect()}
    assert [bool(got[i].labels) for i in range(4)] == [True, True, True, False]


def test_contaminated_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(None, "x y z"), (900, None), (901, " ,. "), (902, "one")], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench.unionByName(extra)).collect()
    items = {r.item_id: decontaminate.item_words(r.text) for r in bench.collect()} | {902: [b"one"]}
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    want = {}
    for r in docs.filter("text is not null and length(text) < 6000").collect():
        words = decontaminate.item_words(r.text)
        for i, item in items.items():
            if len(set(item) & set(words)) * 2 >= len(set(item)):
                distance = brute.word_distance(item, words)
                if distance <= int(0.2 * len(item) + 1e-9):
                    want[r.doc_id, i] = distance
    assert {k: v for k, v in got.items() if k in want} == want and len(want) > 3
    assert len([k for k in got if k[0] != ODD.index(LONG) and k not in want]) == 0
    clean = decontaminate.clean(docs, bench.unionByName(extra))
    assert clean.columns == docs.columns
    assert clean.count() == docs.count() - docs.join(spark.createDataFrame([(d,) for d in {k[0] for k in got}], "doc_id bigint"), "doc_id").count()
    for empty in (decontaminate.contaminated(docs.limit(0), bench), decontaminate.contaminated(docs, bench.limit(0))):
        assert empty.collect() == []


def test_contaminated_in_blocks_of_items(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, blocks = (decontaminate.contaminated(docs, bench, block_items=n) for n in (5000, 7))
    assert _sorted(map(tuple, whole.collect())) == _sorted(map(tuple, blocks.collect()))


def test_edited_passages_are_recalled(spark):
    """Planted copies with up to a fifth of the words edited; recall against all of them."""
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    vocabulary = [w for _, t in items for w in decontaminate.item_words(t)]
    index = decontaminate.Index(items)
    hit = total = 0
    for item, words in index.items:
        for share in (0.0, 0.1, 0.2):
            copy = list(words)
            for _ in range(int(share * len(words))):
                at = rng.randrange(len(copy))
                kind = rng.randrange(3)
                copy[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(vocabulary)]
            text = [*rng.choices(vocabulary, k=50), *copy, *rng.choices(vocabulary, k=50)]
            found = index.verify(text, list(index.candidates(decontaminate._hashes(text))))
            total += 1
            hit += any(index.items[f[0]][0] == item for f in found)
    assert hit >= 0.95 * total


def test_pieces_equal_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rows = pieces.encoded(docs, carry=["doc_id", "text"]).collect()
    assert len(rows) == docs.count() and all(r.decoded_equal for r in rows)
    for r in rows:
        assert r.n_pieces == len(r.piece_ids)
        if r.text is None or pieces.SPACE not in r.text:
            assert r.piece_ids == model.encode(r.text or "")
    assert pieces.encoded(docs.limit(0)).collect() == []


def test_pieces_of_odd_strings():
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(4)
    model = SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    encoder = pieces.Encoder(pieces.Vocabulary.read(pieces.MODEL_PATH), cache_units=100)
    odd = [" " * n + "b" for n in range(60)] + ["x" * 5000, " " * 500, "ab" * 400, "日本語のテキスト" * 60]
    odd += ["".join(rng.choice("ab c\n\r.é😀  ;)") for _ in range(rng.randrange(80))) for _ in range(500)]
    odd += ["".join(rng.choice("ABab01/+xyzEIOU") for _ in range(2000)) for _ in range(3)]
    for text, ids in zip(odd, encoder.encode(odd), strict=True):
        assert ids.tolist() == model.encode(text)
        assert encoder.decode(ids) == text
    marked = "a ▁ b▁▁c"
    assert encoder.decode(encoder.encode([marked])[0]) == marked


def test_fingerprints_and_components(docs):
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    fingers = {r.doc_id: brute.fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = brute.linked(fingers)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fingers[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("long_list", [2, 8, 64])
def test_long_posting_lists_lose_no_link(spark, long_list):
    rng = random.Random(long_list)
    values = []
    for _ in range(4):  # chains of flips around a few centres
        centre = rng.getrandbits(64)
        for _ in range(60):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 5))))
            values.append(centre)
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    roots = {r.node: r.root for r in simhash.linked_classes(table, long_list).collect()}
    want = brute.linked({v: v & (1 << 64) - 1 for v in signed})
    groups = lambda root: {frozenset(v for v in signed if root(v) == r) for r in map(root, signed)}
    assert groups(lambda v: roots.get(v, v)) == groups(want.get)


def test_items_without_an_id_clean_documents(spark):
    words = [f"item{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, "nothing of the kind here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, " ".join(words)), (7, "some other item that no text holds at all")], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, None, 1, 30, 0)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]
