"""The pipeline and the registered queries."""

import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_near_duplicates import _kept
from tools.check_oracle import TABLES, normal
from warehaul.llm import decontaminate, pieces, queries, resample

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = resample.select(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()
    single = set(_kept([(r.doc_id, r.text) for r in kept]))
    left = [r for r in kept if r.doc_id in single]
    items = [decontaminate.item_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        words = decontaminate.item_words(text)
        near = (i for i in items if len(set(i) & set(words)) * 2 >= len(set(i)))
        return any(brute.word_distance(i, words) <= int(0.2 * len(i) + 1e-9) for i in near)

    left = {r.doc_id: r.text for r in left if not holds(r.text)}
    encoder = pieces.Encoder(pieces.Vocabulary.read(pieces.MODEL_PATH))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == left.keys() and 100 < len(got) < docs.count()
    for i, text in left.items():
        out = encoder.decode(pieces.np.array(got[i].piece_ids))
        assert got[i].decoded_equal and not brute.personal(out)
        if not brute.personal(text) and "token" not in text:
            assert out == text


def test_stages_keep_the_columns_and_bear_odd_rows(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' AS kept", "2 AS candidates")
    rng = random.Random(3)
    plain = " ".join(rng.choices((real.first().text or "").split(), k=60))
    rows = [
        (None, None), (-5, None), (-6, ""), (-7, plain), (-7, plain), (None, plain + " ends here"), (-8, f"{plain} a.b@c.example.org"),
        (-9, " ".join(["much longer"] * 30_000)),
    ]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    odd = odd.selectExpr("doc_id", "text", "string(null) lang", "string(null) source", "bigint(null) n_chars", "'x' kept", "2 candidates")
    seen = {}
    for start in ("rows", "none"):
        table = real.unionByName(odd) if start == "rows" else real.limit(0)
        for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, table = table, stage(spark, table, SF)
            if place < len(corpus_pipeline.STAGES) - 1:
                assert table.columns == before.columns
                table.write.parquet(f"{tmp_path}/{place}", mode="overwrite")
                table = spark.read.parquet(f"{tmp_path}/{place}")
            columns = ["doc_id", "text" if "text" in table.columns else "decoded_equal"]
            seen[start, name] = list(map(tuple, table.select(*columns).collect()))
    assert not any(rows for (start, _), rows in seen.items() if start == "none")
    # a text without words has even odds, so the draw decides on it; near copies leave one of each, the smallest id first
    quality = seen["rows", "quality"]
    drawn = resample.select(real.unionByName(odd), spark.read.parquet(f"{SF}/labels.parquet")).filter("_kept").select("doc_id", "text")
    assert sorted(quality, key=str) == sorted(map(tuple, drawn.collect()), key=str)
    assert sum(r in quality for r in set(rows) if r[1] and plain in r[1]) == 3
    single = seen["rows", "near_duplicates"]
    assert sorted(single, key=str) == sorted(_rows_kept(quality), key=str)
    assert set(single) >= set(seen["rows", "benchmark_passages"])
    assert len(seen["rows", "personal_data"]) == len(seen["rows", "benchmark_passages"]) == len(seen["rows", "piece_ids"])
    assert not any(brute.personal(t) for _, t in seen["rows", "personal_data"])
    assert len([t for _, t in single if not (t or "").strip()]) <= 1


def _rows_kept(rows):
    """Rows that stay of near copies, by all pairs; equal rows are one."""
    ids = _kept(rows)
    return [next(r for r in sorted(set(rows), key=str) if r[0] == i and (i is not None or r[1])) for i in ids]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = normal(df.columns, df.collect())
    assert got[1]
    if name in queries.ORACLES:
        cursor = duck.execute(queries.ORACLES[name])
        assert got == normal([d[0] for d in cursor.description], cursor.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("op3_personal_data", "op5_licences"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
