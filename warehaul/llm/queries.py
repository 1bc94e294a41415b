"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warehaul.llm import (
    chat, decontaminate, htmltext, licences, linelabels, negatives, packing, personal, pieces, repair, resample, simhash, warc,
)
from warehaul.llm.registry import ORACLES, QUERIES, query
from warehaul.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_labels")
def op1_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linelabels.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(_table(spark, sf_dir, "pages"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.summary(_table(spark, sf_dir, "documents"))


@query("op4_resampling")
def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])


def _licence_oracle() -> str:
    rows = []
    texts = [(t, v, True) for t, v in licences.PHRASES.items()] + [(t, v, False) for t, v in licences.NOTICES.items()]
    for number, (text, label, phrase) in enumerate(texts):
        w = text.split()
        rows += [f"({number}, '{label}', {phrase}, {len(w) - 1}, {p}, '{w[p]}', '{w[p + 1]}')" for p in range(len(w) - 1)]
    return rf"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{licences.BETWEEN}'), lambda x: x <> '') AS w FROM documents
), pairs AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'at': i - 1, 'a': w[i], 'b': w[i + 1]}})) AS g FROM docs
), templates(template, label, phrase, n, place, t1, t2) AS (VALUES {', '.join(rows)}
), diagonals AS (
  SELECT doc_id, template, label, phrase, n, g['at'] - place AS diagonal, count(*) AS votes, min(g['at']) AS f, max(g['at']) AS l
  FROM pairs JOIN templates ON g['a'] = t1 AND g['b'] = t2 GROUP BY doc_id, template, label, phrase, n, g['at'] - place
), marked AS (
  SELECT *, CASE WHEN phrase OR NOT coalesce(abs(diagonal - lag(diagonal) OVER o) <= {licences.SHIFT} AND f - lag(l) OVER o <= {licences.GAP}, false)
    THEN 1 ELSE 0 END AS apart
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY f, diagonal)
), parts AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY f, diagonal) AS part FROM marked
), spans AS (
  SELECT doc_id, template, label, phrase, n, part, min(f) AS start,
    CASE WHEN sum(votes) >= n THEN 1.0 ELSE CAST(sum(votes) AS DOUBLE) / n END::DOUBLE AS share FROM parts GROUP BY doc_id, template, label, phrase, n, part
), judged AS (
  SELECT *, phrase AND share = 1 AS base,
    (phrase AND share = 1) OR (NOT phrase AND share >= CASE WHEN n < {licences.SHORT} THEN 1 ELSE {licences.COVER} END) AS named FROM spans
)
SELECT d.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base,
  CAST(min(start) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE named), '') AS labels,
  coalesce(max(share), 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""


@query("op5_licences", _licence_oracle())
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


WARC_ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
q AS (SELECT *, CASE WHEN size >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS original FROM p)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM q
"""


@query("op6_warc", WARC_ORACLE)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.assemble(warc.digested(warc.read(spark, path))))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


CHAT_ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'),
    '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_end|>') + length(replace(url_encode(role), '%20', '+')) + length(body) + 2) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op8_chat", CHAT_ORACLE)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    table = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint"), "role", "text")
    written = chat.formatted(chat.canonical(chat.records(table.unionByName(own)), "record"))
    found = chat.read_back(written.select("conv_id", "formatted", "loss_spans"))
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return found.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op9_pieces")
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


# crc32 bit by bit; the paths carry the cheapest (cost, audit, text) of each state from row to row
REPAIR_ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  )) % 20 AS kind FROM keyed
), after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM after
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN again > 1 THEN 'd'
    WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS p0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS p1,
    {'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'user:'} AS p2,
    {'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS p3
  FROM counted
  UNION ALL
  SELECT conv_id, i, b0, b1, least_user,
    list_min([b3, {'c': least_user['c'] + 2, 'a': least_user['a'] || 'I', 't': least_user['t'] || chr(10) || 'assistant:'}])
  FROM (
    SELECT *, list_min([b2] || list_transform([b0, b1, b3], lambda p: {'c': p['c'] + 2, 'a': p['a'] || 'I', 't': p['t'] || chr(10) || 'user:'})) AS least_user
    FROM (
      SELECT r.conv_id, r.i, {'c': p0['c'] + 3, 'a': p0['a'] || 'D', 't': p0['t']} AS b0,
        list_min([{'c': p1['c'] + 3, 'a': p1['a'] || 'D', 't': p1['t']}, CASE WHEN stays AND initial = 's'
          THEN {'c': p0['c'] + extra, 'a': p0['a'] || 'K', 't': p0['t'] || said} END]) AS b1,
        list_min([{'c': p2['c'] + 3, 'a': p2['a'] || 'D', 't': p2['t']}] || CASE WHEN stays THEN list_transform([p0, p1, p3], lambda p:
          CASE WHEN initial = 'u' THEN {'c': p['c'] + extra, 'a': p['a'] || 'K', 't': p['t'] || said}
          ELSE {'c': p['c'] + extra + 2, 'a': p['a'] || 'R', 't': p['t'] || chr(10) || 'user:' || text} END) ELSE [] END) AS b2,
        list_min([{'c': p3['c'] + 3, 'a': p3['a'] || 'D', 't': p3['t']}, CASE WHEN stays AND initial = 'a'
          THEN {'c': p2['c'] + extra, 'a': p2['a'] || 'K', 't': p2['t'] || said}
          WHEN stays THEN {'c': p2['c'] + extra + 2, 'a': p2['a'] || 'R', 't': p2['t'] || chr(10) || 'assistant:' || text} END]) AS b3
      FROM paths JOIN (SELECT *, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra, chr(10) || role || ':' || text AS said
        FROM judged) r ON paths.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = paths.i + 1
    )
  )
), best AS (SELECT conv_id, i, list_min([p0, p3]) AS p FROM paths)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(p['c'], 0) AS cost, coalesce(p['a'], '') AS audit, sha256(coalesce(substr(p['t'], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN (SELECT c.*, p FROM counted c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i) x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@query("op12_repair", REPAIR_ORACLE)
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(_table(spark, sf_dir, "conversations")), copies="copies")


NEGATIVES_ORACLE = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS d FROM sound
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id, a.label = b.label
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM scores WHERE same) WHERE n <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""


@query("op13_negatives", NEGATIVES_ORACLE)
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # known label noise: every seventh vector moves to the next label
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(_table(spark, sf_dir, "embeddings").withColumn("label", label))
