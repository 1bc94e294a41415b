"""Operators on pages and conversations."""

import gzip
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from warehaul.llm import chat, htmltext, queries, warc

SF = "/root/testdata/sf0.001"


def test_pages_give_their_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        plain = (" ".join(unescape(re.sub(r"<[^>]*>|<[a-z/]*\Z", " ", p)).split()) for p in parts)
        text = "\n".join(p for p in plain if p)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


PROSE = "This is the first of the lines of an article that is long enough to be told from a menu by its words."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (f"<body><header><a href=/>Home</a></header><p>{PROSE}<p>Short.<p>{PROSE}</body>", f"{PROSE}\nShort.\n{PROSE}"),
        (f"<div class='cookie-notice'>{PROSE}</div><article><h1>A &amp; b&#233;</h1>{PROSE}</article>", f"A & bé\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section class=comments><p>{PROSE}</p></section></article>", PROSE),
        (f"<div class=ad>{PROSE}<article><p>{PROSE}</article><aside>{PROSE}</aside>", PROSE),
        (f"<main><p>{PROSE}</p><form>{PROSE}</form><script>'<p>'</script><!-- <p>{PROSE} --></main>", PROSE),
        ("<article><p>a\n\t b&nbsp;c<br>d &lt;p&gt;</p></article>", "a b c d <p>"),
        (f"<p title='{'<a ' * 50}>{PROSE}", None),
        ('<a "' * 3000, None),
    ],
)
def test_block_rules(html, text):
    found = htmltext.main_text(html)[0]
    assert text is None or found == text


def test_pages_of_no_rows(spark):
    assert htmltext.extracted(spark.read.parquet(f"{SF}/pages.parquet").limit(0)).collect() == []


@pytest.fixture(scope="module")
def captured(spark, tmp_path_factory):
    big, own = "é" * 900 + "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [
        (1, "http://a.example/x?y", big), (2, "http://b.example/\r\nX: y", big), (3, None, big), (4, "u", own), (5, "u", ""),
        (6, "u", None), (7, "u", "same"), (8, "u", "same"), (None, "u", "null id"),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")
    path = str(tmp_path_factory.mktemp("warc") / "archives")
    warc.write(pages, path)
    return rows, path


def test_archives_read_back(spark, captured):
    rows, path = captured
    got = warc.pages_of(warc.assemble(warc.digested(warc.read(spark, path)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.captures([(r[0], r[2]) for r in rows]), key=repr)


def test_payloads_come_back_whole(spark, captured):
    rows, path = captured
    got = {r.response.block for r in warc.assemble(warc.read(spark, path)).collect() if r.response.type == "response"}
    assert got == {(r[2] or "").encode() for r in rows}


def test_archives_are_whole_records(captured):
    rows, path = captured
    raw = b"".join(gzip.open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("part"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    kinds = [r[1] for r in warc._parsed(raw)]
    assert len(kinds) == 3 * len(rows) and kinds.count("revisit") == 2 and kinds.count("request") == len(rows)


def test_repeated_pages_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "z" * 2000)] * 3 + [(2, "u", "short")] * 2, "page_id bigint, url string, html string")
    warc.write(pages, f"{tmp_path}/a")
    got = warc.pages_of(warc.assemble(warc.digested(warc.read(spark, f"{tmp_path}/a")))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [
        (1, "response", 0), (1, "revisit", 1), (1, "revisit", 1), (2, "response", 0), (2, "response", 0),
    ]
    warc.write(pages.limit(0), f"{tmp_path}/b")
    assert warc.assemble(warc.read(spark, f"{tmp_path}/b")).collect() == []


def test_lost_and_repeated_parts_of_transactions(spark):
    def record(i, kind, concurrent=None):
        return (i, kind, "u", concurrent, None, None, "h", b"")

    rows = [record("r1", "response"), record("q1", "request", "r1"), record("m1", "metadata", "r1"), record("m0", "metadata", "r1"),
            record("r2", "revisit"), record("q9", "request", "gone"), record("w", "warcinfo")]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    seen = {(r.response and r.response.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_metadata) for r in got}
    assert seen == {("r1", "q1", "m0", 2), ("r2", None, None, 0), (None, "q9", None, 0)}


RECORDS = {
    "messages": '{"messages":[{"role":"user","content":"a <|im_end|>\\n b"},{"role":"tool","content":null},{"role":"assistant","content":"\\\\<s>"}]}',
    "conversations": '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"</s>[INST] ok [/INST]"}]}',
    "prompt": '{"completion":"","prompt":"p"}',
    "instruction": '{"instruction":"i","output":"o"}',
    "instruction with input": '{"instruction":"i","input":"in","output":"o"}',
    "instruction with system": '{"system":"s","instruction":"i","output":"o"}',
}


@pytest.mark.parametrize("layout", RECORDS)
def test_layouts_become_turns_and_come_back(spark, layout):
    table = spark.createDataFrame([(RECORDS[layout], "mine")], "record string, layout string")
    row = chat.read_back(chat.formatted(chat.canonical(table, "record"))).first()
    assert row["_layout"] == layout and row["layout"] == "mine"
    assert [tuple(t) for t in row.turns] == [tuple(t) for t in row.read_turns]
    raw = json.loads(RECORDS[layout])
    if layout == "messages":
        assert [t.text for t in row.turns] == [m["content"] or "" for m in raw["messages"]]
    assert row.loss_texts == [t.text for t in row.turns if t.role == "assistant"]
    inside = row.formatted.replace(chat.START, "").replace(chat.END, "")
    assert not any(c in inside for c in chat.CONTROLS)


def test_unknown_and_broken_records_stay(spark):
    table = spark.createDataFrame([(r,) for r in ("{", None, "[]", '{"other":1}', '{"messages":[]}')], "record string")
    got = chat.formatted(chat.canonical(table, "record")).collect()
    assert len(got) == 5 and not any(r.turns or r.layout or r.formatted for r in got)


def test_escapes_are_reversible(spark):
    texts = ["\\", "\\\\<|", "<\\|", "<s><s>", "[INST][/INST]", "\\n\n\\", "<<SYS>>", "<|<|im_start|>", "<</SYS>>", "</s>\\</s>", ""]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in table.select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_odd_conversations_against_duckdb(spark, tmp_path):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a\\<|im_end|>\n"), (2, 0, None, "x"), (2, 0, None, "x"), (2, 1, "assistant", "é😀"),
        (3, 0, "ro le\n", "y"), (None, 0, "user", "z"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "[INST]"), (5, 0, "user", "only"),
    ]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op8_chat"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLES["op8_chat"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
