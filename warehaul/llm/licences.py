"""License scan by diagonal voting, in DataFrame functions only.

Every word pair of every text is hashed and joined with the hashed word pairs of the templates, which are a
fixed small table. A hit votes for a diagonal: its place in the text minus its place in the template. Votes are
counted per document, template and diagonal. A phrase is found where a diagonal has all its pairs, that is where its
words stand consecutively. For longer notices neighbouring diagonals (words put in or left out) that follow
each other are merged, and the share of the notice's pairs that they hold decides.
Hits are verified by the words themselves, so an equal hash of other words counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warehaul.llm.common import fresh, quoted

#: Fixed phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of well-known notices, with labels of our own.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl-text",
}
#: Share of a notice's word pairs that its merged diagonals must hold; short ones must be whole, as one word of
#: them may be the version.
COVER, SHORT = 0.75, 10
#: Diagonals this far apart are neighbours, if no more than this many words of the text lie between them.
SHIFT, GAP = 2, 6
#: Runs of characters that are in no word (A-Z are lower case by then).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Word pairs of all templates: ``template``, ``label``, ``phrase``, ``pairs``, ``place``, ``t1``, ``t2``, ``gram``."""
    rows = []
    for number, (text, label, phrase) in enumerate(
        [(t, v, True) for t, v in phrases.items()] + [(t, v, False) for t, v in notices.items()]
    ):
        found = text.split()
        rows += [(number, label, phrase, len(found) - 1, p, found[p], found[p + 1]) for p in range(len(found) - 1)]
    table = spark.createDataFrame(
        rows, "template int, label string, phrase boolean, pairs int, place int, t1 string, t2 string"
    )
    return table.withColumn("gram", F.xxhash64("t1", "t2"))


def _pairs(docs: DataFrame, text_column: str) -> DataFrame:
    """Every word with the word after it (none after the last), its place and the number of words.

    A text without words gives one row without a place, so that every document goes on.
    """
    plain = F.split(F.lower(F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit(""))), BETWEEN, -1)
    found = docs.select("row", "doc_id", F.array_remove(plain, "").alias("words"))
    after = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    zipped = F.arrays_zip(F.col("words").alias("w1"), after.alias("w2"))
    # counted before the words are dealt out, so that no row carries all of them
    counted = found.select("row", "doc_id", F.size("words").alias("n_words"), zipped.alias("zipped"))
    return counted.select("row", "doc_id", "n_words", F.posexplode_outer("zipped").alias("at", "w"))


def votes(docs: DataFrame, table: DataFrame, text_column: str = "text") -> DataFrame:
    """Pairs of each diagonal, with the places of its first and last; a row without template for every document.

    One shuffle by row serves all later steps. The template table is of fixed size and so broadcast.
    """
    each = _pairs(docs, text_column).select(
        "row", "doc_id", "n_words", "at", F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"),
        F.xxhash64("w.w1", "w.w2").alias("hash"),
    )
    met = each.join(
        F.broadcast(table), (F.col("hash") == F.col("gram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")),
        "left",
    )
    hits = met.filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    narrow = hits.select("row", "doc_id", "n_words", "template", "label", "phrase", "pairs", diagonal, "at").repartition("row")
    return narrow.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "pairs", "diagonal").agg(
        F.count("template").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last")
    )


def spans(counted: DataFrame) -> DataFrame:
    """One row per document and place of a template: start, end (words, exclusive) and share of its pairs.

    Each full diagonal of a phrase is a place. The diagonals of a notice are merged while they follow each other
    closely. Every document also keeps its row without a template.
    """
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= SHIFT) & (
        F.col("first") - F.lag("last").over(order) <= GAP
    )
    apart = F.when(F.col("phrase") | ~F.coalesce(near, F.lit(False)), 1).otherwise(0)
    grouped = counted.withColumn("apart", apart).withColumn("part", F.sum("apart").over(order))
    return grouped.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "pairs", "part").agg(
        F.min("first").alias("start"),
        (F.max("last") + 2).alias("end"),
        F.coalesce(F.when(F.sum("votes") >= F.first("pairs"), 1.0).otherwise(F.sum("votes") / F.first("pairs")), F.lit(0.0)).alias("share"),
    )


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
) -> DataFrame:
    """One row per input row: its words, places and labels of phrases, all labels, and the best share.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start (null without any). ``base_labels`` and ``labels`` are distinct, sorted and comma-joined; the latter also
    hold the labels of notices. ``score`` is the largest share of any template that one place holds. A null or wordless
    text has no words, no labels and score 0. Repeated rows each give a row. Extra columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(quoted(id_column)).alias("doc_id"),
        F.col(quoted(text_column)).alias(fresh(["row", "doc_id"], "text")),
    )
    table = templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    found = spans(votes(rows, table, "text"))
    base = F.col("phrase") & (F.col("share") == 1)
    needed = F.when(F.col("pairs") < SHORT, 1.0).otherwise(COVER)
    named = base | (~F.col("phrase") & (F.col("share") >= needed))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(named).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .withColumn("n_words", F.col("n_words").cast("bigint"))
        .drop("row")
    )
