"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at
least 5 positional bytes. Postings of single bytes would hold N/256 fingerprints each, and their pairs would
grow with the square of N. The postings here are the values at four byte positions at once. The 14 position
sets are those whose indices XOR to zero (a Steiner system): every 3 positions lie within one of them, and
its complement is one too, so a linked pair meets in at least one posting list whatever bytes differ.
For each pair met, the shared positional bytes are counted, pairs under 5 go, the rest are verified.

Long posting lists never emit all their pairs. Their fingerprints are linked through the values at one flipped
bit (all links of up to 2 bits, a star per value), and where that leaves a list in several components, through
values at one flipped bit met by values at two (all links of 3 bits). That is exact and linear in the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from warehaul.llm.common import per_batch, texts, words
from warehaul.llm.components import components
from warehaul.session import materialised

SHINGLE = 3
MAX_BITS = 3
MIN_SHARED_BYTES = 8 - MAX_BITS
POSITION_SETS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: Posting lists above this length are linked through flipped bits; the result does not depend on it.
LONG_LIST = 64


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of the XXH64 values (seed 42) of all 3-word shingles of a text, A-Z in lower case.

    A text of one or two words is one shingle; no words (or null) give zero.
    """
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < SHINGLE:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 65536):  # bounds the bit matrix of a very long text
        high = min(n, low + 65536)
        spans = zip(starts[low:high].tolist(), ends[low + SHINGLE - 1 : high + SHINGLE - 1].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64 bits) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t) for t in texts(batch, 1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return kept.mapInArrow(per_batch(run), "doc_id bigint, fp bigint")


def _posting_keys(fp: Column) -> Column:
    """The 14 posting keys: set number and the four bytes, packed in one bigint."""
    keys = []
    for number, positions in enumerate(POSITION_SETS):
        key = F.lit(number << 32).cast("bigint")
        for place, position in enumerate(positions):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255)), 8 * place))
        keys.append(key)
    return F.array(*keys)


def _shared_bytes(a: Column, b: Column) -> Column:
    other = a.bitwiseXOR(b)
    return sum(
        (F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8)
    )


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs with the guaranteed minimum of shared positional bytes and at most 3 differing bits."""
    u, v = F.col("u"), F.col("v")
    return pairs.filter(_shared_bytes(u, v) >= MIN_SHARED_BYTES).filter(F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


ONE_BIT = [_bit(i) for i in range(64)]
TWO_BITS = [_bit(a) ^ _bit(b) for a, b in combinations(range(64), 2)]


def _flipped(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask")


def _value(df: DataFrame, masks: list[int]) -> DataFrame:
    named = df.select("*", _flipped(masks))
    return named.withColumn("value", F.col("fp").bitwiseXOR(F.col("mask"))).drop("mask")


def _within_two_bits(members: DataFrame) -> DataFrame:
    """Links that join all fingerprints of ``members`` within 2 bits: one star per value at one flipped bit."""
    values = _value(members, [0, *ONE_BIT])
    stars = values.groupBy("value").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    linked = values.join(stars, "value").select("u", F.col("fp").alias("v")).filter("u <> v")
    return _verified(linked.distinct())


def _at_three_bits(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Links of exactly 3 bits between members of one long list that are in different components.

    In each list the members outside its largest component are flipped at two bits and meet all members
    flipped at one; one member per value and component stands for the others.
    """
    named = (
        lists.join(roots, lists.fp == roots.node, "left")
        .select("key", "fp", F.coalesce("root", "fp").alias("root"))
    )
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("n", F.col("root").alias("r"))).getField("r").alias("main"), F.count("*").alias("parts")
    ).filter("parts > 1")
    open_lists = named.join(largest, "key")
    near = open_lists.select("fp", "root").distinct()
    far = open_lists.filter("root <> main").select("fp", "root").distinct()
    one = _value(near, ONE_BIT).groupBy("value", "root").agg(F.min("fp").alias("u"))
    two = _value(far, TWO_BITS).groupBy("value", "root").agg(F.min("fp").alias("v")).withColumnRenamed("root", "other")
    return _verified(one.join(two, "value").filter("root <> other").select("u", "v").distinct())


def linked_classes(classes: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Components of distinct fingerprints (column ``fp``) under links of at most 3 bits: ``node``, ``root``."""
    postings = classes.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    lists = materialised(
        postings.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .filter("n > 1"),
        "lists",
    )
    direct = lists.filter("n = 2").select("u", "v")
    members = materialised(postings.join(lists.filter("n > 2").select("key", "n"), "key"), "postings")
    short = members.filter(F.col("n") <= long_list)
    met = short.select("key", F.col("fp").alias("u")).join(short.select("key", F.col("fp").alias("v")), "key")
    links = _verified(direct.unionByName(met.filter("u < v").select("u", "v")).distinct())
    long = members.filter(F.col("n") > long_list).select("key", "fp")
    if long.isEmpty():
        return components(links)
    links = materialised(links.unionByName(_within_two_bits(long.select("fp").distinct())), "links")
    roots = components(links)
    rest = materialised(_at_three_bits(long, roots), "links")
    return roots if rest.isEmpty() else components(roots.toDF("u", "v").unionByName(rest))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", long_list: int = LONG_LIST
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that is reached through links of fingerprints that differ in
    at most 3 of 64 bits. Links are found between distinct fingerprints; equal ones are one class whatever
    its size. A null or wordless text has fingerprint zero, which is linked like any other. A null ``doc_id``
    keeps its row and names no component, unless it is alone: then the component is null too. Repeated rows
    each keep their row. An empty table gives no rows; extra columns are not read.
    """
    found = materialised(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = materialised(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = linked_classes(classes, long_list)
    # a class without links is its own root
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
