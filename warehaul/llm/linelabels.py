"""Quality rules with line labels: a linear-chain conditional random field and Viterbi decoding.

Every line with a word is described by a few bucketed features. A chain model with the labels content and boilerplate,
trained here on a bounded sample of labelled documents, is decoded by Viterbi; the share of a text's words
that stand in content lines decides on keeping it. Only documents are labelled, not lines: a first chain is
fitted with each document's label on all its lines, its own decoding then relabels the lines of the bad documents
(whose good lines would teach the wrong thing), and the chain is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warehaul.llm.common import Batches, fresh, quoted, texts, words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50
#: Content share from which a text is kept.
CONTENT_SHARE = 0.5
#: Bounds of the training sample: documents with the smallest hashes of their ids, of at most so many lines.
SAMPLE = 600
SAMPLE_LINES = 64
_FIT_STEPS = 60
_RIDGE = 1e-3

#: Upper edges of the buckets of each feature; one more bucket lies above the last.
FEATURES = {
    "symbols per word": (0.0, 0.1, 0.4),
    "share of words that end in !!": (0.0, 0.3),
    "share of ASCII capitals among letters": (0.15, 0.5),
    "share of words that equal the one before": (0.0, 0.2, 0.5),
    "share of distinct words": (0.3, 0.6, 0.8),
    "words": (2, 8, 40),
    "bytes per word": (2.5, 9.0),
    "share of digits": (0.05, 0.3),
    "equal to an earlier line": (0,),
    "ends in . ? ! or :": (0,),
}
_SIZES = [len(edges) + 1 for edges in FEATURES.values()]
_OFFSETS = np.cumsum([0, *_SIZES[:-1]])
N_WEIGHTS = int(sum(_SIZES))
_CAPITALS = bytes(range(65, 91))
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_DIGITS = b"0123456789"


def line_features(line: bytes, found: list[bytes], repeated: bool) -> list[int]:
    """Bucket of each feature of a line with its words."""
    n, size = len(found), len(line)
    letters = len(line.translate(None, _NOT_LETTERS)) or 1
    values = (
        (size - len(line.translate(None, SYMBOLS))) / n,
        line.count(b"!!") / n,
        (size - len(line.translate(None, _CAPITALS))) / letters,
        sum(map(bytes.__eq__, found[1:], found)) / n,
        len(set(found)) / n,
        n,
        sum(map(len, found)) / n,
        (size - len(line.translate(None, _DIGITS))) / size,
        int(repeated),
        int(found[-1][-1:] in (b".", b"?", b"!", b":")),
    )
    return [sum(v > e for e in edges) for v, edges in zip(values, FEATURES.values(), strict=True)]


@dataclass
class Lines:
    """What one pass over a text gives: base measures, and features and words per line with a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    line_words: np.ndarray


def _repeated_words(found: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(found) < 4:
        return 0
    windows = list(zip(found, found[1:], found[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(found), bool)
    for shift in range(3):
        inside[shift : shift + len(hit)] |= hit
    return int(inside.sum())


def measured(text: str | None) -> Lines:
    """Base measures and line features of a whole text; of a null those of an empty one."""
    raw = (text or "").encode()
    found = raw.split()
    earlier: set[bytes] = set()
    rows, counts, dup = [], [], 0
    for line in raw.split(b"\n"):
        if own := line.split():
            again = line in earlier
            dup += again
            earlier.add(line)
            rows.append(line_features(line, own, again))
            counts.append(len(own))
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    return Lines(
        len(found), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, _repeated_words(found),
        np.array(rows, np.int64).reshape(-1, len(FEATURES)) + _OFFSETS, np.array(counts, np.int64),
    )


@dataclass
class Chain:
    """Weights of the chain; label 1 is content."""

    emission: np.ndarray  # (2, weights)
    transition: np.ndarray  # (from, to)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Label scores of every line."""
        return self.emission[:, features].sum(axis=2).T

    def viterbi(self, features: np.ndarray) -> list[int]:
        """The best label sequence; of equal ones content is preferred at the last line that differs."""
        if not len(features):
            return []
        (aa, ab), (ba, bb) = self.transition.tolist()
        a, b = 0.0, 0.0
        back = []
        for n, (ea, eb) in enumerate(self.scores(features).tolist()):
            if n:
                from_a, from_b = b + ba > a + aa, b + bb >= a + ab
                back.append((from_a, from_b))
                a, b = max(a + aa, b + ba), max(a + ab, b + bb)
            a, b = a + ea, b + eb
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _padded(sequences: list[np.ndarray], labels: list[np.ndarray]):
    longest = max(map(len, sequences))
    x = np.zeros((len(sequences), longest, len(FEATURES)), np.int64)
    y = np.zeros((len(sequences), longest), np.int64)
    mask = np.zeros((len(sequences), longest), bool)
    for i, (s, own) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, own, True
    return x, y, mask


def fit_chain(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = _FIT_STEPS) -> Chain:
    """Maximum conditional likelihood with a ridge, by Adam on forward-backward gradients."""
    x, y, mask = _padded(sequences, labels)
    n, longest, _ = x.shape
    theta = np.zeros(2 * N_WEIGHTS + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = mask.sum()
    for step in range(1, steps + 1):
        emission, transition = theta[: 2 * N_WEIGHTS].reshape(2, -1), theta[2 * N_WEIGHTS :].reshape(2, 2)
        e = emission[:, x].sum(axis=3).transpose(1, 2, 0)  # document, line, label
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            into = np.logaddexp.reduce(forward[:, t - 1, :, None] + transition, axis=1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], into, forward[:, t - 1])
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            out = np.logaddexp.reduce(transition + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], out, 0.0)
        node = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        gradient_e = np.zeros((2, N_WEIGHTS))
        for label in (0, 1):
            error = (node[:, :, label] - ((y == label) & mask))[mask]
            gradient_e[label] = np.bincount(x[mask].ravel(), np.repeat(error, len(FEATURES)), N_WEIGHTS)
        pair = mask[:, 1:]
        joint = forward[:, :-1, :, None] + transition + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
        joint = np.exp(joint - whole[:, None, None, None]) * pair[:, :, None, None]
        gradient_t = joint.sum(axis=(0, 1))
        np.subtract.at(gradient_t, (y[:, :-1][pair], y[:, 1:][pair]), 1.0)
        gradient = np.concatenate((gradient_e.ravel(), gradient_t.ravel())) / total + _RIDGE * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[: 2 * N_WEIGHTS].reshape(2, -1), theta[2 * N_WEIGHTS :].reshape(2, 2))


def train(sequences: list[np.ndarray], good: list[bool]) -> Chain | None:
    """The chain for documents with their labels; None without documents of both kinds."""
    held = [(s, g) for s, g in zip(sequences, good, strict=True) if len(s)]
    if len({g for _, g in held}) < 2:
        return None
    lines = [s for s, _ in held]
    labels = [np.full(len(s), int(g)) for s, g in held]
    chain = fit_chain(lines, labels)
    # without the chain's memory a line of a bad document is judged by itself
    alone = Chain(chain.emission, np.zeros((2, 2)))
    labels = [own if g else np.array(alone.viterbi(s)) for s, own, (_, g) in zip(lines, labels, held, strict=True)]
    return fit_chain(lines, labels)


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_lines: int) -> tuple[list, list]:
    named = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).dropna()
    one = named.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    # both kinds in equal parts, as far as there are so many
    bad = one.filter(~F.col("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    fine = one.filter("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample - sample // 2)
    rows = bad.unionByName(fine).collect()
    if not rows:
        return [], []
    taken = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id bigint, good boolean"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [measured(t).features for t in texts(batch, 1)]
            short = [len(f) <= sample_lines for f in found]
            kept = batch.filter(pa.array(short, pa.bool_())).select(["doc_id", "good"])
            flat = [f.ravel().astype(np.int16).tobytes() for f, s in zip(found, short, strict=True) if s]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(flat, pa.binary())], ["doc_id", "good", "features"])

    held = docs.join(taken, "doc_id").select("doc_id", "text", "good").mapInArrow(run, "doc_id bigint, good boolean, features binary")
    # repeated rows of one id count once
    found = held.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("features").alias("features")).orderBy("doc_id").collect()
    sequences = [np.frombuffer(r["features"], np.int16).astype(np.int64).reshape(-1, len(FEATURES)) for r in found]
    return sequences, [r["good"] for r in found]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(
    docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, sample: int = SAMPLE,
    sample_lines: int = SAMPLE_LINES, content_share: float = CONTENT_SHARE,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with base measures and the verdict.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``. Added are the MEASURES,
    ``base_failed`` (fewer than 50 words, or more than half of them in repeated windows), ``n_lines`` and
    ``content_lines`` (lines with a word, and those labelled content), ``content_share`` (of words; 0 without any)
    and ``kept``. A null text counts as empty. Repeated rows are alike. Without labelled documents of both kinds
    every line is content. Clashing names get underscores in front. An empty table gives no rows.
    """
    carry = list(docs.columns) if carry is None else carry
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    chain = train(*_sample(plain, labels, sample, sample_lines))
    names = [fresh(carry, n) for n in (*MEASURES, "base_failed", "n_lines", "content_lines", "content_share", "kept")]
    text = fresh([*carry, *names], "whole_text")
    slim = docs.select(*map(quoted, carry), F.col("text").cast("string").alias(text))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for whole in texts(batch, len(carry)):
                m = measured(whole)
                label = np.array(chain.viterbi(m.features) if chain else [1] * len(m.features), np.int64)
                share = float((label * m.line_words).sum() / m.n_words) if m.n_words else 0.0
                failed = m.n_words < MIN_WORDS or 100 * m.n_repeat_words > MAX_REPEATED * m.n_words
                base = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
                rows.append((*base, failed, len(label), int(label.sum()), share, not failed and share >= content_share))
            added = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*carry, *names])

    fields = [T.StructField(n, kind) for n, (kind, _) in zip(names, _KINDS, strict=True)]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:-1], *fields]))


_LONG, _FLAG = (T.LongType(), pa.int64()), (T.BooleanType(), pa.bool_())
_KINDS = [*[_LONG] * 5, _FLAG, _LONG, _LONG, (T.DoubleType(), pa.float64()), _FLAG]
