"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Four labelers vote on each (yes, no or silent): a strict form check, a
gazetteer (top-level domains, card issuers, calling codes, countries), cue words in the context, and the edges
of the span. Expectation-maximisation over the counts of vote patterns estimates how far each labeler can be
trusted and how likely each pattern is personal data. With these soft labels a logistic classifier over the
kind, the votes and the form of the span is trained; it decides on the candidates beyond the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warehaul.llm.common import fresh, quoted
from warehaul.session import materialised

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
LABELERS = ("form", "gazetteer", "context", "edge")
#: Code points before a span that are searched for cue words.
CONTEXT = 48
#: Buckets of the span's length, and of the share of digits in it.
LENGTHS = (12, 20, 32)
SHARES = (0.1, 0.5, 0.9)
EM_ROUNDS = 60

#: Base patterns. Possessive quantifiers and the look-behind (or the end of the match before) keep long runs
#: linear and change no match: a run that fails from its start fails from every later place. A card needs 14
#: digits at least; a run of digits that is shorter is never one.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Further candidates.
LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{20,}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: (kind, pattern, text must match first, part of the base rules)
PATTERNS = (
    (0, EMAIL, "@", True),
    (1, IP, r"[0-9]\.[0-9]", True),
    (2, CARD, r"[0-9][ -]?[0-9][ -]?[0-9]", True),
    (3, PHONE, r"\+[0-9]", True),
    (3, LOCAL_PHONE, r"[0-9]{3}[ .-][0-9]{4}", False),
    (4, SECRET, r"[0-9][A-Za-z_]|[A-Za-z_][0-9]", False),
    (5, SSN, r"[0-9]-[0-9]{2}-[0-9]", False),
    (6, IBAN, r"[A-Z]{2}[0-9]{2}", False),
)

#: Cue words by kind.
CUES = (
    "mail|contact|write|e-mail|correo|courriel",
    r"\bip\b|host|server|address|login|client",
    "card|visa|master|amex|payment|credit|debit|karte|carte|tarjeta",
    "phone|call|tel|fax|mobile|whatsapp|number",
    "token|key|secret|passw|pwd|auth|bearer|credential",
    "ssn|social security|social",
    "iban|account|bank|konto|compte|cuenta",
)
AGAINST = "version|section|chapter|isbn|page |release|build "
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|br|mx|ar|jp|cn|in|au"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
COUNTRIES = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE)"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."


def _places(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, hit) of all matches, in code points; the parts between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    nothing = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    walked = F.aggregate(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), nothing.alias("out")),
        step,
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(needs), walked).otherwise(nothing)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _small_parts(hit: Column) -> Column:
    return F.forall(
        F.split(hit, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 3) | (F.regexp_replace(p, "^0+", "").rlike("^(?:1..|2[0-4].|25[0-5])$")),
    )


def _form(kind: int, hit: Column) -> Column:
    """The strict check of a kind; for the base kinds the rule that a base span must pass."""
    digits = _digits(hit)
    return (
        F.lit(True),
        _small_parts(hit),
        F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        F.length(digits).between(10, 15),
        hit.rlike("[A-Za-z]") & (hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | (hit.rlike("[a-z]") & hit.rlike("[A-Z]"))),
        ~hit.rlike("^(?:000|666|9)|-00-|-0000$"),
        F.length(F.regexp_replace(hit, " ", "")).between(15, 34),
    )[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: int, hit: Column) -> Column:
    never = F.lit(False)
    return (
        _vote(hit.rlike(rf"(?i)\.(?:{TOP_LEVEL})$"), ~hit.rlike(r"\.[A-Za-z]{2,}$")),
        _vote(~hit.rlike(RESERVED), hit.rlike(RESERVED)),
        _vote(_digits(hit).rlike(ISSUERS), never),
        _vote(hit.rlike(CALLING), never),
        _vote(F.length(hit).isin(32, 40, 64) | hit.rlike("^(?:AKIA|ghp_|sk_|xox)"), never),
        _vote(never, hit.rlike("^(?:123-45-6789|078-05-1120)$")),
        _vote(hit.rlike(COUNTRIES), ~hit.rlike(COUNTRIES)),
    )[kind]


def _bucket(value: Column, edges: tuple) -> Column:
    return sum((value >= e).cast("int") for e in edges)


def _described(whole: Column, kind: int, base: bool):
    """What a candidate of one pattern becomes: place, votes and features."""

    def run(c: Column) -> Column:
        hit, start, end = c["hit"], c["start"], c["end"]
        form = _form(kind, hit)
        before = F.lower(F.substring(whole, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
        edges = F.concat(F.substring(before, -1, 1), F.lit(" "), F.substring(whole, end + 1, F.lit(1)))
        return F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (form if base else F.lit(False)).alias("base"),
            F.when(form, 1).otherwise(-1).alias("form"),
            _gazetteer(kind, hit).alias("gazetteer"),
            _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("context"),
            F.when(edges.rlike("[A-Za-z0-9]"), -1).otherwise(1).alias("edge"),
            _bucket(F.length(hit), LENGTHS).alias("length"),
            _bucket(F.length(_digits(hit)) / F.length(hit), SHARES).alias("share"),
        )

    return run


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes and features, as an array of structs; of a null none."""
    whole = F.coalesce(text, F.lit(""))
    parts = [
        F.transform(_places(whole, pattern, needs), _described(whole, kind, base))
        for kind, pattern, needs, base in PATTERNS
    ]
    return F.array_sort(F.concat(*parts))


def _beyond_base(found: Column) -> Column:
    """Candidates without those that are not base themselves and overlap a base span."""
    base = F.filter(found, lambda c: c["base"])
    return F.filter(
        found,
        lambda c: c["base"] | ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )


def expectation_maximisation(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
    """Posterior of every vote pattern, and for each labeler the chances of its votes (-1, 0, 1) under no and yes.

    The truth is hidden, labelers are taken as independent given it. Each kind has a prior of its own.
    """
    chances = np.tile(np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]), (votes.shape[1], 1, 1))
    prior = np.full(len(KINDS), 0.5)
    posterior = np.full(len(votes), 0.5)
    for _ in range(rounds):
        log = np.log(np.stack([1 - prior[kinds], prior[kinds]], 1))
        for k in range(votes.shape[1]):
            log += np.log(chances[k][:, votes[:, k] + 1]).T
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        for k in range(votes.shape[1]):
            for truth, share in ((0, 1 - posterior), (1, posterior)):
                seen = np.bincount(votes[:, k] + 1, counts * share, 3) + (1.0, 1.0, 1.0)
                chances[k, truth] = seen / seen.sum()
        yes = np.bincount(kinds, counts * posterior, len(KINDS)) + 1
        prior = yes / (np.bincount(kinds, counts, len(KINDS)) + 2)
    return posterior, chances


@dataclass
class Classifier:
    """Logistic weights: bias by kind, weights by vote of each labeler, by length and by share of digits."""

    kind: list[float]
    votes: list[list[float]]
    length: list[float]
    share: list[float]

    def chance(self, c: Column) -> Column:
        def pick(weights: list[float], place: Column) -> Column:
            return F.element_at(F.array(*map(F.lit, weights)), place + 1)

        logit = pick(self.kind, c["kind"]) + pick(self.length, c["length"]) + pick(self.share, c["share"])
        for name, weights in zip(LABELERS, self.votes, strict=True):
            logit += pick(weights, c[name] + 1)
        return 1 / (1 + F.exp(-logit))


def train(found: DataFrame, column: str) -> Classifier:
    """The classifier for the candidates in ``column``.

    Only counts per pattern of kind, votes and features reach the driver: at most 7 * 81 * 16 rows.
    """
    names = ["kind", *LABELERS, "length", "share"]
    each = found.select(F.explode(quoted(column)).alias("c"))
    rows = each.groupBy(*[F.col("c")[n].alias(n) for n in names]).agg(F.count("*").alias("n")).collect()
    if not rows:
        return Classifier([0.0] * 7, [[0.0] * 3] * 4, [0.0] * 4, [0.0] * 4)
    table = np.array(sorted(tuple(r) for r in rows), np.int64)
    kinds, votes, counts = table[:, 0], table[:, 1:5], table[:, 7].astype(float)
    target, _ = expectation_maximisation(votes, kinds, counts)
    parts = [np.eye(7)[kinds], *(np.eye(3)[votes[:, k] + 1] for k in range(4)), np.eye(4)[table[:, 5]], np.eye(4)[table[:, 6]]]
    x = np.concatenate(parts, 1)
    weights = np.zeros(x.shape[1])
    # common patterns must not drown the rare ones
    scale = np.sqrt(counts) / np.sqrt(counts).sum()
    for _ in range(40):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (scale * (p - target)) + 1e-3 * weights
        curve = (x * (scale * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    w = [float(v) for v in weights]
    return Classifier(w[:7], [w[7 + 3 * k : 10 + 3 * k] for k in range(4)], w[19:23], w[23:27])


def detected(docs: DataFrame, text_column: str = "text", carry: list[str] | None = None, name: str = "spans") -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with their spans as an array column ``name``.

    A span is (start, kind, end, base): places in code points, the kind as index into KINDS, and whether the
    base rules found it. Spans are sorted by start, then kind. A null text has none. Repeated rows are alike.
    An empty table gives no rows. Nothing but counts of patterns is shuffled; candidates (and the carried
    columns) are written to the shared folder once, so that texts are searched once.
    """
    carry = list(docs.columns) if carry is None else carry
    proposed = fresh(carry, "candidates")
    taken = docs.select(
        *map(quoted, carry), _beyond_base(candidates(F.col(quoted(text_column)).cast("string"))).alias(proposed)
    )
    taken = materialised(taken, "candidates")
    model = train(taken, proposed)
    chosen = F.filter(quoted(proposed), lambda c: c["base"] | (model.chance(c) >= 0.5))
    spans = F.transform(chosen, lambda c: F.struct(c["start"], c["kind"], c["end"], c["base"]))
    return taken.select(*map(quoted, carry), spans.alias(name))


def _joined(spans: Column) -> Column:
    named = F.array(*map(F.lit, KINDS))
    text = lambda c: F.concat_ws(":", F.element_at(named, c["kind"] + 1), c["start"], c["end"])
    return F.array_join(F.transform(spans, text), ",")


def summary(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): base counts, digest of the base spans, all spans as text."""
    found = detected(docs.select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda c: c["base"])
    kinds = F.transform(base, lambda c: c["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    ``length_column``, where there is one, is the new number of code points. Null texts stay null.
    """
    name = fresh(docs.columns, "spans")
    found = detected(docs, text_column, name=name)
    text = F.col(quoted(text_column))
    named = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, c: Column) -> Column:
        apart = c["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, c["start"] - acc["at"])
        more = F.array(kept, F.element_at(named, c["kind"] + 1))
        return F.struct(
            F.greatest(acc["at"], c["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    new = F.when(F.size(quoted(name)) > 0, F.aggregate(quoted(name), start, step, end)).otherwise(text)
    out = found.withColumn(text_column, new)
    if length_column in docs.columns:
        changed = (F.size(quoted(name)) > 0) & text.isNotNull()
        out = out.withColumn(length_column, F.when(changed, F.length(text).cast("bigint")).otherwise(F.col(quoted(length_column))))
    return out.select(*map(quoted, docs.columns))
