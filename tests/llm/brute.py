"""Plain versions of the operators' contracts, row by row."""

import hashlib
import re

import xxhash

WORD = r"[^\x20\x09-\x0D]+"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if re.search(WORD, line) and line in lines[:i])
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def _luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def personal(text):
    """(kind, start, end) by start, then kind."""
    found = [
        (m.start(), KINDS.index(k), m.end())
        for k, p in PATTERNS.items()
        for m in re.finditer(p, text or "")
        if _passes(k, m.group())
    ]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def personal_digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in personal(text)).encode()).hexdigest()


def licences(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = sorted(
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels


def fingerprint(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fingerprints):
    """Smallest reachable id of every id, over all pairs."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def word_distance(item, text):
    """Smallest word edit distance from an item to any consecutive part of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def captures(pages):
    """(page_id, bytes, sha1, type, refers to) of (page_id, html) rows."""
    raw = [(i, (h or "").encode()) for i, h in pages]
    last = {}
    for i, b in raw:
        if len(b) >= 1000:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in raw:
        again = len(b) >= 1000 and last[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return out
