"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself: its share of stop
words, its length, the share of its characters in links, and the container that it stands in. Long running text is
content; menus, notices and the like are not; blocks that are too short to tell are left open. The second pass gives
open blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warehaul.llm.common import Batches, texts

#: Frequent words of the languages of the pages.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "als auch auf aus bei das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "al con como del el es esta la las lo los más no para por que se su una y".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style title textarea noscript template iframe svg object head".split())
#: Containers that hold no article text, by tag, and by words of their class, id or role.
ASIDE_TAGS = frozenset("nav header footer aside form button select menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar side widget cookie cookies consent notice alert popup modal comment comments "
    "disqus reply replies share sharing social related recommended newsletter subscribe signup login search pagination "
    "contentinfo complementary".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Of the containers, those that may hold articles of their own; the others are taken as left open when one begins.
FIRM = frozenset("aside footer form dialog sidebar comment comments disqus reply replies related recommended".split())
#: Blocks from this many characters on are judged by their words, shorter ones by their neighbours.
LONG = 70
#: Stop-word shares from which a long block outside an article is content, and from which it is left open.
DENSE, SPARSE = 0.25, 0.10
#: Link share above which a block outside an article is no content.
LINKED = 0.3

# an attribute value may hold ">" but no "<", so that a stray quote costs no more than the text up to the next tag
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)(?:>|\Z|(?=<))""",
    re.S,
)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block with its text, its characters in links, and where it stands."""

    text: str
    linked: int
    aside: bool
    main: bool
    label: bool | None = None


def _aside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a container holds no article text, and whether not even in articles within it."""
    named = {w for value in _NAMED.findall(attributes) for w in _WORD.findall(value.lower())} | {tag}
    return tag in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(named - {tag}), not FIRM.isdisjoint(named)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, without empty ones. Unclosed and stray tags are borne with."""
    out: list[Block] = []
    parts: list[str] = []
    linked = link_depth = 0
    open_tags: list[tuple[str, bool, bool, bool]] = []  # block tags with (aside, main, firm) inside them
    outside = ("", False, False, False)

    def flush() -> None:
        nonlocal linked
        # references are decoded once the tags are out, so that a decoded "<" is text
        if text := " ".join(unescape("".join(parts)).split()):
            _, aside, main, _ = open_tags[-1] if open_tags else outside
            out.append(Block(text, min(linked, len(text)), aside, main))
        parts.clear()
        linked = 0

    at, size, inline_aside = 0, len(html), []
    while at < size:
        tag = _TOKEN.search(html, at)
        stop = tag.start() if tag else size
        if stop > at and not inline_aside:
            piece = html[at:stop]
            parts.append(piece)
            if link_depth:
                linked += len(piece.strip())
        if not tag:
            break
        at = max(tag.end(), stop + 1)
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in SKIPPED and not closing:
            if name == "head":
                continue  # its elements are skipped one by one; it is often not closed
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
        elif name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        elif name in ("button", "select"):
            if closing:
                inline_aside = inline_aside[:-1]
            elif not attributes.rstrip().endswith("/"):
                inline_aside.append(name)
        elif name in BLOCKS:
            flush()
            link_depth = 0
            inline_aside = []
            if closing:
                for depth in range(len(open_tags) - 1, -1, -1):
                    if open_tags[depth][0] == name:
                        del open_tags[depth:]
                        break
            elif name != "hr":
                if name == "p" and open_tags and open_tags[-1][0] == "p":
                    open_tags.pop()  # a paragraph ends where the next begins
                _, aside, main, firm = open_tags[-1] if open_tags else outside
                own, own_firm = _aside(name, attributes)
                if name in MAIN_TAGS and not main and not own:
                    aside, main = firm, True
                elif not (name == "header" and main):  # that is the head of the article itself
                    aside, firm = aside or own, firm or (own and own_firm)
                open_tags.append((name, aside, main, firm))
        elif name in ("td", "th", "br"):
            parts.append(" ")
    flush()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Both passes; sets every label."""
    for b in found:
        if b.aside:
            b.label = False
            continue
        if b.main:
            # an article holds tables and lists of any kind; only its short blocks are open
            b.label = True if len(b.text) >= LONG and b.linked <= len(b.text) / 2 else None
            continue
        names = [w.lower() for w in _LETTERS.findall(b.text)]
        stops = sum(w in STOP_WORDS for w in names) / (len(names) or 1)
        if b.linked > LINKED * len(b.text):
            b.label = False
        elif len(b.text) < LONG:
            b.label = None
        elif stops >= DENSE:
            b.label = True
        elif stops < SPARSE:
            b.label = False
    # second pass: the nearest decided neighbours; in an article those of the article
    first = [b.label for b in found]
    before, after = [None] * len(found), [None] * len(found)
    last: dict[bool, bool] = {}
    for i, b in enumerate(found):
        before[i] = last.get(b.main)
        if first[i] is not None and not (b.aside and b.main):
            last[b.main] = first[i]
    last = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = last.get(found[i].main)
        if first[i] is not None and not (found[i].aside and found[i].main):
            last[found[i].main] = first[i]
    for i, b in enumerate(found):
        if b.label is None:
            near = {x for x in (before[i], after[i]) if x is not None}
            # both agree, or one is missing; else, or without any, what stands in an article is content
            b.label = near.pop() if len(near) == 1 else b.main or (not near and len(b.text) >= LONG)
    return found


def main_text(html: str | None) -> tuple[str, int, int]:
    """Main text of a page, its blocks, and those of them that are content. Null and empty pages have none."""
    found = classify(blocks(html)) if html else []
    kept = [b.text for b in found if b.label]
    return "\n".join(kept), len(found), len(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``, ``html``): ``text``, ``n_chars``, ``n_blocks``, ``content_blocks``.

    Whole pages are read. Blocks are joined by one line feed; inside them white space is one space and character
    references are decoded. Null html counts as empty, whose text is empty. Repeated rows are alike; extra columns are not read.
    An empty table gives no rows. Nothing is shuffled.
    """
    slim = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [main_text(h) for h in texts(batch, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([t for t, _, _ in found], pa.string()),
                    *[pa.array([f(x) for x in found], pa.int64()) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2])],
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "content_blocks"],
            )

    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, content_blocks bigint")
