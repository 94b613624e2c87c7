"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass judges each block by itself: by the
part of the page that it stands in, by link density, by length and by the density of stop words. Short
and middling blocks stay undecided; in the second pass they take the label of the nearest decided
neighbours. Neighbours are looked for inside the same article or outside of all, never across.

Stop words count only on pages that use the known ones; on others, length and links decide. A name that hints at a
part beside the article does not count where it would hide the only articles of a page or, on a page
without any, most of its text. Inside an article only such parts are left out. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import portions

BATCH_BYTES = 4_000_000
SHORT, LONG = 70, 200
#: Hinting containers within each other that are told apart; deeper ones count as the last of them.
NESTED = 8
LINKS, STOPS_LOW, STOPS_HIGH = 0.35, 0.15, 0.3

#: Common words of four languages.
STOP_WORDS = frozenset((
    "a an and are as at be been but by can for from had has have he her his if in is it its not of on or our she so "
    "that the their there they this to was we were what which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que "
    "qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht "
    "noch nur oder sich sie sind so um und von vor war wie wird zu zum zur "
    "al como con del el ella ellos en era es esta este está fue ha hay la las lo los más me mi muy no nos o para pero "
    "por que se si sin su sus también un una y ya").split())
#: Elements whose content is no text.
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "svg", "canvas", "template", "object", "math")
#: Elements whose names are no hints.
ROOTS = ("html", "body", "article", "main")
#: Elements that stand beside the article. A page header is one unless it stands inside an article.
BESIDE = frozenset("nav aside footer form button select menu dialog fieldset header".split())
#: Words in class, id or role that mark parts beside the article.
HINTS = frozenset((
    "ad ads adv advert advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar widget menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended "
    "comment comments disqus reply replies respond copyright disclaimer contentinfo complementary search hidden").split())
BLOCK = frozenset((
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address hr center details summary").split()) | BESIDE
#: Words that a hinting name may hold besides.
PLAIN = frozenset((
    "area article bar block body bottom box btn button buttons col column container content elements entry form global "
    "group header inner item items left link links list main outer page panel post posts primary reader right row "
    "secondary section site slot text title top unit user wrap wrapper zone").split())
#: Blocks whose end tag may be left out.
OPEN_ENDED = frozenset("p li dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])|[^<]+|<", re.S)
_UNQUOTED = re.compile(r"[^<>\"']*")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    links: int
    beside: bool  # by its element, or hidden
    hints: tuple[int, ...]  # the hinting containers around it
    article: int  # the number of the article around it, 0 outside
    label: str = ""

    @property
    def size(self) -> int:
        """Code points; a text almost without spaces says as much in a third of them."""
        n = len(self.text)
        return n if self.text.count(" ") * 15 >= n else 3 * n

    @property
    def wordy(self) -> bool:
        return self.links / len(self.text) <= LINKS


def _beside(tag: str, marks: str, inside: bool) -> bool:
    if tag in BESIDE and not (tag == "header" and inside):
        return True
    return bool(marks) and tag not in ROOTS and bool(
        re.search(r"(?:^|\s)hidden(?:\s|=|$)", marks) or re.search(r"display\s*:\s*none", marks, re.I))


def _hinting(tag: str, marks: str) -> bool:
    """Whether a class, id or role is made of hinting words, with none but plain words besides."""
    if not marks or tag in ROOTS:
        return False
    for m in _MARK.finditer(marks):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if any(p in HINTS for p in parts) and all(p in HINTS or p in PLAIN for p in parts):
                return True
    return False


class _Tags:
    """Finds the ends of tags. Quotes hide what ends a tag, until one tag has run to the end of the page."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``; -1 if another tag begins before it ends."""
        begin = at
        while True:
            at = _UNQUOTED.match(self.page, at).end()
            if at == len(self.page):
                break
            if self.page[at] in "<>":
                return at + 1 if self.page[at] == ">" else -1
            at = self.page.find(self.page[at], at + 1) + 1 if self.quotes else at + 1
            if not at:
                break
        if self.quotes:
            self.quotes = False
            return self.end(begin)
        return -1


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order with their place; blocks without text are left out."""
    found: list[Block] = []
    # Open block and marked inline elements: tag, beside the article, hinting containers, article.
    stack: list[tuple[str, bool, tuple[int, ...], int]] = []
    opened: Counter[str] = Counter()
    words: list[str] = []
    links = breaks = articles = containers = 0
    anchor = False
    at = 0
    tags = _Tags(page)

    def close() -> None:
        nonlocal words, links
        text = " ".join("".join(words).split())
        if text:
            found.append(Block(text, min(links, len(text)), *(stack[-1][1:] if stack else (False, (), 0))))
        words, links = [], 0

    def push(tag: str, *place) -> None:
        stack.append((tag, *place))
        opened[tag] += 1

    def cut(i: int) -> None:
        for entry in stack[i:]:
            opened[entry[0]] -= 1
        del stack[i:]

    while (token := _TOKEN.match(page, at)) is not None:
        begin, at = at, token.end()
        tag = (token[2] or "").lower()
        if tag:
            behind = tags.end(at)
            marks, at = (page[at:behind - 1], behind) if behind > 0 else ("", begin + 1)
            tag = tag if behind > 0 else ""
        if not tag:
            raw = page[begin:at]
            if raw[0] != "<" or raw == "<":
                text = html.unescape(raw)
                words.append(text)
                if text.strip():
                    breaks = 0
                    links += len(" ".join(text.split())) if anchor else 0
            continue
        if token[1]:
            if tag == "a":
                anchor = False
            elif tag in BLOCK:
                close()
                if opened[tag]:
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif opened[tag]:  # an inline element ends at its own tag, over unclosed paragraphs and items but no other block
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close()
                        cut(i)
                        break
                    if stack[i][0] in BLOCK and stack[i][0] not in OPEN_ENDED:
                        break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            words.append(" ")
            breaks += 1
            if breaks > 1:
                close()
        elif tag == "a":
            anchor = True
        elif tag in BLOCK:
            close()
            breaks, anchor = 0, False
            if tag in VOID:
                continue
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), -1)
            if last >= 0 and (stack[last][0] == tag == "li" or stack[last][0] == "p" and tag not in ("button", "select")):
                cut(last)  # with the inline elements left open in it
            beside, hints, article = stack[-1][1:] if stack else (False, (), 0)
            if tag in ("article", "main") and not article:
                articles += 1
                article = articles
            if len(hints) < NESTED and _hinting(tag, marks):
                containers += 1
                hints += (containers,)
            push(tag, beside or _beside(tag, marks, article > 0), hints, article)
        elif tag in VOID:
            continue
        elif (hidden := _beside("", marks, False)) or _hinting("", marks):  # a marked inline element is a part of its own
            close()
            beside, hints, article = stack[-1][1:] if stack else (False, (), 0)
            if not hidden and len(hints) < NESTED:
                containers += 1
                hints += (containers,)
            push(tag, beside or hidden, hints, article)
        elif opened[tag]:  # one of the same name in a marked one: counted, so that each end tag finds its own
            push(tag, *stack[-1][1:])
    close()
    return found


def place(blocks: list[Block]) -> None:
    """Turn hints into places beside the article, but for hints that would hide what the page is about."""
    open_ = [b for b in blocks if not b.beside]
    around: dict[int, set[int]] = {}  # of each article, the hints that all of it stands in
    for b in open_:
        if b.article:
            around[b.article] = around.get(b.article, set(b.hints)) & set(b.hints)
    if around:
        # One article outside of all hints shows that the others are parts beside it, such as comments.
        void = set() if any(not hints for hints in around.values()) else set().union(*around.values())
    else:
        whole = sum(b.size for b in open_ if b.wordy)
        sizes: Counter[int] = Counter()
        for b in open_:
            for h in b.hints if b.wordy else ():
                sizes[h] += b.size
        void = {h for h, n in sizes.items() if 2 * n > whole}
    for b in blocks:
        b.beside = b.beside or any(h not in void for h in b.hints)


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?*$%&#|()[]\"'").lower() for w in text.split()]


def foreign(blocks: list[Block]) -> bool:
    """Whether the text of a page holds too few of the known stop words to judge it by them."""
    words = [w for b in blocks if not b.beside and b.wordy and b.size >= SHORT for w in _words(b.text)]
    return sum(w in STOP_WORDS for w in words) < STOPS_LOW * len(words)


def judge(block: Block, unknown: bool = False) -> str:
    """First pass: good, bad, or undecided as near (to good) or short. ``unknown``: stop words say nothing."""
    if block.beside or not block.article and (not block.wordy or block.text.startswith("©")):
        return "bad"
    if block.size < SHORT:
        return "short"
    words = _words(block.text)
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if (unknown or stops >= STOPS_HIGH) and block.wordy and block.size >= LONG:
        return "good"
    return "near" if unknown or block.article or stops >= STOPS_LOW else "bad"


def settle(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided ones on both sides.

    If the two sides differ, a near block is good and a short one follows the nearer side, at equal
    distance the good one. Parts beside the article are no neighbours. Without any decided
    neighbour, near blocks and all blocks of an article are good.
    """
    def side(order: range) -> dict[int, tuple[int, str]]:
        seen: dict[int, tuple[int, str]] = {}
        near = {}
        for i in order:
            b = blocks[i]
            if b.beside:
                continue
            if first[i] in ("good", "bad"):
                seen[b.article] = (i, first[i])
            elif b.article in seen:
                near[i] = (abs(i - seen[b.article][0]), seen[b.article][1])
        return near

    place(blocks)
    unknown = foreign(blocks)
    first = [judge(b, unknown) for b in blocks]
    before, after = side(range(len(blocks))), side(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        b.label = first[i]
        if b.label in ("good", "bad"):
            continue
        sides = [s[i] for s in (before, after) if i in s]
        labels = {label for _, label in sides}
        if not sides:
            b.label = "good" if first[i] == "near" or b.article else "bad"
        elif len(labels) == 1:
            b.label = labels.pop()
        elif first[i] == "near":
            b.label = "good"
        else:
            b.label = min(sides, key=lambda s: (s[0], s[1] != "good"))[1]


def main_text(page: str) -> tuple[str, int, int]:
    """The text of the good blocks, their number, and the number of all blocks."""
    blocks = blocks_of(page)
    settle(blocks)
    good = [b.text for b in blocks if b.label == "good"]
    return "\n\n".join(good), len(good), len(blocks)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``pages`` without ``page``, with ``text``, ``n_blocks`` and ``n_good`` instead.

    A null page is empty and has an empty text. Other columns travel along; one that is named as a
    result, in any case, is replaced by it. Repeated rows are kept; an empty table gives an empty one.
    """
    results = ("text", "n_blocks", "n_good")
    others = [c for c in pages.columns if c.lower() not in (page.lower(), *results)]
    held = "_page"
    while held in (c.lower() for c in others):
        held += "_"
    chosen = pages.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(page).cast("string"), F.lit("")).alias(held))
    schema = chosen.drop(held).schema.add("text", "string").add("n_blocks", "long").add("n_good", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH_BYTES, held):
            found = [main_text(p) for p in batch.column(held).to_pylist()]
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()),
                           pa.array([f[1] for f in found], pa.int64())], names=[*others, *results])

    return chosen.mapInArrow(run, schema)
