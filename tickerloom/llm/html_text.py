"""Main text of web pages by line-block distribution.

Markup is stripped and every block element ends a line. A line weighs what it has of text outside links; lines in menus,
footers, adverts, forms, comments and the like weigh nothing. Weights are summed over a sliding window of lines: the text
begins where the sum surges and ends where it has dived; it must rise above a threshold, or be the highest of its part of
the page. Each article element is a part, whose lines count with their links, and what is outside of them is another. Marks
only choose among the regions that the sums have found: those of articles are kept, unless the regions outside hold much
more. An article that is a comment weighs nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.common import Batches, texts_of

#: Lines of a window, the sum from which it is text, and the part of that below which the text ends.
WINDOW, SURGE, DIVE = 3, 86, 8
#: How many times the text of the largest article the regions outside must hold to be taken instead.
OUTWEIGHS = 3

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
#: Their content is no text at all.
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "head", "textarea")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog menu fieldset label input".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv adbox adslot banner banners sponsor sponsored promo promos promotion breadcrumb breadcrumbs nav menu menus"
    " masthead topbar sidebar footer foot cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup respond reply replies disqus share sharing social related recommended"
    " recommendations widget widgets form login search copyright legal pagination pager toolbar skip header".split()
)
_BOILERPLATE_STARTS = ("advert", "comment", "cookie", "navig", "navbar", "sidebar")
#: Class or id of an article element that is a reader's comment.
_COMMENT = re.compile(r"(?:(?!has|no|with|allow|show)[a-z]+[-_])?(?:comments?|reply|replies)(?:[-_](?!open|closed|off).*)?")
#: Elements that close themselves when another of them begins.
_SIBLINGS = {"p": "p", "li": "li", "dd": "dd", "dt": "dt", "option": "option", "tr": "tr", "td": "td", "th": "th"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


@dataclass
class Line:
    text: str
    linked: int
    boilerplate: bool
    article: int  # which article element, 0 for none

    @property
    def weight(self) -> int:
        """Characters outside links; nothing for lines of a menu or the like."""
        return 0 if self.boilerplate else max(0, len(self.text) - self.linked)


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article."""
    found = {}
    if attributes.strip():
        for k, v in _ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), v.strip("\"'").lower())
    role = found.get("role", "")
    article = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "")
    if tag in _BOILERPLATE_TAGS or role in _BOILERPLATE_ROLES or (tag == "header" and not in_article):
        return True, False
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True, False
    own = f"{found.get('class', '')} {found.get('id', '')}"
    if tag == "article" and (
        any(map(_COMMENT.fullmatch, own.split())) or found.get("itemprop") == "comment" or found.get("itemtype", "").endswith("/comment")
    ):
        return True, False
    names = re.split(r"[^a-z0-9]+", own)
    for name in names:
        if name.startswith(_BOILERPLATE_STARTS) or (name in _BOILERPLATE_NAMES and not (name == "header" and in_article)):
            # A wrapper that only names its layout doesn't hide the body or the article.
            return tag not in ("html", "body", "article", "main"), article and tag in ("article", "main")
    return False, article


def lines_of(page: str) -> list[Line]:
    """The lines of a page: text of each block, without markup, with its references decoded and white space folded."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # tag, boilerplate, article
    there: Counter[str] = Counter()  # tags of the stack, so that a stray end tag is no search
    articles = links = 0
    boilerplate, article = False, 0

    def end_line() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, min(linked, len(text)), boilerplate, article))
        parts, linked = [], 0

    def text_at(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        text_at(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _BLOCKS:
            end_line()
        if not closing:
            if tag in _RAW_END and not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                if end is None and tag != "head":
                    at = len(page)
                elif end is not None:
                    at = end.end()
                continue
            if tag in _VOID:
                continue
            if tag in _SIBLINGS and stack and stack[-1][0] == _SIBLINGS[tag]:
                there[stack.pop()[0]] -= 1
            there[tag] += 1
            hidden, is_article = _marks(tag, attributes, article > 0)
            if tag == "a":
                links += 1
            above = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if is_article and not above[1]:
                articles += 1
                stack.append((tag, False, articles))  # an article ends what was left open around it
            else:
                stack.append((tag, hidden or above[0], above[1]))
        else:
            if tag == "a":
                links = max(0, links - 1)
            while there[tag]:
                last = stack.pop()[0]
                there[last] -= 1
                if last == tag:
                    break
        boilerplate, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
    rest = page[at:]
    text_at(rest[: rest.index("<")] if re.search(r"<[A-Za-z/!][^>]*\Z", rest) else rest)
    end_line()
    return lines


def regions(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Runs of lines around a surge of the window sums, from the last dive before it to the next."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    dive = max(1, surge // DIVE)
    out, begin, low = [], None, 0
    for i, total in enumerate(sums):
        if total < dive:
            low = i + 1
        if begin is None and total >= surge and weights[i]:
            begin = next(j for j in range(low, i + 1) if weights[j])
        if begin is not None and (total < dive or i + 1 == len(sums)):
            last = max(j for j in range(begin, min(len(weights), i + window)) if weights[j])
            out.append((begin, last + 1))
            begin = None
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _text_regions(lines: list[Line], weights: list[int], window: int, surge: int) -> tuple[list[Line], int]:
    """Lines of the regions of a part of a page, and how many characters they have outside links."""
    highest = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)
    spans = regions(weights, window, max(1, min(surge, highest)))
    own = [line for a, b in spans for line, w in zip(lines[a:b], weights[a:b], strict=True) if w]
    return own, sum(line.weight for line in own)


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a whole page; empty if it has none."""
    lines = lines_of(page)
    parts: dict[int, list[Line]] = {}
    for line in lines:
        parts.setdefault(line.article, []).append(line)
    outside = parts.pop(0, [])
    taken, size = _text_regions(outside, [line.weight for line in outside], window, surge)
    found = {}
    for article, own in parts.items():
        weights = [0 if line.boilerplate else len(line.text) for line in own]
        found[article] = _text_regions(own, weights, window, surge)
    largest = max((n for _, n in found.values()), default=0)
    if any(own for own, _ in found.values()) and size <= OUTWEIGHS * largest:
        # Teasers of other articles are much shorter than the article of a page.
        taken = [line for own, n in found.values() if 2 * n >= largest for line in own]
    kept = set(map(id, taken))
    return " ".join(line.text for line in lines if id(line) in kept)


def main_texts(pages: DataFrame, html_col: str = "html", kept: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``kept`` columns, text and n_chars (its code points) of every page.

    A null or empty page, and one without text, has the empty text. Repeated rows each give a row; other columns are
    ignored; an empty table gives no rows. One pass without a shuffle.
    """
    kinds = dict(pages.dtypes)
    picked = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(kept)], pages[html_col].alias("html"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p) for p in texts_of(batch, "html")]
            arrays = [*batch.columns[: len(kept)], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(len(kept))), "text", "n_chars"])

    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(kept)), "text string", "n_chars long"])
    return picked.mapInArrow(run, schema).toDF(*kept, "text", "n_chars")
