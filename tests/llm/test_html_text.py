"""Main text by window sums alone, on pages without marks, and hostile markup."""

import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tickerloom.llm import html_text


def _pages():
    return [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


@pytest.mark.parametrize(("names", "least"), [(True, 0.95), (False, 0.93)])
def test_pages_without_marks(names, least):
    """With every semantic element a div, and without classes, the windows still find the text that the marks point to."""
    both = found = wanted = 0
    for page in _pages():
        plain = re.sub(r"<(/?)(article|main|header|footer|nav|aside|section)\b", r"<\1div", page)
        if not names:
            plain = re.sub(r'\s(?:class|id|role)="[^"]*"', "", plain)
        a, b = (Counter(html_text.main_text(p).split()) for p in (plain, page))
        both, found, wanted = both + sum((a & b).values()), found + sum(a.values()), wanted + sum(b.values())
    assert both >= 0.995 * wanted and both >= least * found


def test_marks_only_choose_among_regions():
    text = "".join(f"<p>Sentence {i} of the body, which is long enough to be text.</p>" for i in range(5))
    short = "<p>a</p>" * 12
    page = f"<article>{text}{short}</article><div><p>Some other words that stand outside of the article, at length.</p></div>"
    got = html_text.main_text(page)
    # Scraps after the dive go although they are marked, and what is outside goes although it is a region.
    assert got.startswith("Sentence 0") and "outside" not in got and got.count(" a") < 12
    assert html_text.main_text("<article><p>only</p></article>") == "only"


def test_surge_and_dive():
    assert html_text.regions([0, 5, 30, 90, 40, 0, 0, 0, 0, 200, 0], 3, 86) == [(1, 5), (9, 10)]
    assert html_text.regions([], 3, 86) == [] and html_text.regions([1, 1], 3, 86) == []


def test_stray_end_tags_take_linear_time():
    took = []
    for n in (4000, 32_000):
        start = time.process_time()
        html_text.main_text("<div>" * n + "</span>x" * n)
        took.append(time.process_time() - start)
    assert took[1] < 40 * max(took[0], 0.01)
