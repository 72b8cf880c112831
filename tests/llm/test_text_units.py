"""Parts of the corpus operators that need no Spark session."""

import base64
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import byte_bpe, decontaminate, html_text, katz, language, quality, toxicity, url_rules
from tickerloom.llm.exact_dedup import ContentTable, better
from tickerloom.llm.gray_index import GrayForest, gray_rank

RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = _tiktoken()
CODECS = [byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf) for leaf in (1, 3, byte_bpe.LEAF_BYTES)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_library(text):
    for codec in CODECS:
        ids = codec.encode(text)
        assert ids == ENCODING.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces():
    rng = random.Random(1)
    for text in ("ab" * 4000, "a" * 9001, "".join(rng.choice("abeéth ") for _ in range(5000)), "", "\n\n \t"):
        for codec in CODECS:
            assert codec.encode(text) == ENCODING.encode_ordinary(text)


def test_gray_rank_neighbours_differ_in_one_bit():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(1000))


@pytest.mark.parametrize("seed", range(4))
def test_gray_forest_finds_all_close_pairs(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = []
    for c in centre:
        for _ in range(60):
            flips = rng.integers(0, 64, rng.integers(0, 6))
            codes.append(int(c) ^ int(sum(1 << int(b) for b in set(flips.tolist()))))
    code = np.array(sorted(set(codes)), np.uint64)
    group = rng.integers(0, 3, len(code))
    forest = GrayForest(group, code)
    found = set()
    for a, b in forest.close_pairs(2):
        found |= {tuple(sorted((int(x), int(y)))) for x, y in zip(forest.order[a], forest.order[b], strict=True)}
    want = {
        (i, j)
        for i, j in combinations(range(len(code)), 2)
        if group[i] == group[j] and (int(code[i]) ^ int(code[j])).bit_count() <= 2
    }
    assert found == want and want


def test_content_table_compares_contents():
    table, known = ContentTable(), {}
    rng = random.Random(2)
    for _ in range(5000):
        content = bytes(rng.choices(b"ab", k=rng.randrange(9)))
        entry, at = table.find(content)
        if content in known:
            assert entry == known[content]
        else:
            assert entry == -1
            known[content] = table.add(content, at)


def test_row_that_stays():
    assert better((3, 1, 0), (4, 9, 1)) == (4, 9, 1)
    assert better((3, 2, 0), (3, 1, 1)) == (3, 1, 1)
    assert better((3, None, 0), (3, 7, 1)) == (3, 7, 1)
    assert better((3, 7, 5), (3, 7, 1)) == (3, 7, 1)


def _distance(pattern, text):
    """Fewest edits between the pattern and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_fitting_distance(pattern, text):
    assert decontaminate.fitting_distance(pattern, text) == _distance(pattern, text)


def _words(rng, n):
    parts = ["an", "er", "th", "on", "re", "ing", "tion", "ly", "sh", "ou", "ha"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n)]


def test_edited_items_are_found_and_clean_texts_left_alone():
    rng = random.Random(3)
    items = [(i, " ".join(_words(rng, rng.randrange(15, 70)))) for i in range(40)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in items], decontaminate.Search())
    wanted = found = 0
    for i, text in items:
        for rate in (0.0, 0.05, 0.1):
            words = [rng.choice(_words(rng, 3)) if rng.random() < rate else w for w in text.split()]
            around = _words(rng, 400)
            at = rng.randrange(400)
            doc = " ".join(around[:at] + words + around[at:])
            near = _distance(text, " ".join(words)) <= 0.2 * len(text)
            hit = any(h[0] == i for h in index.hits([doc.encode()])[0])
            assert hit or rate
            wanted += near
            found += hit and near
    assert found >= 0.9 * wanted
    assert index.hits([" ".join(_words(rng, 3000)).encode() for _ in range(5)]) == [[]] * 5
    assert index.hits([b"", b"a", items[0][1].upper().replace(" ", "\n").encode()])[2][0][0] == 0


def test_short_and_empty_items():
    index = decontaminate.ItemIndex([(1, b"alpha beta"), (2, b""), (3, b"gamma")], decontaminate.Search())
    assert [sorted(h[0] for h in hits) for hits in index.hits([b"x alpha  beta y gamma", b"", b"alpha"])] == [[1, 3], [], []]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = [toxicity.Term("moron", False, 1.0), toxicity.Term("worthless", False, 1.0), toxicity.Term("scum", False, 1.0), toxicity.Term("vequ", True, 0.9)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("moranwthlescuvq", max_size=11), st.sampled_from(["moron", "worthless", "scum", "vequis"]).flatmap(
    lambda w: st.tuples(st.integers(0, len(w)), st.sampled_from("xmo")).map(lambda t: w[: t[0]] + t[1] + w[t[0] :]))))
def test_automaton_equals_distances(word):
    got = toxicity.LexiconAutomaton(TERMS).match(word)
    near = [(_edits(word, t.text), i) for i, t in enumerate(TERMS) if not t.stem and _edits(word, t.text) <= t.edits]
    if word.startswith("vequ"):
        assert got == (3, 0)
    else:
        assert got == (min(near)[::-1] if near else None)


def test_quotation_is_no_abuse():
    model = toxicity.Model(TERMS)
    automaton = model.automaton()

    def evidence(text):
        return sum(c for _, _, _, c in toxicity.hits(text, automaton, model.benign)[1])

    assert evidence('the word "moron" is an insult') == 0
    assert evidence("you are a moron") > evidence("a moron here") == 1.0
    assert evidence('he shouted "moron" there') < 0.5
    assert evidence("you m0ron") > 1 and evidence("MORON!") == 1 and evidence("") == 0


def test_learned_terms_are_words_or_stems():
    rows = [("loser", 90, 0), ("lose*", 95, 9), ("loweia", 10, 0), ("loweib", 12, 0), ("lowei*", 80, 0), ("lowe*", 80, 0)]
    got = {(t.text, t.stem) for t in toxicity.choose_terms(rows, 100, 1000)}
    assert got == {("loser", False), ("lowei", True)}


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(0)
    x, w, v = rng.normal(size=(3, 7)), rng.normal(size=7), rng.normal(size=(7, 4))
    machine = quality.Machine(0.3, w, v, np.zeros(1), np.ones(1))
    for row, got in zip(x, machine.raw(x), strict=True):
        pairs = sum(v[i] @ v[j] * row[i] * row[j] for i, j in combinations(range(7), 2))
        assert got == pytest.approx(0.3 + w @ row + pairs)


def test_structure_of_odd_texts():
    for text in (b"", b" ", b"\n" * 9, "ü".encode() * 5000, b"x" * 100_000):
        stats = quality.structure(text, float("nan"))
        assert len(stats) == quality.STRUCTURE and np.isfinite(stats).all()


def test_discounts():
    got = katz.discounts([100, 40, 20, 12, 8, 5])
    assert ((got[1:] > 0) & (got[1:] < 1)).all()
    bumped = katz.discounts([52195, 15576, 6083, 3085, 2710, 1315])
    assert (bumped[1:4] < 1).all() and bumped[4] == bumped[5] == 1
    assert katz.discounts([0] * 6)[1] == 0.5


def test_letters_decide():
    assert language.vector("12 !?") is None and language.vector("") is None
    at, value = language.vector("Été")
    assert np.linalg.norm(value) == pytest.approx(1) and len(at)
    assert language.family_of("de-AT") == language.family_of("EN") == "germanic" and language.family_of("xx") == "other"


def test_urls():
    split = url_rules.split_url
    assert split(None) == split("no scheme") == ("", "")
    assert split("HTTP://A.B?x/y") == ("a.b", "") and split("http://A.B/C/d#e/f?g") == ("a.b", "/C/d")
    rules = [url_rules.HostRule("org", "/", "allow"), url_rules.HostRule("x.org", "/a", "block")]
    for frequency in ({}, {"org": 9}, {"x": 9}):
        index = url_rules.RuleIndex(rules, url_rules.DEFAULT_PATTERNS, frequency)
        assert index.judge("http://m.x.org/ab", "allow")[2:] == ("x.org/a", None, "block")
        assert index.judge("http://yx.org/ab", "block")[2:] == ("org/", None, "allow")
        assert index.judge("http://org", "allow")[2:] == (None, None, "allow")
        assert index.judge("http://x.net/LOGIN", "allow")[4] == "block"
        assert index.judge("http://x.net/blogin", "allow")[4] == "allow"


def test_candidates_hold_every_rule_that_fits():
    rng = random.Random(4)
    hosts = [url_rules.HostRule(h, p, "block") for h in ("org", "a.org", "b-c.net") for p in ("/", "/x/", "/x/1")]
    patterns = [*url_rules.DEFAULT_PATTERNS, url_rules.PatternRule("*x*", "block"), url_rules.PatternRule("|http://a*/1|", "allow")]
    index = url_rules.RuleIndex(hosts, patterns, {"org": 5, "net": 1})
    for _ in range(2000):
        url = "http://" + ".".join(rng.choices(["a", "b-c", "ads", "q"], k=2)) + rng.choice([".org", ".net"])
        url += "/" + "/".join(rng.choices(["x", "1", "12", "login", "ads", "f.exe", "tag", "page"], k=rng.randrange(4)))
        host, path = url_rules.split_url(url)
        fits = {
            i for i, (r, e) in enumerate(zip(index.rules, index.expressions, strict=True))
            if e.match(host + path if isinstance(r, url_rules.HostRule) else url)
        }
        assert fits <= set(index.candidates(url))


def test_main_text():
    main = html_text.main_text
    page = """<html><head><title>x</title></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div>
    <header><h1>Site</h1></header><ul class="menu"><li><a href="/">Home page link</a></li></ul><div class="content">
    <h2>My   title</h2><div>First para with a fair amount of text, long enough to be seen as text by anything here.</div>
    <div>Ok.</div><div class="ad-slot">Buy now!</div><div>Another &lt;para&gt; with &eacute; text that goes on for long,
    really, as it is the article.</div></div><div class="sidebar">Latest posts: something long enough to fool.</div>
    <section id="comments"><p>I am a reader and I disagree with this whole long article of yours.</p></section>
    <form>Name <button>Send</button></form><div class=footer>(c) All rights reserved</div></body></html>"""
    assert main(page) == (
        "My title First para with a fair amount of text, long enough to be seen as text by anything here. Ok. Another"
        " <para> with é text that goes on for long, really, as it is the article."
    )
    named = '<nav>Menu</nav><div class="ad">Ad<article><h1>T</h1><p>a<p>b<br>c<script>var t="</p>";</script></article><footer>f'
    assert main(named) == "T a b c"
    assert main("") == main("<p></p>") == main("<script>x") == main("<nav>a</nav>") == ""
    assert main("plain &amp; simple") == "plain & simple"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert main(long) == " ".join(["word"] * 20_000)


def test_shingles_by_hand():
    from tickerloom.llm.simhash import shingles

    assert shingles(b"A b\tC  d", 3) == [b"a b c", b"b c d"] and shingles(b"A b", 3) == [b"a b"] and shingles(b" \n", 3) == []
    assert re.split(r"[\x20\x09-\x0D]+", "a\x0bb\x1cc") == ["a", "b\x1cc"] and shingles(b"a\x0bb\x1cc", 3) == [b"a b\x1cc"]
