"""The audit of filters against walks of all orders."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import filter_audit
from tickerloom.llm.common import pin_batches


@pytest.mark.parametrize("players", [1, 2, 3, 5])
def test_shapley_values(players):
    rng = random.Random(players)
    value = [0] + [rng.randrange(-50, 1000) for _ in range((1 << players) - 1)]
    want = [Fraction(0)] * players
    orders = list(permutations(range(players)))
    for order in orders:
        seen = 0
        for i in order:
            want[i] += Fraction(value[seen | 1 << i] - value[seen], len(orders))
            seen |= 1 << i
    assert filter_audit.shapley_values(value, players) == want


def _walk(rows, marks):
    """Documents by part, walked through all orders one by one."""
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in marks:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= t == 1
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    docs = []
    for d, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and first[text] < d,
        }
        docs.append((lang or "", {k for k, v in failed.items() if v}, good[d] if d is not None else 0, toxic[d] if d is not None else 0))
    out = set()
    removals = Counter()
    for part in {p for p, *_ in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                removals[part, letter] += len(removed)
                failing = sum(letter in d[1] for d in own)
                out.add(
                    (part, "".join(order), step, len(left), len(removed), failing - len(removed), sum(d[1] == {letter} for d in own))
                    + (sum(d[2] for d in removed), sum(d[3] for d in removed))
                )
    return {(*r, removals[r[0], r[1][r[2] - 1]]) for r in out}


ODD = [
    (1, None, "en"), (1, "", "en"), (2, "", None), (None, "", ""), (None, "A | B", "en"), (3, "A | B", "en"), (4, "A | B", "en"),
    (4, "A | B", "en"), (4, "A | B", "de"), (5, " ".join(f"w{i}" for i in range(100)), "de"), (6, "x " * 40_000, "de"),
    (7, "x " * 40_000, None), (8, "É Ä 😀 \x00 \t\n\x0b\x0c\r", "fr"), (9, " nbsp wide ABC", "fr"),
]
MARKS = [(1, 1, 0), (3, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (5, 1, 1), (77, 1, 1)]


def test_audit_of_odd_rows(spark):
    pin_batches(spark)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["ABC", "$", "a|b"]
    rows = list(ODD)
    for i in range(300):
        text = " ".join(rng.choices(words[: rng.choice([60, 303])], k=rng.choice([3, 99, 100, 150])))
        rows.append((100 + i, text if rng.random() < 0.7 else rng.choice(rows)[1], rng.choice(["en", "de", None])))
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for clash in ("id", "part", "words", "fails", "n", "good", "toxic", "content", "first"):
        docs = docs.withColumn(clash, F.lit("x"))
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    got = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    want = _walk(rows, MARKS)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows}) and set(got) == want
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r[7] for r in map(tuple, filter_audit.audit(docs, labels.limit(0)).collect())} == {0}


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a b")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    short = filter_audit.Filter("S", lambda text, words: F.size(words) < 2)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit.audit(docs, labels, (short,), "C").collect()}
    assert got == {("SC", 1): (2, 1, 2), ("SC", 2): (1, 1, 2), ("CS", 1): (2, 1, 2), ("CS", 2): (1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, (short,), "S")
