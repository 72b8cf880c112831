"""The candidate search of benchmark decontamination against brute force, for items of all lengths and for hostile texts."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from tickerloom.llm import decontaminate as d

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _edited(text, share, rng):
    out = ""
    for c in text:
        kind = rng.randrange(3) if rng.random() < share else -1
        out += {-1: c, 0: rng.choice(LETTERS), 1: c + rng.choice(LETTERS), 2: ""}[kind]
    return out


@pytest.mark.parametrize("words", [3, 5, 8, 16, 40])
def test_recall_over_the_whole_band(words):
    """Items of so many words with 5 to 19 % of characters edited: nine tenths of what brute force accepts."""
    rng = random.Random(words)
    bench = [d.words_of(r["text"].encode()) for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()]
    docs = [r["text"].encode() for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").slice(0, 100).to_pylist() if r["text"]]
    items = []
    for i, w in enumerate(bench):
        at = rng.randrange(max(1, len(w) - words))
        items.append((i, b" ".join(w[at : at + words])))
    index = d.ItemIndex(items, d.Search())
    for share in (0.05, 0.1, 0.15, 0.19):
        planted, texts = [], []
        for n in range(200):
            item, text = items[n % len(items)]
            text = text.decode("utf-8", "replace")
            edited = _edited(text, share, rng)
            if d.fitting_distance(text, edited) <= 0.2 * len(text):
                around = docs[n % len(docs)]
                planted.append(item)
                texts.append(around[:300] + b" " + edited.encode() + b" " + around[300:600])
        found = index.hits(texts)
        assert len(planted) >= 60
        assert sum(i in {h[0] for h in hits} for i, hits in zip(planted, found, strict=True)) >= 0.9 * len(planted)


def test_embeddings_fall_back_into_step():
    """Equal starts have equal keys; a changed character changes only walks that see it."""
    shape = d.SHAPES[0]
    rng = random.Random(1)
    text = "".join(rng.choices(LETTERS, k=400)).encode()
    other = text[:200] + b"#" + text[201:]
    a, b = (d.embed_keys(d.padded(t, shape.reach), np.arange(400), shape) for t in (text, other))
    assert (a[:, :170] == b[:, :170]).all() and (a[:, 201:] == b[:, 201:]).all()
    seen = (a[:, 200 - shape.reach : 201] == b[:, 200 - shape.reach : 201]).mean(axis=1)
    assert ((0 < seen) & (seen < 1)).all()


def test_texts_and_items_that_repeat_themselves():
    items = [(1, b"0 1 " * 250), (2, b"abc def ghi " * 20), (3, b"a " * 40)]
    index = d.ItemIndex(items, d.Search())
    took = []
    for k in (16_000, 128_000):
        start = time.process_time()
        (hits,) = index.hits([b"0 1 " * k])
        took.append(time.process_time() - start)
        assert {h[0] for h in hits} == {1}
    assert took[1] < 20 * max(took[0], 0.1) and took[1] < 30
    (hits,) = index.hits([b"x " * 500 + b"a " * 40])
    assert {h[0] for h in hits} == {3}


def test_slices_give_what_one_pass_gives():
    rng = random.Random(4)
    bench = [(r["item_id"], r["text"].encode()) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    index = d.ItemIndex(bench, d.Search())
    text = b" ".join(rng.choice(bench)[1] for _ in range(30))
    words = [d.words_of(text)]
    joined = b" ".join(words[0])
    for table in index.tables:
        first = np.array([0])
        whole = sorted(table.places(d.padded(joined, table.shape.reach), len(joined), first))
        assert whole and whole == sorted(table.places(d.padded(joined, table.shape.reach), len(joined), first, slice_rows=7))
