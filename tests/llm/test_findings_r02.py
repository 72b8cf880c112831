"""Whole jobs: what the second review found cut."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from tickerloom.llm import jaccard
from tickerloom.llm.common import pin_batches


def _jaccard(a, b, words=5):
    a, b = ({tuple(t[i : i + words]) for i in range(len(t) - words + 1)} for t in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_by_jaccard(spark, monkeypatch):
    """What the learned lexicon counts once: the same rows go whatever the size up to which pairs are compared at once."""
    pin_batches(spark)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(100, 400))
        texts.append(" ".join(base))
        for _ in range(20 if g == 0 else 4):
            share = rng.choice([0.01, 0.02, 0.03, 0.06])
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A b")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    gone = []
    for paired in (8, 2):
        monkeypatch.setattr(jaccard, "PAIRED", paired)
        gone.append({r.id for r in jaccard.later_copies(docs).collect()})
    assert gone[0] == gone[1]
    left = set(range(len(texts))) - gone[0]
    assert 9003 in gone[0] and not gone[0] & {9000, 9001, 9002}
    similar = {p for p in combinations(range(len(texts)), 2) if _jaccard(texts[p[0]], texts[p[1]]) >= 0.8}
    assert len(similar) > 60
    assert not [p for p in similar if p[0] in left and p[1] in left]
    # What is left out is a copy of an earlier one.
    assert gone[0] - {9003} <= {b for _, b in similar}


def test_copies_are_found_again_by_stable_numbers(spark, tmp_path):
    """The cut of the files changes between the scans, as it does when executors come or go."""
    pin_batches(spark)
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=rng.randrange(40, 200))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i % 50]) for i in range(200)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        try:
            left = stage(spark, spark.read.parquet(str(tmp_path / "docs")), "")
            spark.conf.set("spark.sql.files.minPartitionNum", "3")
            assert sorted(r.doc_id for r in left.collect()) == list(range(300))
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")


def test_pages_with_comment_and_several_articles():
    from tickerloom.llm.html_text import main_text

    body = [f"Paragraph {i} of the body has words enough to be read as running text of the page." for i in range(6)]
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    says = [f"Reader {i} says something about it here, at some length as well." for i in range(3)]
    for mark in ('class="comment"', 'class="comment-body odd"', 'id="comment-7"', 'itemprop="comment"', "class='user-comment'"):
        comments = "".join(f"<article {mark}><p>{s}</p></article>" for s in says)
        for page in (f"<div class=content>{paragraphs}</div><section>{comments}</section>", f"<article>{paragraphs}<div>{comments}</div></article>"):
            assert main_text(page) == " ".join(body)
    # Comments without any mark are outweighed by a body outside of them.
    unmarked = "".join(f"<article><p>{s}</p></article>" for s in says)
    assert main_text(f"<div class=content>{paragraphs * 2}</div>{unmarked}") == " ".join(body * 2)
    # Articles of like size stay in order, teasers go, and so do scraps between adverts.
    teaser = "<article><a href=x>More</a><p>A short teaser.</p></article>"
    page = f"<article class='post has-comments'>{paragraphs}</article>{teaser}<article class='comments-open'><h2>Second</h2>{paragraphs}</article>"
    assert main_text(page) == " ".join([*body, "Second", *body])
    advert = "<div class=ad>Buy</div>" * 3
    assert main_text(f"<article>{advert}<p>|</p>{advert}{paragraphs}<p>No.</p></article>") == " ".join([*body, "No."])


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.19])
@pytest.mark.parametrize("kinds", [1, 3])
def test_items_with_edited_characters(share, kinds):
    import pyarrow.parquet as pq

    from tickerloom.llm import decontaminate as d

    sf, rng, letters = "/root/testdata/sf0.01", random.Random(share), "abcdefghijklmnopqrstuvwxyz"
    items = [(r["item_id"], r["text"].encode()) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    docs = [r["text"].encode() for r in pq.read_table(f"{sf}/documents.parquet").slice(0, 100).to_pylist() if r["text"]]
    planted, texts = [], []
    for n in range(4 * len(items)):
        item, text = items[n % len(items)]
        text = b" ".join(d.words_of(text)).decode()
        edited = ""
        for c in text:
            kind = rng.randrange(kinds) if rng.random() < share else -1
            edited += {-1: c, 0: rng.choice(letters), 1: c + rng.choice(letters), 2: ""}[kind]
        if d.fitting_distance(text, edited) <= 0.2 * len(text):  # what brute force finds
            planted.append(item)
            around = docs[n % len(docs)]
            texts.append(around[:1000] + b" " + edited.encode() + b" " + around[1000:2000])
    found = d.ItemIndex(items, d.Search()).hits(texts)
    assert len(planted) >= 40
    assert sum(i in {hit[0] for hit in hits} for i, hits in zip(planted, found, strict=True)) >= 0.9 * len(planted)


@pytest.mark.parametrize("changed", [0, 2])
def test_terms_of_a_copied_toxic_text(spark, changed):
    from tickerloom.llm import toxicity

    pin_batches(spark)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abdefgiklmnoprstu", k=7)) for _ in range(400)]
    terms = ["zorgle", "quipwax", "xyvorn", "jhuzzy", "wexqat", "kyzzok"]

    def text(own):
        words = rng.choices(vocabulary, k=120)
        for term in own:
            words.insert(rng.randrange(len(words)), term)
        return words

    rows = [(text(rng.sample(terms, 3)), 1) for _ in range(100)] + [(text([]), 0) for _ in range(150)]
    copied = text(terms[:3])
    for _ in range(50):
        own = list(copied)
        for _ in range(changed):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((own, 1))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {t for t in terms if any(t == m.text or (m.stem and t.startswith(m.text)) for m in model.terms)} == set(terms)
    assert {m.text for m in model.terms if not m.stem} <= set(terms)
    scores = toxicity.toxicity(docs.filter(f"doc_id >= {len(rows) - 50}"), model).collect()
    assert all(r.predicted == 1 for r in scores)
