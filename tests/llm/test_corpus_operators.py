"""The corpus operators on odd tables and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tickerloom.llm import byte_bpe, decontaminate, html_text, katz, language, quality, simhash, toxicity, url_rules
from tickerloom.llm.common import fold_number, pin_batches
from tickerloom.llm.components import components
from tickerloom.llm.exact_dedup import exact_duplicates

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

#: Columns that operators use inside themselves.
CLASHING = "row string, id string, fp string, label string, part string, content string, kept string, score string, keep_id string"

ODD = [
    (1, "A b\tc d"), (1, "A b\tc d"), (2, "Abcd"), (3, "A  b c d"), (4, None), (5, ""), (6, " \n"), (None, "xy z"), (7, "xyz"),
    (8, "word " * 30_000), (9, "word " * 30_000), (10, "é" * 9000), (11, "Straße 😀 \x00 ok"), (12, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    pin_batches(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(d, t, "en" if d else None, None, None) for d, t in ODD], schema).repartition(3)
    return df.select("*", *[F.lit("x").alias(c.split()[0]) for c in CLASHING.split(", ")])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d, d % 2, (d + 1) % 2) for d in range(1, 13)] + [(1, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("limits", [{}, {"fold_bytes": 4, "bucket_bytes": 100_000}])
def test_exact_odd(spark, odd, limits):
    got = exact_duplicates(odd, **limits).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for d, t in ODD:
        groups[hashlib.sha256(_key(t).encode()).hexdigest()].append((-len(t or ""), d is None, d or 0))
    for digest, rows in groups.items():
        mine = [r for r in got if r.text_sha256 == digest]
        assert {r.keep_id for r in mine} == {min(rows)[2] or None} and {r.group_size for r in mine} == {len(rows)}
        assert len(mine) == len(rows) and sum(r.kept for r in mine) == 1 and all(r.doc_id == r.keep_id for r in mine if r.kept)


def test_exact_recursion(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.choice([2, 3, 4])))) for i in range(600)] + [(9000 + i, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small = exact_duplicates(df, fold_bytes=30, bucket_bytes=40).orderBy("doc_id").collect()
    assert small == exact_duplicates(df).orderBy("doc_id").collect()
    least = {}
    for d, t in rows:
        least.setdefault((_key(t), -len(t)), d)
    best = {k: min((n, d) for (t, n), d in least.items() if t == k)[1] for k in {_key(t) for _, t in rows}}
    assert [r.keep_id for r in small] == [best[_key(t)] for _, t in sorted(rows)]


def test_exact_row_numbers(spark, odd):
    numbered = odd.withColumn("n", F.monotonically_increasing_id())
    got = exact_duplicates(numbered, row_col="n")
    assert got.columns[0] == "n" and got.select("n").distinct().count() == len(ODD)


def _fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _least(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_odd(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    want = Counter((d, f"{_fingerprint(t):016x}") for d, t in ODD)
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == want
    empty = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert len(empty) == 1 and next(iter(empty)) == 4
    assert [r.component_id for r in rows if r.doc_id == 9] == [8]


@pytest.mark.parametrize("tree_rows", [4096, 40, 12])
def test_close_links_keep_every_component(spark, tree_rows):
    rng = random.Random(6)
    codes = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(40):
            codes.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randrange(7)))))
    codes = {c - (1 << 64) if c >> 63 else c for c in codes}
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    links = [(r.a, r.b) for r in simhash.close_links(df, tree_rows=tree_rows).collect()]
    near = [(a, b) for a, b in combinations(codes, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in links)
    assert _least(codes, links) == _least(codes, near)


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000), (None, 3)]
    pairs += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = _least({x for p in real for x in p}, real)
    assert got.keys() == want.keys()
    assert len(set(got.items())) == len(got) and len({(got[n], want[n]) for n in got}) == len(set(want.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_odd(spark, odd):
    rows = byte_bpe.encode_decode(odd, RANKS, PATTERN, outputs=("ids", "decoded", "n_tokens")).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == sorted((d or 0, t or "") for d, t in ODD)
    assert all(len(r.ids) == r.n_tokens and (r.n_tokens > 0) == bool(r.decoded) for r in rows)


def test_scores_of_odd_tables(spark, odd, labels):
    for docs in (odd, odd.limit(0)):
        for marks in (labels, labels.limit(0)):
            for got in (
                quality.quality(docs, quality.fit(docs, marks, rows_per_class=3)),
                toxicity.toxicity(docs, toxicity.fit(docs, marks, rows_per_class=3)),
                language.language(docs, language.fit(docs, rows=10)),
            ):
                rows = got.collect()
                assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    told = {r.doc_id: r.lang_pred for r in language.language(odd, language.fit(odd)).collect()}
    assert told[4] == told[5] == told[12] == "und" and told[7] == "en"


def test_training_rows_follow_the_fold(spark, labels):
    from tickerloom.llm.common import fold_of
    from tickerloom.llm.labelled import sample_of

    got = sample_of(labels, "toxic", lambda i: fold_of(i, 5) != 0, 100).collect()
    assert {r.id for r in got} == {d for d in range(1, 13) if zlib.crc32(str(d).encode()) % 5}
    assert len(sample_of(labels, "toxic", lambda i: F.lit(True), 2).collect()) == 4


def test_decontaminate_odd(spark, odd):
    items = spark.createDataFrame([(1, "A b c, d"), (1, "A b c, d"), (2, None), (3, ""), (None, "xy z")], "item_id long, text string")
    rows = decontaminate.contaminated(odd, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (3, 1)]
    clean = decontaminate.without_items(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 4
    blocks = decontaminate.Search(block_bytes=4)
    assert decontaminate.contaminated(odd, items, blocks).count() == 4
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0


def test_pages_odd(spark):
    rows = [(1, "http://a.org/x", "<p>a"), (1, "http://a.org/x", "<p>a"), (2, None, None), (None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "c0": F.lit(2)})
    assert Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_texts(pages).collect()) == Counter(
        [(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "", 0)]
    )
    rules = [url_rules.HostRule("org", "/", "block")]
    got = url_rules.judge_urls(pages, rules).collect()
    assert Counter((r.page_id, r.host, r.rule, r.verdict) for r in got) == Counter(
        [(1, "a.org", "org/", "block")] * 2 + [(2, "", None, "allow"), (None, "", None, "allow")]
    )
    assert html_text.main_texts(pages.limit(0)).count() == url_rules.judge_urls(pages.limit(0), rules).count() == 0


def _tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def _katz(rows):
    """The model of the training rows, as plain dictionaries, and log10 chances by it."""
    uni, bi, context = Counter(), Counter(), Counter()
    for d, t in rows:
        if fold_number(d, 5) != 1:
            w = _tokens(t)
            uni.update(w)
            pairs = list(zip(["<s>", *w], w, strict=False))
            bi.update(pairs)
            context.update(h for h, _ in pairs)
    n = sum(uni.values())
    few = lambda c: katz.discounts([sum(1 for v in c.values() if v == r) for r in range(1, 7)])
    du, db = few(uni), few(bi)
    factor = lambda d, r: d[r] if r <= 5 else 1.0
    freed = sum(v * (1 - factor(du, v)) for v in uni.values()) / n
    kept, unknown = (1.0, freed) if freed > 0 else (n / (n + 1), 1 / (n + 1))
    one = lambda w: kept * factor(du, uni[w]) * uni[w] / n if uni[w] else unknown
    after = defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    back = {}
    for h, seen in after.items():
        left, keep = sum(c * (1 - factor(db, c)) for _, c in seen) / context[h], 1.0
        if left <= 1e-12:
            left, keep = 1 / (context[h] + 1), context[h] / (context[h] + 1)
        back[h] = keep, left / (1 - sum(one(w) for w, _ in seen))

    def chance(w, h):
        c = bi.get((h, w), 0)
        if c:
            return back[h][0] * factor(db, c) * c / context[h]
        return (back[h][1] if h in back else 1.0) * one(w)

    for h in [*list(after)[:20], "no such word"]:
        assert sum(chance(w, h) for w in uni) + chance("not a word", h) == pytest.approx(1.0)
    return uni, n, chance


@pytest.mark.parametrize("limits", [{}, {"head_words": 60, "part_tokens": 2000}])
def test_katz(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    uni, n, chance = _katz(rows)
    got = {r.doc_id: r for r in katz.score_texts(docs, **limits).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, r = _tokens(t), got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert r.held_out == (fold_number(d, 5) == 1)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (len(uni) + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(chance(x, h)) for h, x in zip(["<s>", *w], w, strict=False)), rel=1e-6)


def test_katz_odd(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    rows = katz.score_texts(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((d, len(_tokens(t))) for d, t in ODD)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert katz.score_texts(docs.limit(0)).count() == 0
    alone = docs.filter("doc_id = 4").withColumn("doc_id", F.lit(next(i for i in range(99) if fold_number(i, 5) == 1)))
    alone.write.parquet(str(tmp_path / "alone"))
    r = katz.score_texts(spark.read.parquet(str(tmp_path / "alone"))).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (1, 0, 0, 0.0, 0.0)


def _cell(x):
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(n for n in queries() if re.match(r"op\d+_", n)))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    got = sorted(tuple(_cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in oracle_sql():
        con = duckdb.connect()
        for path in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        cur = con.execute(oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == sorted(tuple(_cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    for name, label in (("op3_quality", "quality"), ("op4_toxicity", "toxic")):
        both = queries()[name](spark, sf).filter("held_out").join(marks, "doc_id")
        assert both.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= 0.9
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    told = queries()["op9_language"](spark, sf).filter("held_out").join(docs, "doc_id")
    assert told.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = [set(texts)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        left.append({r.doc_id for r in kept.select("doc_id").collect()})
        assert left[-1] <= left[-2] and kept.count() == len(left[-1])
    toxic, exact, near, clean, encoded = left[1:]
    scores = toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert toxic == {r.doc_id for r in scores if r.predicted == 0}
    best = {}
    for d in toxic:
        best[_key(texts[d])] = min(best.get(_key(texts[d]), (1, 0)), (-len(texts[d]), d))
    assert exact == {d for _, d in best.values()}
    prints = {d: _fingerprint(texts[d]) for d in exact}
    pairs = [(a, b) for a, b in combinations(exact, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert near == {d for d, least in _least(exact, pairs).items() if d == least}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in texts[d] for i in items for d in clean)
    assert encoded == clean
    assert {r.doc_id: r.decoded_sha256 for r in kept.collect()} == {d: hashlib.sha256(texts[d].encode()).hexdigest() for d in clean}


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for n, start in enumerate((docs, docs.limit(0))):
        kept = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{i}")
            kept.write.parquet(path)
            kept = stage(spark, spark.read.parquet(path), SF)
        rows = kept.collect()
        assert bool(rows) == (n == 0)
