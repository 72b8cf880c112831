"""Ticker linker: cashtags, symbols and synonyms found in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.binding import let
from tickerloom.params import CASHTAG_PATTERN, LINK_CONFIDENCE

# A word: no white space inside, a letter, digit, $ or # in front, a letter, digit or # at the end.
_WORD = r"[\p{L}\p{Nd}$#]\S*[\p{L}\p{Nd}#]|[\p{L}\p{Nd}#]"

# Letters of a first word that are tried for a large dictionary, most first.
_LETTERS = (8, 6, 5, 4, 3, 2, 1)


def alias_terms(tickers: DataFrame, min_symbol: int = 2) -> DataFrame:
    """The dictionary: (term, ticker, method), a symbol counting as dict and any other alias as synonym.

    A bare symbol of one letter is an ordinary word in most languages, so it needs its dollar sign.
    """
    symbols = tickers.filter(F.length("symbol") >= min_symbol).select(F.col("symbol").alias("term"), F.col("symbol").alias("ticker"), F.lit("dict").alias("method"))
    names = tickers.select(
        F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("term"),
        F.col("symbol").alias("ticker"),
        F.lit("synonym").alias("method"),
    )
    return symbols.unionByName(names.filter(F.col("term") != F.col("ticker"))).filter("term is not null").distinct()


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def term_heads(terms: DataFrame) -> DataFrame:
    """``head``, the first word of terms, and ``lengths``, the numbers of words of the terms that begin with it."""
    tokens = _tokens(F.col("term"))
    counted = terms.select(tokens[0].alias("head"), F.size(tokens).alias("n")).filter("head is not null")
    return counted.groupBy("head").agg(F.array_sort(F.collect_set("n")).alias("lengths"))


def _runs(tokens: Column, start: Column, lengths: Column) -> Column:
    """Runs of words from a place on, of each of the lengths, as far as there are words."""
    whole = F.filter(lengths, lambda n: start + n <= F.size(tokens))
    return F.transform(whole, lambda n: F.array_join(F.slice(tokens, start + 1, n), " "))


def _phrases(text: Column, heads: dict[str, list[int]], key: Callable[[Column], Column] = lambda word: word) -> Column:
    """Distinct runs of words of the whole text that begin with the first word of a term and are as long as its terms.

    ``key`` is what of a word is looked up in ``heads``.
    """
    groups: dict[tuple[int, ...], list[str]] = {}
    for head, lengths in heads.items():
        groups.setdefault(tuple(lengths), []).append(head)

    def found(tokens: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            out = F.lit(None).cast("array<string>")
            for lengths, own in groups.items():
                runs = F.array(word) if lengths == (1,) else _runs(tokens, i, F.array(*[F.lit(n) for n in lengths]))
                out = F.when(key(word).isin(own), runs).otherwise(out)
            return out

        hits = F.filter(F.transform(tokens, at), lambda runs: runs.isNotNull())
        return F.array_distinct(F.flatten(F.coalesce(hits, F.array().cast("array<array<string>>"))))

    return let(_tokens(text), found) if groups else F.array().cast("array<string>")


def _links(found: DataFrame) -> DataFrame:
    """One row per article and ticker: its best method and every matched term."""
    confidence = F.lit(0.0)
    for method, value in LINK_CONFIDENCE.items():
        confidence = F.when(F.col("method") == method, F.lit(value)).otherwise(confidence)
    return (
        found.withColumn("confidence", confidence)
        .groupBy("article_id", "ticker")
        .agg(
            F.max("confidence").alias("confidence"),
            F.max_by("method", "confidence").alias("method"),
            F.array_sort(F.collect_set("term")).alias("matched_terms"),
        )
    )


def _dictionary(tickers: DataFrame, cashtags: bool, aliases: bool, min_symbol: int) -> DataFrame:
    """Terms to look for, a cashtag with its dollar sign."""
    tags = tickers.select(
        F.concat(F.lit("$"), "symbol").alias("term"), F.col("symbol").alias("ticker"), F.lit("cashtag").alias("method")
    )
    if not aliases:
        return tags
    terms = alias_terms(tickers, min_symbol)
    return tags.unionByName(terms) if cashtags else terms


def _beginnings(heads: DataFrame, most: int) -> tuple[int, dict[str, list[int]]]:
    """How many letters of first words tell them apart best with at most ``most`` beginnings, and each with its terms' lengths.

    If not even the first letters are that few, the empty beginning stands for all.
    """
    counts = heads.agg(*[F.count_distinct(F.substring("head", 1, n)).alias(str(n)) for n in _LETTERS]).first()
    n = next((n for n in _LETTERS if counts[str(n)] <= most), 0)
    begun = heads.select(F.substring("head", 1, n).alias("head"), F.explode("lengths").alias("n"))
    return n, {r.head: list(r.lengths) for r in begun.groupBy("head").agg(F.array_sort(F.collect_set("n")).alias("lengths")).collect()}


def _phrase_rows(articles: DataFrame, heads: DataFrame, max_heads: int) -> DataFrame:
    """``article_id`` and ``term`` for every run of words that may be a term.

    A small dictionary's first words travel with the plan, and words are looked up where they are found. Of a large one, only the
    beginnings of first words do, as many letters as keep them few. Neither moves a text or its words.
    """
    heads = heads.filter(~F.col("head").startswith("$"))
    few = heads.limit(max_heads + 1).collect()
    if len(few) <= max_heads:
        found = _phrases(F.col("text"), {r.head: list(r.lengths) for r in few})
    else:
        n, begun = _beginnings(heads, max_heads)
        found = _phrases(F.col("text"), begun, lambda word: F.when(~word.startswith("$"), F.substring(word, 1, n)))
    return articles.select(F.col("id").alias("article_id"), F.explode(found).alias("term"))


def mentions(
    articles: DataFrame, tickers: DataFrame, cashtags: bool = True, aliases: bool = True, min_symbol: int = 2, max_heads: int = 5000
) -> DataFrame:
    """Cashtags, symbols and synonyms of known tickers: (article_id, ticker, method, term).

    A phrase is formed only where the first word of a term stands. A word such as $ABC is left to the cashtags, which know
    where a tag ends. Bare symbols of fewer than ``min_symbol`` letters aren't looked for.
    """
    terms = _dictionary(tickers, cashtags, aliases, min_symbol)
    found = None
    if cashtags:
        tags = F.array_distinct(F.regexp_extract_all("text", F.lit(CASHTAG_PATTERN), 1))
        tagged = articles.filter(F.contains("text", F.lit("$")))
        found = tagged.select(F.col("id").alias("article_id"), F.explode(F.transform(tags, lambda t: F.concat(F.lit("$"), t))).alias("term"))
    if aliases:
        phrases = _phrase_rows(articles, term_heads(terms), max_heads)
        found = phrases if found is None else found.unionByName(phrases)
    return found.join(terms, "term").select("article_id", "ticker", "method", "term")


def link_cashtags(articles: DataFrame, tickers: DataFrame) -> DataFrame:
    return _links(mentions(articles, tickers, aliases=False))


def link_dictionary(articles: DataFrame, tickers: DataFrame) -> DataFrame:
    return _links(mentions(articles, tickers, cashtags=False))


def link_tickers(articles: DataFrame, tickers: DataFrame) -> DataFrame:
    return _links(mentions(articles, tickers))


def with_spans(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links with ``char_spans``: where the matched terms stand in the text, in order, ends exclusive.

    The text is cut at the terms, a term with white space between words of any kind; the lengths of the cuts and of
    the terms add up to the places. Only articles with links are read here.
    """
    longest_first = F.array_sort("matched_terms", lambda a, b: F.length(b) - F.length(a))
    literal = F.transform(
        longest_first, lambda t: F.regexp_replace(F.regexp_replace(t, r"([^\p{L}\p{Nd} ])", r"\\$1"), " ", r"\\s+")
    )
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{Nd}$#])(?:"), F.array_join(literal, "|"), F.lit(r")(?![\p{L}\p{Nd}#])"))
    texts = articles.select(F.col("id").alias("article_id"), "text")
    joined = links.withColumn("_pattern", pattern).join(texts, "article_id")
    cuts = F.zip_with(
        F.regexp_extract_all("text", F.col("_pattern"), F.lit(0)),
        F.split("text", F.col("_pattern"), -1),
        lambda hit, before: F.struct(F.length(before).alias("gap"), F.length(hit).alias("size")),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(done: Column, cut: Column) -> Column:
        start = done["at"] + cut["gap"]
        span = F.struct(start.alias("start"), (start + cut["size"]).alias("end"))
        return F.struct((start + cut["size"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    hits = F.filter(cuts, lambda c: c["size"].isNotNull())
    return joined.withColumn("char_spans", F.aggregate(hits, none, add, lambda done: done["spans"])).drop("_pattern", "text")


def cashtag_spans(articles: DataFrame, tickers: DataFrame) -> DataFrame:
    """Character spans of each known cashtag: (article_id, ticker, char_spans)."""
    return with_spans(link_cashtags(articles, tickers), articles).select("article_id", "ticker", "char_spans")


def stored_links(linked: DataFrame, article_id: Column | None = None) -> DataFrame:
    """Linker output as stored: spans are dropped, the article id may be stamped on."""
    stamp = F.col("article_id") if article_id is None else article_id
    return linked.select(stamp.alias("article_id"), "ticker", "confidence", "method", "matched_terms")
