"""What filters take from a corpus alone and together: every order of them, and Shapley values, from coalition removals.

A document's failures are a set of filters. How many documents any coalition of filters removes follows from the counts
of these sets, and the work on documents ends there: what a step of an order removes is the difference between two
coalitions, and the Shapley values are the exact solution of a least-squares problem over all coalitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, to_batch
from tickerloom.session import stored

#: What separates words.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Filter:
    """A one-letter name, and the failure of a text, given as columns of the text and its words."""

    letter: str
    fails: Callable[[Column, Column], Column]


#: The failure conditions of the row filters; the filter of copies is an argument of its own.
ROW_FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 100),
    Filter("B", lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
    Filter("C", lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text)),
    Filter("D", lambda text, words: text.rlike("[#$%&*|]")),
)
COPIES = "E"

_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system, in rationals."""
    rows = [[*row, r] for row, r in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k, row in enumerate(rows):
            if k != i and row[i]:
                rows[k] = [x - row[i] * y for x, y in zip(row, rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley_values(removals: list[int], players: int) -> list[Fraction]:
    """Exact Shapley values of a game with a value for every coalition, given by its bits; the empty one has 0.

    They minimise the squared errors of additive values over all proper coalitions, weighed by the Shapley kernel, under the
    constraint that they add up to the value of all together: normal equations with one multiplier.
    """
    weight = {s: Fraction(players - 1, comb(players, s) * s * (players - s)) for s in range(1, players)}
    normal = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [Fraction(0)] * players + [Fraction(removals[-1])]
    for i in range(players):
        normal[i][players] = normal[players][i] = Fraction(1)
    for coalition in range(1, (1 << players) - 1):
        members = [i for i in range(players) if coalition >> i & 1]
        w = weight[len(members)]
        for i in members:
            right[i] += w * removals[coalition]
            for j in members:
                normal[i][j] += w
    return _solve(normal, right)[:players]


def coalition_removals(counts: dict[int, int], players: int) -> list[int]:
    """How many documents each coalition removes, from the numbers of documents by the set of filters that they fail."""
    within = [counts.get(s, 0) for s in range(1 << players)]
    for i in range(players):
        for s in range(1 << players):
            if s >> i & 1:
                within[s] += within[s ^ (1 << i)]
    full = (1 << players) - 1
    # What stays under a coalition fails nothing but filters outside of it.
    return [within[full] - within[full ^ s] for s in range(1 << players)]


def _steps(part: str, letters: str, docs: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> Iterator[dict]:
    n = len(letters)
    gone, good_gone, toxic_gone = (coalition_removals(c, n) for c in (docs, good, toxic))
    full, total = (1 << n) - 1, sum(docs.values())
    share = [v * factorial(n) for v in shapley_values(gone, n)]
    if any(v.denominator != 1 for v in share):
        raise ArithmeticError("a Shapley value times the number of orders must be whole")
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield {
                "part": part,
                "filter_order": "".join(letters[k] for k in order),
                "step": step,
                "kept": total - gone[after],
                "removed": removed,
                "redundant": gone[1 << i] - removed,
                "unique_fails": gone[full] - gone[full ^ 1 << i],
                "good_lost": good_gone[after] - good_gone[before],
                "toxic_lost": toxic_gone[after] - toxic_gone[before],
                "shapley": int(share[i]),
            }
            before = after


_SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in _COLUMNS]])
_DDL = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS)


def failures(
    docs: DataFrame, filters: tuple[Filter, ...] = ROW_FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """``id``, ``part``, ``fails`` (bit i for filter i, the last for the filter of copies) and ``n`` rows that are alike in these.

    Rows are folded by id and text, and what is first among equal texts is found by (text, id): no key of a join or
    grouping holds more than one id's rows, and those are folded before they are shuffled.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    read = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col], F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", WHITE_SPACE), ""))
    bits = F.lit(0)
    for i, f in enumerate(filters):
        bits = bits + F.when(f.fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0))
    own = stored(read.select("id", "part", bits.alias("fails"), F.sha2("text", 256).alias("content")), "audit-failures")
    texts = own.groupBy("id", "content", "part", "fails").agg(F.count("*").alias("n"))
    # A text's first row is met under its id too, so a text with very many copies is no hot key.
    first = own.filter("id IS NOT NULL").groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    marked = texts.join(first, ["content", "id"], "left").withColumn(
        "fails", F.col("fails") + F.when(copy, F.lit(1 << len(filters))).otherwise(F.lit(0))
    )
    return marked.groupBy("id", "part", "fails").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: tuple[Filter, ...] = ROW_FILTERS,
    copies: str = COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Every step of every order of the filters, for each value of ``part_col`` (null: the empty string).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley, what the
    step's filter removes at any step, summed over all orders. The last filter, ``copies``, fails a text that is identical to the text of
    a smaller id anywhere in the table. A null text is empty. A null id is no smaller or larger id, so its rows fail no filter
    of copies and have no label; rows that repeat an id and a text don't fail it by each other. A document is good or
    toxic if any row of ``labels`` says so. Other columns are ignored; an empty table gives no rows.
    """
    letters = "".join(f.letter for f in filters) + copies
    if len(set(letters)) != len(letters):
        raise ValueError("filters need different letters")
    kept = labels.select(labels[id_col].alias("id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic"))
    marks = (
        kept.filter("id IS NOT NULL")
        .groupBy("id")
        .agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
        )
    )
    seen = failures(docs, filters, id_col, text_col, part_col).join(marks, "id", "left")
    sums = seen.groupBy("part", "fails").agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    # One row per part, with a count for each of the sets of failures.
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("fails", "docs", "good", "toxic")).alias("sets"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = ({s["fails"]: s[kind] for s in row["sets"]} for kind in ("docs", "good", "toxic"))
                steps = list(_steps(row["part"], letters, *counts))
                yield to_batch({c: [s[c] for s in steps] for c in _SCHEMA.names}, _SCHEMA)

    return parts.mapInArrow(run, _DDL)
