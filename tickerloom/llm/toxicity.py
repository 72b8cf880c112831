"""Toxicity by a Levenshtein automaton over a lexicon trie, and context windows.

The lexicon is learned: words, and stems with many endings, that occur in many different surroundings of toxic documents
and hardly anywhere else. Each text counts once, however many equal or near copies of it there are, so that a fixed number
of different surroundings keeps out words that only a group of copies repeats, and no term of such a group is lost. The
terms form a trie. An automaton walks it with a bounded number of edits; its states are sets of (node, edits) and are
built when a text first reaches them. A hit counts less if it is quoted or cited, and more if someone is
addressed. A logistic regression turns the evidence of a text into a score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, fold_of, texts_of, tidy
from tickerloom.llm.jaccard import later_copies
from tickerloom.llm.labelled import ROWS_PER_CLASS, logistic, sample_of, sigmoid, with_texts
from tickerloom.session import stored

_STRIP = " .,;:!?\"'()[]{}<>*%&#$|“”„«»‘’`-_"
_OPEN, _CLOSE = "\"“„«‘'`", "\"”“»’'`"
#: Words that cite a term instead of using it, and words that address someone.
CITING = frozenset(
    "word words term terms called calling said says quote quoted quotes quoting means meaning insult slur wort begriff"
    " sagte heißt mot terme dit signifie palabra término dijo significa".split()
)
ADDRESSING = frozenset("you your you're youre u ur du dein ihr tu toi ton vous eres tú usted".split())
#: Lengths of stems.
STEMS = (4, 5, 6)
#: Words around a hit that decide whether it is quoted, cited or addressed to someone.
WINDOW = 6
MISSPELLED = 0.7


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass(frozen=True)
class Term:
    """A word or the stem of words, its weight, and the edits within which other spellings count as it.

    Unless said otherwise, a word takes the edits that its length allows, and a stem, which stands for many endings, none.
    """

    text: str
    stem: bool
    weight: float
    edits: int | None = None

    def __post_init__(self) -> None:
        if self.edits is None:
            object.__setattr__(self, "edits", 0 if self.stem else edits_allowed(len(self.text)))


class LexiconAutomaton:
    """All words within their edits of a term, or that begin with a stem."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for i, term in enumerate(terms):
            node, allowed = 0, term.edits
            self.most[0] = max(self.most[0], allowed)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append(i)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.stem_hit: list[tuple[int, int] | None] = []
        self.word_hit: list[tuple[int, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a state, after terms' letters that a text may leave out; -1 for the empty one."""
        stack, seen = list(items), set(items)
        while stack:
            node, edits = stack.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and (child, edits + 1) not in seen:
                    seen.add((child, edits + 1))
                    stack.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in seen:
            least[node] = min(edits, least.get(node, edits))
        key = frozenset(least.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            stems = [(e, t) for n, e in key for t in self.ends[n] if self.terms[t].stem and e == 0]
            words = [
                (e, t) for n, e in key for t in self.ends[n]
                if not self.terms[t].stem and e <= self.terms[t].edits
            ]
            self.stem_hit.append(min(stems)[::-1] if stems else None)
            self.word_hit.append(min(words)[::-1] if words else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None and edits <= self.most[child]:
                out.add((child, edits))
            if edits + 1 <= self.most[node]:
                out.add((node, edits + 1))
            for other, child in self.children[node].items():
                if other != c and edits + 1 <= self.most[child]:
                    out.add((child, edits + 1))
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, or None."""
        if len(self.moves) > 500_000:
            self._reset()
        state, moves = 0, self.moves
        for c in word:
            after = moves.get((state, c))
            if after is None:
                after = self._move(state, c)
                moves[state, c] = after
            state = after
            if state < 0:
                return None
            if self.stem_hit[state]:
                return self.stem_hit[state]
        return self.word_hit[state]


@dataclass
class Model:
    """Terms, near-terms that are ordinary words, and the coefficients; bounded by the rows that they are learned from."""

    terms: list[Term]
    benign: frozenset = frozenset()
    coefficients: list[float] = field(default_factory=list)

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.terms)


def _quoted(raw: list[str], i: int) -> bool:
    """Whether a quotation opens at or before word i and closes at or after it, within the window."""
    for j in range(i, max(-1, i - WINDOW - 1), -1):
        if raw[j][0] in _OPEN:
            break
        if j < i and raw[j].rstrip(".,;:!?)")[-1:] in _CLOSE:
            return False
    else:
        return False
    return any(raw[k].rstrip(".,;:!?)")[-1:] in _CLOSE for k in range(i, min(len(raw), i + WINDOW + 1)) if len(raw[k]) > 1)


def _context(raw: list[str], bare: list[str], i: int) -> float:
    around = bare[max(0, i - WINDOW) : i] + bare[i + 1 : i + 1 + WINDOW // 2]
    cited = any(w in CITING for w in around)
    if _quoted(raw, i):
        return 0.0 if cited else 0.15
    if cited:
        return 0.5
    return 1.2 if any(w in ADDRESSING for w in bare[max(0, i - 3) : i + 4]) else 1.0


def hits(text: str, automaton: LexiconAutomaton, benign: frozenset) -> tuple[int, list[tuple[str, int, int, float]]]:
    """Number of words, and (word, term, edits, context weight) of each hit in the whole text."""
    raw = text.lower().split()
    bare = [w.strip(_STRIP) for w in raw]
    found = {}
    for w in set(bare):
        hit = automaton.match(w)
        if hit and not (hit[1] and w in benign):
            found[w] = hit
    if not found:
        return len(raw), []
    return len(raw), [(w, *found[w], _context(raw, bare, i)) for i, w in enumerate(bare) if w in found]


FEATURES = 4


def features(words: int, found: list[tuple[str, int, int, float]], terms: list[Term]) -> list[float]:
    evidence = sum(terms[t].weight * c * (MISSPELLED if e else 1.0) for _, t, e, c in found)
    distinct = len({t for _, t, _, c in found if c >= 0.5})
    return [math.log1p(evidence), min(evidence, 2.0), math.log1p(distinct), math.log1p(100 * evidence / max(200, words))]


def _units(text: str) -> dict[str, set[int]]:
    """Words and stems of a text, each with hashes of the words around its occurrences."""
    bare = [w.strip(_STRIP) for w in text.lower().split()]
    out: dict[str, set[int]] = defaultdict(set)
    for i, w in enumerate(bare):
        if len(w) < 3 or w.isdigit():
            continue
        around = xxhash.xxh32_intdigest(f"{bare[i - 1] if i else ''} {bare[i + 1] if i + 1 < len(bare) else ''}")
        for unit in (w, *(w[:n] + "*" for n in STEMS if len(w) >= n)):
            out[unit].add(around)
    return out


def _mine(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        around: dict[str, set[int]] = defaultdict(set)
        for label, text in zip(batch.column("label").to_pylist(), texts_of(batch), strict=True):
            units = _units(text)
            counts[label].update(units.keys())
            if label:
                for unit, places in units.items():
                    around[unit] |= places
        units = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(units, pa.string()),
                pa.array([counts[1][u] for u in units], pa.int64()),
                pa.array([counts[0][u] for u in units], pa.int64()),
                pa.array([list(around.get(u, ())) for u in units], pa.list_(pa.int64())),
            ],
            names=["unit", "toxic", "clean", "around"],
        )


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms from (unit, toxic documents, clean documents): words alone, and stems that no single ending explains."""
    count = {u: t for u, t, _ in rows}
    other = {u: c for u, _, c in rows}
    stems = {}
    for u in sorted((u for u in count if u.endswith("*")), key=len):
        body = u[:-1]
        best_word = max((n for w, n in count.items() if not w.endswith("*") and w.startswith(body)), default=0)
        longer = max((n for w, n in count.items() if w.endswith("*") and len(w) > len(u) and w.startswith(body)), default=0)
        if best_word < 0.8 * count[u] and longer < 0.98 * count[u] and not any(body.startswith(s) for s in stems):
            stems[body] = u
    picked = [(body, True, u) for body, u in stems.items()]
    picked += [(u, False, u) for u in count if not u.endswith("*") and not any(u.startswith(s) for s in stems)]
    odds = {u: math.log((count[u] / toxic) / ((other[u] + 0.5) / clean)) for _, _, u in picked}
    top = max(odds.values(), default=1.0)
    terms = [Term(text, stem, max(0.1, odds[u] / top)) for text, stem, u in picked]
    return sorted(terms, key=lambda t: (-t.weight, t.text))


def _ordinary(surfaces: list, toxic: int, clean: int) -> frozenset:
    """Words near a term that clean documents have as well."""
    seen = defaultdict(lambda: [0, 0])
    for r in surfaces:
        seen[r.word][0] += r.toxic
        seen[r.word][1] += r.clean
    return frozenset(w for w, (t, c) in seen.items() if c and c / clean >= 0.25 * t / toxic)


def _edits_that_are_sure(terms: list[Term], surfaces: list, toxic: int, clean: int, precision: float) -> list[Term]:
    """A term keeps its edits if they are precise on text that wasn't seen.

    For each half of the sample, the other half says which words near a term are ordinary, and what is left counts.
    """
    seen = defaultdict(lambda: [0.0, 0.0])
    for half in (0, 1):
        known = _ordinary([r for r in surfaces if r.half != half], toxic, clean)
        for r in surfaces:
            if r.half == half and r.word not in known:
                seen[r.term][0] += r.toxic / toxic
                seen[r.term][1] += r.clean / clean
    return [replace(t, edits=0) if i in seen and seen[i][1] > (1 - precision) * sum(seen[i]) else t for i, t in enumerate(terms)]


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows_per_class: int = ROWS_PER_CLASS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", surroundings: int = 6, support: float = 0.01,
    precision: float = 0.95,
) -> Model:
    """Learn terms and coefficients from at most ``rows_per_class`` rows of each class outside the held-out fold.

    A term has at least so many different surroundings in toxic documents, is in a share ``support`` of them, and its
    documents, weighed by class, are toxic in a share of ``precision``. Without rows of both classes the model has no terms and scores 0.
    """
    own = sample_of(labels, label_col, lambda i: fold_of(i, folds) != held_out, rows_per_class, id_col)
    rows = with_texts(docs, own, id_col, text_col).select("label", "text", F.sha2("text", 256).alias("id"))
    rows = stored(rows.dropDuplicates(["label", "id"]), "toxicity-rows")
    once = [of.join(later_copies(of), "id", "left_anti") for of in (rows.filter("label = 0"), rows.filter("label = 1"))]
    sample = stored(once[0].union(once[1]), "toxicity-sample")
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model([])
    toxic, clean = size[1], size[0]
    units = (
        sample.mapInArrow(tidy(_mine), "unit string, toxic long, clean long, around array<long>")
        .groupBy("unit")
        .agg(
            F.sum("toxic").alias("toxic"),
            F.sum("clean").alias("clean"),
            F.size(F.array_distinct(F.flatten(F.collect_list("around")))).alias("around"),
        )
    )
    share = F.col("toxic") / toxic
    sure = share / (share + (F.col("clean") + 0.5) / clean)
    kept = units.filter((F.col("around") >= surroundings) & (F.col("toxic") >= max(4, support * toxic)) & (sure >= precision))
    rows = kept.orderBy(F.desc("around"), "unit").collect()  # each is in a share of the bounded rows
    model = Model(choose_terms([(r.unit, r.toxic, r.clean) for r in rows], toxic, clean))

    def near(batches: Batches) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        schema = pa.schema([("word", pa.string()), ("term", pa.int32()), ("half", pa.int32()), ("label", pa.int32())])
        for batch in batches:
            out = []
            for label, key, text in zip(batch.column("label").to_pylist(), batch.column("id").to_pylist(), texts_of(batch), strict=True):
                half = int(key[:8], 16) % 2
                out += [(w, t, half, label) for w, t in {(w, t) for w, t, e, _ in hits(text, automaton, frozenset())[1] if e}]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=schema)

    # Other spellings of terms in the sample's documents, and how many of each class have them, by half of the sample.
    met = sample.mapInArrow(tidy(near), "word string, term int, half int, label int").groupBy("word", "term", "half")
    surfaces = met.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()
    model.terms = _edits_that_are_sure(model.terms, surfaces, toxic, clean, precision)
    model.benign = _ordinary(surfaces, toxic, clean)

    def measured(batches: Batches) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x, y = [], []
            for label, text in zip(batch.column("label").to_pylist(), texts_of(batch), strict=True):
                words, found = hits(text, automaton, model.benign)
                x.append(features(words, found, model.terms))
                y.append(label)
                if label and len(found) > 1:
                    # One abusive term is enough, so each toxic text also stands for its middle hit alone.
                    x.append(features(words, [sorted(found, key=lambda h: model.terms[h[1]].weight * h[3])[len(found) // 2]], model.terms))
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    got = sample.mapInArrow(tidy(measured), "label int, x array<double>").collect()  # at most 3 * rows_per_class short rows
    x = np.array([r.x for r in got]).reshape(-1, FEATURES)
    y = np.array([r.label for r in got], float)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / clean) * len(y)
    model.coefficients = logistic(x, y, weight).tolist()
    return model


def scores(texts: list[str], model: Model, automaton: LexiconAutomaton) -> np.ndarray:
    if not model.coefficients:
        return np.zeros(len(texts))
    x = np.array([features(*hits(t, automaton, model.benign), model.terms) for t in texts]).reshape(-1, FEATURES)
    w = np.array(model.coefficients)
    return sigmoid(x @ w[:-1] + w[-1])


def toxicity(
    docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted of every whole text.

    A null or empty text has no hit and scores like any text without one; a null id is kept, in fold 0; repeated rows are
    scored alike; other columns are ignored; an empty table gives no rows.
    """
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            own = scores(texts_of(batch), model, automaton)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.float64())], names=["id", "score"])

    scored = picked.mapInArrow(tidy(run), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (fold_of(F.col("id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield batch.filter(pa.array(scores(texts_of(batch, text_col), model, automaton) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
