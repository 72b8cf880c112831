"""Language by hierarchical discrimination: the family first, then the languages within it.

A text is a vector of hashed letter sequences of one to three letters, counted over all of it. Linear support vector
machines, one against the rest, choose the family; within it, each two languages have a machine of their own, and the
language with the most wins (then the largest margins) is the answer.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, fold_of, texts_of
from tickerloom.llm.labelled import sigmoid
from tickerloom.session import stored

#: Hash buckets of letter sequences, and about how many rows all languages together are fitted on.
BUCKETS, ROWS = 4096, 6000
UNDETERMINED = "und"

#: Families of languages by ISO 639-1 code. A code that isn't listed is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la co sc rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tt tk ug",
    "indo-aryan": "hi bn ur mr gu pa ne si as or sa",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt ti",
    "dravidian": "ta te kn ml",
    "sino-tibetan": "zh my bo",
    "austronesian": "id ms tl jv su mg mi",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; built once in a worker."""
    if not _LETTERS:
        known = (unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1))
        _LETTERS.append(np.fromiter(known, bool, sys.maxunicode + 1))
    return _LETTERS[0]


def vector(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and values (of length 1) of a whole text; None without a letter. Runs of other characters are one gap."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter | np.r_[True, letter[:-1]]
    code = np.where(letter, code, 0)[keep].astype(np.uint32)
    code = np.r_[np.uint32(0), code, np.uint32(0)]
    one = code * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[1:] >> np.uint32(3))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (one[2:] >> np.uint32(7))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - 12)
    count = sum(np.bincount(x >> shift, minlength=BUCKETS) for x in (one * np.uint32(0x27D4EB2F), two, three))
    at = np.flatnonzero(count)
    value = np.sqrt(count[at])
    return at, (value / np.linalg.norm(value)).astype(np.float32)


@dataclass
class Machines:
    """Linear machines: (weights, bias) for families, one against the rest, and for pairs of languages in a family."""

    families: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each row of ``x``."""
        names = sorted(self.families)
        margin = np.stack([x @ self.families[f][0] + self.families[f][1] for f in names], axis=1)
        soft = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        langs, sure = np.empty(len(x), object), soft[np.arange(len(x)), best]
        for f, name in enumerate(names):
            rows = np.flatnonzero(best == f)
            own = self.languages[name]
            wins, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                w, bias = self.pairs[own[a], own[b]]
                m = x[rows] @ w + bias
                wins[:, a] += m > 0
                wins[:, b] += m <= 0
                p = sigmoid(4 * m)
                sums[:, a] += p
                sums[:, b] += 1 - p
            first = (wins + sums / (len(own) + 1)).argmax(axis=1) if len(rows) else np.zeros(0, int)
            langs[rows] = np.array(own, object)[first]
            if len(own) > 1:
                sure[rows] *= sums[np.arange(len(rows)), first] / (len(own) - 1)
        return langs.tolist(), np.clip(sure, 0.0, 1.0)


def svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = ahead = np.zeros(x1.shape[1], np.float32)
    # Rows have length 1 and the constant 1, so the curvature is at most this.
    rate, momentum = np.float32(1.0 / (1.0 + 4.0 * cost)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        gradient = ahead - 2 * cost * (x1.T @ (weight * y * slack))
        gradient[-1] -= ahead[-1]
        new = ahead - rate * gradient
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + np.float32((momentum - 1) / after) * (new - w)
        w, momentum = new, after
    return w[:-1].copy(), float(w[-1])


def fit(
    docs: DataFrame, folds: int = 3, held_out: int = 1, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Machines:
    """Learn from about ``rows`` texts outside the held-out fold, as many of each language, chosen by a hash of the id.

    Rows without a language, a text or a letter are left out. Vectors, not texts, come to the driver.
    """
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = known.filter("lang IS NOT NULL").filter(fold_of(F.col("id"), folds) != held_out)
    count = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not count:
        return Machines()
    each = max(50, rows // len(count))
    share = F.lit(0.0)
    for lang, n in count.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def extract(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t) for t in texts_of(batch)]
            keep = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(keep, pa.int64())),
                    pa.array([found[i][0].astype(np.int16) for i in keep], pa.list_(pa.int16())),
                    pa.array([found[i][1] for i in keep], pa.list_(pa.float32())),
                ],
                names=["lang", "at", "value"],
            )

    sample = known.filter(chance < share).select("lang", "text")
    got = stored(sample.mapInArrow(extract, "lang string, at array<short>, value array<float>"), "language-sample").toArrow()
    langs = np.array(got.column("lang").to_pylist(), object)
    x = np.zeros((len(langs), BUCKETS), np.float32)
    place, value = (got.column(c).combine_chunks() for c in ("at", "value"))
    row = np.repeat(np.arange(len(langs)), place.value_lengths().to_numpy())
    x[row, place.flatten().to_numpy()] = value.flatten().to_numpy()
    out = Machines()
    for lang in sorted(set(langs.tolist())):
        out.languages.setdefault(family_of(lang), []).append(lang)
    kinds = np.array([family_of(v) for v in langs], object)
    for name, own in out.languages.items():
        out.families[name] = svm(x, kinds == name)
        for a, b in combinations(own, 2):
            pick = (langs == a) | (langs == b)
            out.pairs[a, b] = svm(x[pick], langs[pick] == a)
    return out


def language(
    docs: DataFrame, machines: Machines, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, held_out, lang_pred and score (0 to 1) of every whole text.

    A null text, or one without a letter, is ``und`` with score 0, and so is any text if nothing was learned. A null id is
    kept, in fold 0; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            x, rows = np.zeros((batch.num_rows, BUCKETS), np.float32), []
            for i, text in enumerate(texts_of(batch)):
                found = vector(text)
                if found is not None and machines.families:
                    x[len(rows), found[0]] = found[1]
                    rows.append(i)
            if rows:
                own, sure = machines.predict(x[: len(rows)])
                score[rows] = sure
                for i, name in zip(rows, own, strict=True):
                    lang[i] = name
            arrays = [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang_pred", "score"])

    told = picked.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return told.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == held_out).alias("held_out"), "lang_pred", "score"
    )
