"""Text quality by a factorisation machine.

A document is a sparse vector: hashed words, structure statistics of the whole text, and metadata. The machine adds
to a linear score the interaction of every two features, whose strength is the product of two short vectors. By
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2`` that takes time linear in the features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, fold_of
from tickerloom.llm.labelled import sample_of, sigmoid
from tickerloom.session import stored

#: Hash buckets of words, length of the interaction vectors, and most rows of each class that a model is fitted on.
BUCKETS, FACTORS, ROWS_PER_CLASS = 2048, 8, 3000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASSES = 9


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)  # other punctuation and control characters
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[128:] = 3
    kind[[9, 11, 12, 13, 32]] = 4
    kind[10] = 5
    kind[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\/"]] = 6
    kind[[ord(c) for c in "!?"]] = 7
    return kind


_KIND = _byte_classes()


def structure(text: bytes, n_chars: float) -> list[float]:
    """Statistics of a whole text, and its declared length as metadata (NaN if it has none)."""
    words, lines = text.split(), text.split(b"\n")
    count = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=_CLASSES) if text else np.zeros(_CLASSES)
    size, n = max(1, len(text)), max(1, len(words))
    sentences = text.count(b".") + text.count(b"!") + text.count(b"?")
    return [
        *(count / size).tolist(),
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
        np.log1p(n / (sentences + 1)),
        max((len(w) for w in words), default=0) ** 0.5,
        np.log1p(n_chars) if n_chars >= 0 else np.log1p(len(text)),
    ]


STRUCTURE = 18
SIZE = BUCKETS + STRUCTURE


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the words of a whole text; the values have length 1."""
    counts = Counter(text.translate(_LOWER).split())
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    place = np.fromiter(map(zlib.crc32, counts.keys()), np.uint32, len(counts)) % BUCKETS
    dense = np.bincount(place, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS)
    at = np.flatnonzero(dense)
    value = np.log1p(dense[at])
    return at, (value / np.linalg.norm(value)).astype(np.float32)


@dataclass
class Machine:
    """Bias, weights and interaction vectors, and the centre and spread of the structure statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        both = x @ self.factors
        pairs = 0.5 * (both**2 - (x**2) @ (self.factors**2)).sum(axis=1)
        return self.bias + x @ self.weights + pairs

    def scale(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.spread, -4, 4) / 2


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, machine: Machine, rounds: int = 12, seed: int = 3) -> Machine:
    """Adam on the weighted logistic loss with a small penalty."""
    rng = np.random.default_rng(seed)
    values = [np.zeros(1, np.float32), machine.weights, machine.factors]
    m, v, t = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values], 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            i = order[at : at + 128]
            xi = x[i]
            both = xi @ values[2]
            pairs = 0.5 * (both**2 - (xi**2) @ (values[2] ** 2)).sum(axis=1)
            error = (weight[i] * (sigmoid(values[0][0] + xi @ values[1] + pairs) - y[i]) / len(i)).astype(np.float32)
            grads = [
                np.array([error.sum()], np.float32),
                xi.T @ error + 1e-4 * values[1],
                xi.T @ (error[:, None] * both) - (error @ xi**2)[:, None] * values[2] + 1e-3 * values[2],
            ]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                values[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(values[0][0]), values[1], values[2], machine.centre, machine.spread)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    length = docs["n_chars"].cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), length.alias("n_chars"))


def _inputs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, float]]:
    for text, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True):
        yield (text or "").encode("utf-8", "replace"), float("nan") if n is None else n


def _extract(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*hashed_words(t), structure(t, n)) for t, n in _inputs(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([r[0].astype(np.int16) for r in rows], pa.list_(pa.int16())),
                pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                pa.array([r[2] for r in rows], pa.list_(pa.float64())),
            ],
            names=["label", "at", "value", "stats"],
        )


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows_per_class: int = ROWS_PER_CLASS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Machine | None:
    """Learn from at most ``rows_per_class`` rows of each class outside the held-out fold; None without both classes.

    Rows come to the driver as at most ``BUCKETS`` + ``STRUCTURE`` numbers each, never as texts.
    """
    own = sample_of(labels, label_col, lambda i: fold_of(i, folds) != held_out, rows_per_class, id_col)
    sample = _picked(docs, id_col, text_col).join(F.broadcast(own), "id").select("label", "text", "n_chars")
    schema = "label int, at array<short>, value array<float>, stats array<double>"
    got = stored(sample.mapInArrow(_extract, schema), "quality-sample").toArrow()
    y = got.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    stats = np.array(got.column("stats").to_pylist(), np.float64)
    centre, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    rng = np.random.default_rng(1)
    machine = Machine(
        0.0, np.zeros(SIZE, np.float32), (0.01 * rng.standard_normal((SIZE, FACTORS))).astype(np.float32), centre, spread
    )
    x = np.zeros((len(y), SIZE), np.float32)
    place, value = (got.column(c).combine_chunks() for c in ("at", "value"))
    row = np.repeat(np.arange(len(y)), place.value_lengths().to_numpy())
    x[row, place.flatten().to_numpy()] = value.flatten().to_numpy()
    x[:, BUCKETS:] = machine.scale(stats)
    share = np.array([(y == c).mean() for c in (0, 1)])
    return train(x, y, (0.5 / share)[y.astype(int)].astype(np.float32), machine)


def quality(
    docs: DataFrame, machine: Machine | None, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, held_out, score (0 to 1, higher: better) and predicted of every whole text.

    A null text is an empty one and gets a score too; a null id is kept, in fold 0; without a machine every score is 0.5;
    a missing or null ``n_chars`` is taken from the text; repeated rows score alike; other columns are ignored; an empty
    table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if machine is not None and batch.num_rows:
                x = np.zeros((batch.num_rows, SIZE), np.float32)
                for i, (text, n) in enumerate(_inputs(batch)):
                    at, value = hashed_words(text)
                    x[i, at] = value
                    x[i, BUCKETS:] = machine.scale(np.array(structure(text, n)))
                score = sigmoid(machine.raw(x).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], names=["id", "score"])

    scored = _picked(docs, id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (fold_of(F.col("id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
