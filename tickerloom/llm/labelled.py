"""A bounded sample of labelled rows for fitting, and logistic regression on few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of each class that a model is fitted on; the rows are chosen by a hash of their id.
ROWS_PER_CLASS = 4000


def sample_of(labels: DataFrame, label_col: str, wanted, rows: int = ROWS_PER_CLASS, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids of each class 0 and 1 among those that ``wanted`` (a condition on the id) lets through.

    A document with several labels counts by the largest; null ids and labels are left out.
    """
    of = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .filter(wanted(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    order = F.xxhash64("id", F.lit(11)), F.col("id")
    return of.filter("label = 0").orderBy(*order).limit(rows).union(of.filter("label = 1").orderBy(*order).limit(rows))


def with_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``label``, ``text`` of the sampled documents. The sample's rows are bounded, so that it is broadcast."""
    picked = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return picked.join(F.broadcast(sample), "id")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps; the intercept isn't shrunk."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    shrink = np.r_[np.full(x.shape[1], l2), 1e-6]
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        gradient = x1.T @ (weight * (p - y)) + shrink * w
        hessian = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
