"""What the learned operators share: the held-out rule, labelled ids and a bounded sample of them, and a Newton solver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that no fit may see: crc32 of the id as text divides by 5; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled ids outside the held-out fifth; of several labels of an id the greatest."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, only: int | None = None) -> DataFrame:
    """(text, y, seat) of at most `rows` labelled documents outside the held-out fifth (of the label `only`, if given).

    The bound is a parameter; the choice is by a hash of the id, which is also the order `seat`. The chosen ids, no more
    than that, are broadcast. Each counts once: of several labels of an id the greatest, of several texts the one of the
    least hash, taken in a partial aggregate.
    """
    some = known(labels, label) if only is None else known(labels, label).filter(F.col("y") == only)
    chosen = some.select("doc_id", "y", F.struct(F.xxhash64("doc_id"), "doc_id").alias("seat")).orderBy("seat").limit(rows)
    texts = docs.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "y", "seat").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    return one.select(F.col("t.text").alias("text"), "y", "seat")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, without an intercept of its own."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s * (p - y)) + ridge * w
        hess = (x * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
