"""Bounded samples of labelled documents, for fitting the small models on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import body


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def held_out(id_col: str, n: int, kept_back: int) -> Column:
    return remainder(id_col, n) == kept_back


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learnable: Column, per_class: tuple[int, int], most_chars: int,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to ``per_class[y]`` learnable rows of each class y, in a fixed pseudo-random order of ids, with up to
    ``most_chars`` characters of each text (a stretch at a pseudo-random place), and the sizes of the classes.

    Only ids and labels take part in the choice; the chosen ids, a bounded number, are then joined with the texts.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.withColumnRenamed("k", id_col).filter(learnable).withColumnRenamed(id_col, "k").groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("k", F.lit(31))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "k").limit(per_class[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.col("t")
    start = F.pmod(F.xxhash64("k", F.lit(32)), F.greatest(F.length(text) - most_chars, F.lit(0)) + 1).cast("int") + 1
    rows = docs.select(F.col(id_col).alias("k"), body(text_col).alias("t")).join(F.broadcast(chosen), "k")  # at most sum(per_class) rows of two numbers
    found = rows.select("k", text.substr(start, F.lit(most_chars)).alias("t"), "y").orderBy(order, "k", "t").limit(sum(per_class)).collect()
    return [(r["t"], r["y"]) for r in found], sizes


def prior_shift(sizes: dict[int, int], shown: dict[int, int]) -> float:
    """What to add to log-odds fitted on ``shown`` rows of each class so that they hold for ``sizes``."""
    if min(sizes.get(0, 0), sizes.get(1, 0), shown.get(0, 0), shown.get(1, 0)) == 0:
        return 0.0
    return math.log(sizes[1] / sizes[0]) - math.log(shown[1] / shown[0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
