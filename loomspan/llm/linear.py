"""What the two text classifiers share: bounded label samples and an L-BFGS minimiser in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def label_sample(labels: DataFrame, target: str, in_training: Column, per_class: int) -> DataFrame:
    """doc_id, label: at most per_class ids of each class, the ones with the least hash, so two bounded top-k selections.
    An id with several labels takes the largest; null ids and labels are left out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & in_training).groupBy("doc_id").agg(F.max(target).alias("label"))
    key = F.xxhash64("doc_id", F.lit(7))
    parts = [own.where(F.col("label") == y).orderBy(key, "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -grad, []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ d)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - rho * (y @ d))
        slope = grad @ d
        if slope >= 0:
            break
        t = 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(grad))
        while True:
            nxt = x + t * d
            new, g = f(nxt)
            if new <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = nxt - x, g - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = abs(value - new) <= 1e-7 * max(1.0, abs(value))
        x, value, grad = nxt, new, g
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
