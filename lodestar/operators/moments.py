"""Ridge regression over folds from one table of moments.

One aggregation gives each fold's size, means and centred products of features and label. Training sets are sums of
folds, so every penalty, every set of features, every held-out fold and every fold within the others is algebra on k x k
matrices: nested cross-validation, tuning and ablation read the data once. What reaches the driver is a row a fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .disaggregation import hash60


@dataclass(frozen=True)
class Moments:
    """Of rows: their number, the means of features and label, and the sums of products about the means."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass(frozen=True)
class Ridge:
    """Weights of the features named by place, and the constant."""

    places: tuple[int, ...]
    weights: np.ndarray
    constant: float

    @classmethod
    def fit(cls, m: Moments, penalty: float, places: Sequence[int] | None = None) -> Ridge:
        """Least squares with ``penalty`` times the squares of the weights of scaled features; the constant is free."""
        own = np.array(range(len(m.mean) - 1) if places is None else places, int)
        spread = np.sqrt(np.diag(m.products)[own] / m.n)
        spread = np.where(spread > 0, spread, 1.0)
        xx = m.products[np.ix_(own, own)] / np.outer(spread, spread)
        xy = m.products[own, -1] / spread
        w = np.linalg.lstsq(xx + penalty * np.eye(len(own)), xy, rcond=None)[0] / spread if len(own) else np.zeros(0)
        return cls(tuple(own.tolist()), w, float(m.mean[-1] - w @ m.mean[own]))

    def r2(self, m: Moments) -> float | None:
        """Of rows that the moments describe; null if their label does not vary."""
        own = np.array(self.places, int)
        v = np.zeros(len(m.mean))
        v[-1] = 1.0
        v[own] = -self.weights
        left = float(v @ m.products @ v) + m.n * float(v @ m.mean - self.constant) ** 2
        total = float(m.products[-1, -1])
        return 1 - left / total if total > 0 else None


def fold_moments(df: DataFrame, fold: Sequence[Column], features: Sequence[str], label: str) -> dict[tuple, Moments]:
    """Moments by fold, of the rows that lack nothing."""
    names = [*features, label]
    v = [F.col(c).cast("double") for c in names]
    whole = df.where(~F.exists(F.array(*[x.isNull() | F.isnan(x) for x in v]), lambda z: z))
    keys = [k.alias(f"k{i}") for i, k in enumerate(fold)]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    rows = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i, j in pairs])
    out = {}
    for r in rows.collect():  # a row a fold
        c = np.zeros((len(v), len(v)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[tuple(r[f"k{i}"] for i in range(len(fold)))] = Moments(r["n"], np.array([r[f"m{i}"] for i in range(len(v))]), c)
    return out


def _without(folds: dict, *gone: object) -> Moments:
    kept = [m for f, m in folds.items() if f not in gone]
    if not kept:
        raise ValueError("no fold is left to learn from")
    out = kept[0]
    for m in kept[1:]:
        out = out + m
    return out


def _mean(values: list[float | None]) -> float:
    some = [x for x in values if x is not None]
    return float(np.mean(some)) if some else float("-inf")


def _flat(folds: dict[tuple, Moments]) -> dict:
    return {k[0]: folds[k] for k in sorted(folds, key=repr)}


def ridge_scores(df: DataFrame, fold: str, features: Sequence[str], label: str, penalties: Sequence[float] = (1.0,)) -> DataFrame:
    """penalty, fold, r2: each fold scored by the ridge of the others, for all penalties."""
    folds = _flat(fold_moments(df, [F.col(fold)], features, label))
    rows = [(float(p), f, Ridge.fit(_without(folds, f), p).r2(m)) for p in penalties for f, m in folds.items()]
    return df.sparkSession.createDataFrame(rows, f"penalty double, fold {df.schema[fold].dataType.simpleString()}, r2 double")


def nested_ridge(df: DataFrame, fold: str, features: Sequence[str], label: str, penalties: Sequence[float]) -> DataFrame:
    """fold, penalty, inner_r2, r2: for each fold the penalty whose mean R2 over the other folds, each held out in turn, is
    best (of equals the smaller), and the score on the fold itself."""
    folds = _flat(fold_moments(df, [F.col(fold)], features, label))
    rows = []
    for f, m in folds.items():
        inner = {p: _mean([Ridge.fit(_without(folds, f, g), p).r2(other) for g, other in folds.items() if g != f]) for p in sorted(penalties)}
        best = max(inner, key=lambda p: (inner[p], -p))
        rows.append((f, float(best), inner[best], Ridge.fit(_without(folds, f), best).r2(m)))
    return df.sparkSession.createDataFrame(rows, f"fold {df.schema[fold].dataType.simpleString()}, penalty double, inner_r2 double, r2 double")


def ablation(df: DataFrame, fold: str, features: Sequence[str], label: str, penalty: float = 1.0) -> DataFrame:
    """left_out, mean_r2, change: the mean score over folds without each feature, and against all of them (left_out null)."""
    folds = _flat(fold_moments(df, [F.col(fold)], features, label))
    score = lambda own: _mean([Ridge.fit(_without(folds, f), penalty, own).r2(m) for f, m in folds.items()])
    places = list(range(len(features)))
    full = score(places)
    rows = [(None, full, 0.0)]
    for i, name in enumerate(features):
        one = score([j for j in places if j != i])
        rows.append((name, one, one - full))
    return df.sparkSession.createDataFrame(rows, "left_out string, mean_r2 double, change double")


def repeated_scores(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 5, repeats: int = 10, penalty: float = 1.0, seed: int = 42) -> DataFrame:
    """repeat, mean_r2: folds dealt anew by hash of the key in every repeat, all from one aggregation."""
    dealt = df.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    at = F.pmod(hash60(F.lit(seed), F.col("_repeat"), F.col(key)), F.lit(folds))
    found = fold_moments(dealt, [F.col("_repeat"), at], features, label)
    rows = []
    for i in range(repeats):
        own = {f: m for (r, f), m in found.items() if r == i}
        rows.append((i, _mean([Ridge.fit(_without(own, f), penalty).r2(m) for f, m in own.items()]) if len(own) > 1 else None))
    return df.sparkSession.createDataFrame(rows, "repeat int, mean_r2 double")
