"""Extremely randomised trees for regression, all trees of the forest grown together, level by level.

A level takes two passes over the rows. In the first the tasks find, for every open node of every tree, the range of each
feature; a threshold is drawn within it for each. In the second they sum the labels on the left of every threshold, and
the feature that leaves the least variance splits the node. A task adds up its own rows before anything is shuffled, so
what is shuffled and what the driver holds is a row for each node, bounded by the number of trees and their depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..storage import stored


class Forest:
    """Nodes of all trees as arrays (tree, node): the feature that splits (or -1), its threshold, and the mean label.

    The children of node i are 2 i + 1 and 2 i + 2; a row goes to the second if its value is above the threshold.
    """

    def __init__(self, trees: int, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.feature, self.threshold, self.value = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))

    def nodes(self, x: np.ndarray, steps: int) -> np.ndarray:
        """Where the rows are after so many levels, for each tree."""
        at = np.zeros((len(self.feature), len(x)), np.int64)
        rows, tree = np.arange(len(x))[None, :], np.arange(len(at))[:, None]
        for _ in range(steps):
            by = self.feature[tree, at]
            right = x[rows, np.maximum(by, 0)] > self.threshold[tree, at]
            at = np.where(by >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, x: np.ndarray, steps: int) -> np.ndarray:
        tree = np.arange(len(self.feature))[:, None]
        return self.value[tree, self.nodes(x, steps)].mean(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _added(rows: DataFrame, forest: Forest, level: int, k: int, thresholds: np.ndarray | None) -> dict[tuple[int, int], np.ndarray]:
    """For each node of a level: without thresholds the number of rows, sums of labels and squares, least and largest
    values; with them the number and sum and squares of labels at or below each feature's threshold."""
    trees, first, width = len(forest.feature), 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees * width, 3 if thresholds is None else 3 * k))
        low, high = np.full((trees * width, k), np.inf), np.full((trees * width, k), -np.inf)
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            at = forest.nodes(x, level) - first
            for t in range(trees):
                own = np.flatnonzero(at[t] >= 0)
                cell, v, label = t * width + at[t][own], x[own], y[own]
                if thresholds is None:
                    for j, w in enumerate((np.ones(len(own)), label, label * label)):
                        sums[:, j] += np.bincount(cell, weights=w, minlength=len(sums))
                    np.minimum.at(low, cell, v)
                    np.maximum.at(high, cell, v)
                else:
                    left = v <= thresholds[t, at[t][own]]
                    for j in range(k):
                        for i, w in enumerate((np.ones(len(own)), label, label * label)):
                            sums[:, 3 * j + i] += np.bincount(cell, weights=w * left[:, j], minlength=len(sums))
        met = np.flatnonzero(sums.any(1))
        table = sums[met] if thresholds is not None else np.concatenate([sums[met], low[met], high[met]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(list(table), pa.list_(pa.float64()))], ["cell", "v"])

    n = 3 if thresholds is None else 3 * k
    how = [F.sum] * n + ([] if thresholds is not None else [F.min] * k + [F.max] * k)
    found = rows.select("x", "y").mapInArrow(run, "cell long, v array<double>").groupBy("cell").agg(*[f(F.get("v", F.lit(i))).alias(f"v{i}") for i, f in enumerate(how)])
    return {divmod(r["cell"], width): np.array([r[f"v{i}"] for i in range(len(how))]) for r in found.collect()}  # a row a node


def grow(rows: DataFrame, k: int, trees: int, depth: int, least: int, seed: int) -> Forest:
    """A forest from rows of x (an array of k features) and y. Nodes with fewer than ``least`` rows are leaves."""
    forest, draw = Forest(trees, depth), np.random.default_rng(seed)
    for level in range(depth + 1):
        first = 2**level - 1
        nodes = _added(rows, forest, level, k, None)
        thresholds = np.full((trees, 2**level, k), np.inf)
        for (t, i), v in sorted(nodes.items()):
            forest.value[t, first + i] = v[1] / v[0]
            thresholds[t, i] = v[3 : 3 + k] + draw.random(k) * (v[3 + k :] - v[3 : 3 + k])
        open_ = {key: v for key, v in nodes.items() if v[0] >= least and v[2] - v[1] ** 2 / v[0] > 1e-12 * max(1.0, v[2])}
        if level == depth or not open_:
            return forest
        for (t, i), left in _added(rows, forest, level, k, thresholds).items():
            if (t, i) not in open_:
                continue
            n, s, q = open_[t, i][:3]
            ln, ls = left[0::3], left[1::3]
            ok = (ln > 0) & (ln < n)
            gain = np.where(ok, ls**2 / np.maximum(ln, 1) + (s - ls) ** 2 / np.maximum(n - ln, 1), -np.inf)
            if ok.any():
                best = int(gain.argmax())
                forest.feature[t, first + i], forest.threshold[t, first + i] = best, thresholds[t, i, best]
    return forest


class ExtraTreesRegressor(Estimator):
    """Fits on the columns features (a vector) and label; every tree sees all rows."""

    def __init__(self, trees: int = 50, depth: int = 6, least: int = 2, seed: int = 42, label: str = "label") -> None:
        super().__init__()
        self.settings, self.label = (trees, depth, least, seed), label

    def setLabelCol(self, name: str) -> ExtraTreesRegressor:  # noqa: N802  as Spark's own regressors have it
        self.label = name
        return self

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        trees, depth, least, seed = self.settings
        rows = stored(dataset.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y")).where("y IS NOT NULL"), "rows")
        one = rows.select(F.size("x").alias("k")).first()
        if one is None:
            raise ValueError("no rows")
        return ExtraTreesModel(grow(rows, one["k"], trees, depth, least, seed), depth)


class ExtraTreesModel(Model):
    def __init__(self, forest: Forest, depth: int) -> None:
        super().__init__()
        self.forest, self.depth = forest, depth

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest, depth = self.forest, self.depth

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(forest.predict(_matrix(x), depth))

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))
