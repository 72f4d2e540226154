"""Exact quantiles by selection, and ROC areas without a fold by rank deltas, against brute force."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import quantiles as Q, resampling as R

SHARES = (0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0)


@pytest.mark.parametrize("small", [5, 20_000])
@pytest.mark.parametrize("kind", ["spread", "ties", "few", "extremes"])
def test_quantiles_against_numpy(spark, monkeypatch, small, kind):
    monkeypatch.setattr(Q, "SMALL", small)
    r = random.Random(8)
    n = {"few": 1}.get(kind, 30_000)
    values = {
        "spread": [math.exp(r.gauss(0, 20)) * r.choice((-1, 1)) for _ in range(n)],
        "ties": [r.choice((1.0, 1.0, 2.0, 5.0, r.random())) for _ in range(n)],
        "few": [3.5],
        "extremes": [r.choice((float("-inf"), -1e308, 0.0, -0.0, 1e308, float("inf"))) for _ in range(n)],
    }[kind]
    rows = [(x,) for x in values] + [(None,)] * 40
    got = Q.quantiles(spark.createDataFrame(rows, "x double").repartition(4), "x", SHARES).first()["_e"]
    ordered = np.sort(np.array(values))
    for p, x in zip(SHARES, got, strict=True):
        at = p * (len(values) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = a if a == b or at == math.floor(at) else a * (1 - at % 1) + b * (at % 1)
        assert x == want or math.isclose(x, want, rel_tol=1e-12), (p, x, want)


def test_quantiles_by_key_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 10)
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 3 == 2, None).otherwise(F.col("id")).alias("x"))
    got = {r.k: r.q for r in Q.quantiles(df, "x", (0.5, 1.0), ("k",), "q").collect()}
    assert got == {"0": [1498.5, 2997.0], "1": [1499.5, 2998.0]}
    assert Q.quantiles(df.where("x < 0"), "x", (0.5, 0.1)).collect() == [([None, None],)]


def test_quantiles_from_a_sketch_that_differs_each_time(spark, monkeypatch):
    """As on several executors, where the parts of a sketch merge in the order in which they arrive."""
    monkeypatch.setattr(Q, "SMALL", 10)
    sketch = F.percentile_approx
    moved = F.udf(lambda ends: [x + os.urandom(1)[0] % 11 - 5 for x in ends], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(sketch(*a)))
    got = Q.quantiles(spark.range(30_001).select(F.col("id").cast("double").alias("x")), "x", [i / 10 for i in range(11)]).first()["_e"]
    assert got == [3000.0 * i for i in range(11)]


def area(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_areas_without_a_fold_against_brute_force(spark):
    r = random.Random(6)
    shares = {i: r.choice((0.1, 0.2, 0.25, 0.5, 1.0, 1.25)) for i in range(60)}
    truth = [i for i in shares if r.random() < 0.4]
    moves = [(f"f{f}", i, min(shares[i], r.choice((0.05, 0.1, 0.25, 2.0)))) for f in range(12) for i in r.sample(sorted(shares), r.randint(1, 40))]
    moves += [("all true", i, shares[i]) for i in truth] + [("everyone", i, shares[i] / 2) for i in shares]
    out = R.areas_without(spark.createDataFrame(list(shares.items()), "entity int, share double"), spark.createDataFrame(moves, "fold string, entity int, off double"), spark.createDataFrame([(i,) for i in [*truth, *truth, 999]], "entity int"))
    got = {x.fold: x for x in out.collect()}
    assert len(got) == 14
    for fold, x in got.items():
        off = {i: o for f, i, o in moves if f == fold}
        left = {i: round(s - off.get(i, 0), 9) for i, s in shares.items()}
        rows = [(s, i in truth) for i, s in left.items() if s > 0]
        total = sum(s for s, _ in rows)
        assert (x.n, x.prevalence) == (len(rows), sum(y for _, y in rows) / len(rows))
        assert math.isclose(x.full, area([(s, i in truth) for i, s in shares.items()]), rel_tol=1e-12)
        want = area(rows)
        assert x.without is want is None or math.isclose(x.without, want, rel_tol=1e-12), fold
        assert math.isclose(x.brier, sum((s / total - y) ** 2 for s, y in rows) / len(rows), rel_tol=1e-9)


def test_no_fold_meets_all_entities(spark):
    """The plan has no product of folds and entities: joins without keys have one row on a side."""
    shares = spark.range(1000).select(F.col("id").cast("int").alias("entity"), (1 / (F.col("id") + 1)).alias("share"))
    moves = spark.range(200).select((F.col("id") % 50).cast("string").alias("fold"), F.col("id").cast("int").alias("entity"), F.lit(0.001).alias("off"))
    plan = R.areas_without(shares, moves, spark.range(300).select(F.col("id").cast("int").alias("entity")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
