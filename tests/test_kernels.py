"""Gaussian weights summed by cells, against the pairs themselves."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar import catalog
from lodestar.operators import candidates as C, disaggregation as D, kernels
from lodestar.operators.candidates import Matching

FOLDER = "/root/testdata/sf0.001"


def tables(spark, odd):
    r = random.Random(8)
    value = lambda key: r.choice(odd[key]) if r.random() < 0.2 else r.choice((1, 100, 1e6)) * r.gauss(0, 1)
    row = lambda i: (i, (k := r.choice((*odd, None))), r.choice(("A", "AE", "A04", "B", "X", None)), k and value(k))
    return [spark.createDataFrame([row(i) for i in range(n)], f"{who} bigint, key string, zone string, {x} double") for n, who, x in ((500, "record_id", "a"), (300, "entity_id", "b"))]


@pytest.mark.parametrize("variant", ["chain", "canonical"])
def test_gaussian_weights_without_pairs(spark, variant):
    inf, nan = float("inf"), float("nan")
    records, entities = tables(spark, {"plain": [0.0, -0.0, 1e18, -1e18, 1e300, 0.25, 0.75], "null": [None], "infinite": [inf, -inf, None], "not a number": [nan, None, inf, 3.0]})
    m = Matching(variant)
    weight = F.exp(-F.pow(F.abs(F.col("b") - F.col("a")) / 7.0, 2) / 2) + 0.001
    pairs = C.candidate_pairs(records, entities, m).join(records.select(F.col("record_id").alias("record"), "a"), "record").join(entities.select(F.col("entity_id").alias("entity"), "b"), "entity")
    want = {x.entity: x.probability for x in D.weighted_probability(pairs, weight).collect()}
    got = {x.entity: x.probability for x in D.gaussian_probability(records, entities, F.col("a"), F.col("b"), 7.0, 0.001, m).collect()}
    assert got.keys() == want.keys() and len(want) > 150
    for e, p in want.items():
        assert got[e] is p is None or math.isnan(p) and math.isnan(got[e]) or math.isclose(got[e], p, rel_tol=1e-11), (e, p, got[e])
    assert {type(p) if p is None else math.isnan(p) for p in want.values()} == {type(None), True, False}


def test_a_constant_too_small_is_refused(spark):
    rows = spark.createDataFrame([("1", 1.0, 1.0)], "k string, x double, w double")
    with pytest.raises(ValueError):
        kernels.gaussian_sums(rows, rows, ("k",), 1.0, 0.0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_no_weight_of_a_pair_is_worked_out(spark):
    """Records and entities meet in sums by cell, so nothing grows with their product where all values differ."""
    plan = catalog.queries()["weighted_probability"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "EXP(" not in plan.upper()
