"""Candidates counted and summed by boxes, against the pairs themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import boxes, candidates as C, disaggregation as D
from lodestar.operators.candidates import Filter, Matching

FILTERS = {
    "within": (Filter("bfe", "elev", "within", 1.1),),
    "percent": (Filter("bfe", "elev", "percent", 20.0),),
    "year": (Filter("year", "built", "years", 0),),
    "bound in a zone": (Filter("", "elev", "at_most", 4.0, zone="X"),),
    "strict": (Filter("year", "built", "equal", strict=True),),
    "names": (Filter("name", "name", "equal"),),
    "years first": (Filter("year", "built", "years", 3), Filter("bfe", "elev", "within", 0.3)),
}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    num = lambda: r.choice((None, float("nan"), -0.0, 1e-300)) if r.random() < 0.1 else r.randrange(-20, 90) / 10
    zone = lambda: r.choice(("A", "AE", "A04", "B", "X", None))
    row = lambda i: (i, r.choice(("1", "2", None)), zone(), num(), r.choice((None, *range(1950, 1975))), r.choice(("u", "v", "w", None)))
    records = spark.createDataFrame([row(i) for i in range(300)], "record_id bigint, key string, zone string, bfe double, year int, name string")
    entities = spark.createDataFrame([row(i) for i in range(200)], "entity_id bigint, key string, zone string, elev double, built int, name string")
    return records.cache(), entities.cache()


@pytest.mark.parametrize(("name", "variant"), [(x, ("chain", "canonical")[i % 2]) for i, x in enumerate(sorted(FILTERS))])
def test_boxes_hold_the_candidates(tables, name, variant):
    records, entities = tables
    m = Matching(variant, filters=FILTERS[name])
    pairs = C.candidate_pairs(records, entities, m).toPandas()
    sizes = pairs.groupby("record").size().to_dict()
    got = {r.record: r.n_candidates for r in C.record_stats(records, entities, m).collect()}
    assert got == {i: sizes.get(i, 0) for i in range(300)}
    assert 1 < len(set(got.values()))
    pairs["share"] = 1 / pairs["record"].map(sizes)
    want = pairs.groupby("entity")["share"].agg(["sum", "size"])
    shares = {r.entity: (r.share, r.n_records) for r in D.shares(records, entities, m).collect()}
    assert {e: n for e, (_, n) in shares.items()} == want["size"].to_dict()
    assert all(abs(shares[e][0] - s) < 1e-9 for e, s in want["sum"].items())


@pytest.mark.parametrize("t", [500.0, 1.1, 0.7, 0.0, 0.1])
def test_ends_are_those_of_the_subtraction(spark, t):
    r = np.random.default_rng(3)
    x = np.concatenate([np.round(r.random(3000) * 600, 2), np.round(r.random(500) * 2, 2), t + r.random(500) * 1e-14, [0.0, t, 500.0001, -1e-12, 1e200]])
    df = spark.createDataFrame([(float(v),) for v in x], "r double").select("r", C.least_within(F.col("r"), t).alias("lo"), (-C.least_within(-F.col("r"), t)).alias("hi")).toPandas()
    for end, away in ((df.lo, -np.inf), (df.hi, np.inf)):
        assert (np.abs(end - df.r) <= t).all() and (np.abs(np.nextafter(end, away) - df.r) > t).all()


def test_no_candidate_is_made(tables):
    """Neither numbers nor shares need a join over a range: every join is on equal keys, and none is a product."""
    m = Matching("canonical", filters=FILTERS["within"])
    for df in (C.record_stats(*tables, m), D.shares(*tables, m)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_entity" not in plan and "Join Cross" not in plan


def test_weights_by_values_and_counts_need_no_pairs(tables):
    records, entities = tables
    m = Matching("canonical")
    weight = F.coalesce(F.when(~F.isnan("bfe") & ~F.isnan("elev"), F.exp(-F.abs(F.col("bfe") - F.col("elev")))), F.lit(0.5))
    pairs = C.candidate_pairs(records, entities, m).join(records.select(F.col("record_id").alias("record"), "bfe"), "record").join(entities.select(F.col("entity_id").alias("entity"), "elev"), "entity")
    want = {r.entity: r.probability for r in D.weighted_probability(pairs, weight).collect()}
    got = {r.entity: r.probability for r in D.weighted_by_values(records, entities, weight, ("bfe",), ("elev",), m).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)
    p = pairs.toPandas()
    assert D.match_counts(records, entities, m).first().asDict() == {"n_pairs": len(p), "n_matched": p.record.nunique(), "n_entities": p.entity.nunique()}


def test_plans_by_boxes_stay_short(tables):
    """Rows and their bounds are written between the steps: the driver's plan does not grow with a power of the reads."""
    m = Matching("canonical", filters=FILTERS["within"])
    for df in (C.profile_sizes(*tables, m), D.shares(*tables, m), D.expected_probability(*tables, m)):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 40_000


THREE = (Filter("year", "built", "years", 6), Filter("bfe", "elev", "within", 2.0), Filter("name", "name", "equal"), Filter("", "elev", "at_most", 6.0, zone="A"), Filter("bfe", "elev", "percent", 30.0, strict=True))


@pytest.mark.parametrize("m", [Matching("chain", filters=THREE), Matching("canonical", filters=THREE[:2]), Matching(use_zone=False, filters=FILTERS["strict"])])
def test_groups_dealt_over_tiles(tables, monkeypatch, m):
    """Groups of more records and members than a tile takes, and groups that share one; three columns and a group without members."""
    monkeypatch.setattr(boxes, "TILE", 7)
    monkeypatch.setattr(boxes, "SMALL", 12)
    records, entities = tables
    pairs = C.candidate_pairs(records, entities, m).toPandas()
    sizes = pairs.groupby("record").size().to_dict()
    assert len(sizes) < 300 and {r.record: r.n_candidates for r in C.record_stats(records, entities, m).collect()} == {i: sizes.get(i, 0) for i in range(300)}
    pairs["share"] = 1 / pairs["record"].map(sizes)
    want = pairs.groupby("entity")["share"].agg(["sum", "size"])
    got = {r.entity: (r.share, r.n_records) for r in D.shares(records, entities, m).collect()}
    assert {e: n for e, (_, n) in got.items()} == want["size"].to_dict()
    assert all(abs(got[e][0] - s) < 1e-9 for e, s in want["sum"].items())


@pytest.mark.parametrize("side", ["records", "entities"])
def test_a_side_without_rows(tables, side):
    records, entities = (t.where("false") if name == side else t for name, t in zip(("records", "entities"), tables, strict=True))
    m = Matching("chain", filters=FILTERS["years first"])
    assert {r.n_candidates for r in C.record_stats(records, entities, m).collect()} == (set() if side == "records" else {0})
    assert D.shares(records, entities, m).collect() == D.expected_probability(records, entities, m).collect() == []


def rows_stored(monkeypatch, run):
    """The rows of each table that is written between steps."""
    n, real = [], C.stored
    for module in (boxes, C):
        monkeypatch.setattr(module, "stored", lambda df, *a, **k: (out := real(df, *a, **k), n.append(out.count()))[0])
    return run(), n


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_numbers_write_no_row_of_a_record(tables, monkeypatch):
    """Only pairs of a key and a zone are written, and records are shuffled once, whatever the number of filters."""
    m = Matching("chain", filters=THREE)
    df, n = rows_stored(monkeypatch, lambda: C.record_stats(*tables, m))
    assert 0 < max(n) <= 18 and shuffles(df) <= 3  # records; members; sizes of groups for these


def test_shares_write_no_row_of_a_record(tables, monkeypatch):
    """Records are shuffled twice, to be counted and to be summed; members meet them there."""
    m = Matching("chain", filters=THREE)
    df, n = rows_stored(monkeypatch, lambda: D.shares(*tables, m))
    assert 0 < max(n) <= 18 and shuffles(df) <= 6
