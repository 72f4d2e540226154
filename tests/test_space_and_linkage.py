"""Polygons, nearest points, projections and fuzzy linkage against brute force and known values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import linkage as L, spatial as G

RINGS = "pid bigint, rings array<array<struct<x: double, y: double>>>"


def table(spark, polygons):
    return spark.createDataFrame([(p, [[{"x": a, "y": b} for a, b in ring] for ring in rings]) for p, rings in polygons], RINGS)


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
    return odd


def shapes(r, snap):
    out = []
    for p in range(4):
        n, cx, cy = r.randint(3, 40), r.uniform(-4, 4), r.uniform(-4, 4)
        outer = [(snap(cx + math.cos(2 * math.pi * k / n) * r.uniform(1, 6)), snap(cy + math.sin(2 * math.pi * k / n) * r.uniform(1, 6))) for k in range(n)]
        out.append((p, [outer, [(snap(cx + 0.5), snap(cy + 0.5)), (snap(cx - 0.5), snap(cy + 0.5)), (snap(cx - 0.5), snap(cy - 0.5))]]))
    return out


@pytest.mark.parametrize("cell", [None, 1.0, 0.37])
@pytest.mark.parametrize("snapped", [False, True])
def test_points_in_polygons(spark, monkeypatch, cell, snapped):
    """Concave outlines with holes; vertices, points and cells on one grid are the hard case."""
    monkeypatch.setattr(G, "FEW_EDGES", 0 if cell else 10**6)
    r = random.Random(7 + snapped)
    snap = (lambda v: float(round(v))) if snapped else (lambda v: v)
    polygons = shapes(r, snap)
    points = [(i, snap(r.uniform(-11, 11)), snap(r.uniform(-11, 11))) for i in range(300)] + [(300 + i, float(i % 20 - 10), r.uniform(-9, 9)) for i in range(100)]
    got = [(x.id, x.pid) for x in G.points_in_polygons(spark.createDataFrame(points, "id bigint, x double, y double"), table(spark, polygons), cell).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, p) for i, x, y in points for p, rings in polygons if inside(x, y, rings)}


def test_outline_of_many_edges(spark):
    """Each point meets the edges of its cell only, so the joined rows stay near the number of points."""
    n = 20_000
    ring = [(math.cos(2 * math.pi * k / n) * (10 + math.sin(40 * 2 * math.pi * k / n)), math.sin(2 * math.pi * k / n) * (10 + math.sin(40 * 2 * math.pi * k / n))) for k in range(n)]
    points = spark.range(5000).select("id", (F.rand(1) * 24 - 12).alias("x"), (F.rand(2) * 24 - 12).alias("y")).collect()
    got = {x.id for x in G.points_in_polygons(spark.createDataFrame(points), table(spark, [(1, [ring])])).collect()}
    away = {p.id: math.hypot(p.x, p.y) - 10 - math.sin(40 * math.atan2(p.y, p.x)) for p in points}
    assert all((i in got) == (d < 0) for i, d in away.items() if abs(d) > 1e-4)


def test_interior_points(spark):
    r = random.Random(3)
    polygons = shapes(r, lambda v: v) + [(10, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (9.0, 1.0), (1.0, 1.0), (0.0, 10.0)]]), (11, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]]), (12, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]])]
    got = {x.pid: x for x in G.representative_point(table(spark, polygons)).collect()}
    assert got[12].x is None
    assert all(inside(got[p].x, got[p].y, rings) for p, rings in polygons if p != 12)


def away(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(h, 1)))


def test_nearest_of_crowded_points(spark):
    """Nine tenths of the points in one spot, one place many times, both sides of the date line, the poles."""
    r = random.Random(2)
    points = [(i, 40 + r.gauss(0, 0.001), -100 + r.gauss(0, 0.001)) for i in range(900)] + [(2000 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)]
    points += [(3000 + i, 12.5, 179.9999) for i in range(40)] + [(3100 + i, 12.5, -179.9999) for i in range(5)] + [(3200, 90.0, 5.0), (3201, -90.0, 0.0)]
    df = spark.createDataFrame(points, "id bigint, lat double, lon double")
    asked = [p for p in points if p[0] % 9 == 0 or p[0] >= 3090]
    found = {}
    for x in G.nearest(df.where("id % 9 = 0 OR id >= 3090"), df, 4, most_stated=0).collect():
        found.setdefault(x.id, []).append((x.rank, x.id2, x.distance))
    for i, lat, lon in asked:
        want = sorted((round(away((lat, lon), (b, c)), 6), j) for j, b, c in points)[:4]
        assert [round(d, 3) for _, _, d in sorted(found[i])] == [round(d, 3) for d, _ in want], i
        if want[3][0] == 0:  # one place: by id
            assert [j for _, j, _ in sorted(found[i])] == [j for _, j in want]


def test_projections(spark):
    known = [(43.642566, -79.387139, 17, 630084.3, 4833438.5), (0.0, 0.0, 31, 166021.443, 0.0), (-33.8568, 151.2153, 56, None, None), (0.0, 3.0, 31, 500000.0, 0.0), (84.0, 10.0, 32, None, None)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in known], "lat double, lon double").coalesce(1)
    east, north = S.to_utm(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", S.utm_zone(F.col("lon")).alias("zone"), east.alias("e"), north.alias("n"))
    lat, lon = S.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    x, y = S.mercator(F.col("lat"), F.col("lon"))
    back = S.from_mercator(x, y)
    for r, (a, b, zone, e, n) in zip(df.select("*", lat.alias("la"), lon.alias("lo"), back[0].alias("ma"), back[1].alias("mo")).collect(), known, strict=True):
        assert r.zone == zone and math.isclose(r.la, a, abs_tol=1e-9) and math.isclose(r.lo, b, abs_tol=1e-9)  # a hundredth of a millimetre
        assert math.isclose(r.ma, a, abs_tol=1e-9) and math.isclose(r.mo, b, abs_tol=1e-9)
        if e is not None:
            assert math.isclose(r.e, e, abs_tol=0.5) and math.isclose(r.n, n, abs_tol=1.5)


WORDS = ["", "a", "ab", "martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "jellyfish", "smellyfish", "Blue Anvil", "blue anvil", "anvil blue", "blve anvil", "zzz", "aaaa", "aaab", "Ärger", "ärger", "crate", "trace", "abcdefgh", "hgfedcba", "abcd", "abce"]


@pytest.mark.parametrize(("method", "threshold"), [("jaro_winkler", 0.95), ("jaro_winkler", 0.8), ("jaro_winkler", 0.4), ("contains", 0.5), ("same", 0.5), ("levenshtein", 0.6)])
def test_fuzzy_linkage_loses_nothing(spark, method, threshold):
    """Against all pairs, scored by the same column function."""
    r = random.Random(1)
    more = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 12))) for _ in range(60)]
    left, right = [*WORDS, *more[:40], *[w[1:-1] for w in more[40:]]], [*WORDS, *more[20:]]
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x, i) for i, x in enumerate(right)], "r string, at int")
    got = {x.left_value: (x.right_value, round(x.score, 9)) for x in L.fuzzy_match(a, b, "l", "r", threshold, method, order=F.col("at")).collect()}
    every = a.distinct().crossJoin(b.groupBy("r").agg(F.min("at").alias("at"))).withColumn("s", S.similarity(F.col("l"), F.col("r"), method)).where(F.col("s") >= threshold)
    want = {}
    for x in every.collect():
        key = (-x.s, x["at"], x.r)
        if x.l not in want or key < want[x.l][0]:
            want[x.l] = (key, (x.r, round(x.s, 9)))
    assert got == {k: v for k, (_, v) in want.items()} and len(got) >= 20


def test_all_pairs_need_a_short_list(spark):
    a = spark.createDataFrame([("x",)], "l string")
    with pytest.raises(ValueError):
        L.fuzzy_match(a, a.withColumnRenamed("l", "r"), "l", "r", 0.0, "jaro_winkler", most_stated=0)
    assert L.fuzzy_match(a, a.withColumnRenamed("l", "r"), "l", "r", 0.0, "jaro_winkler").count() == 1
