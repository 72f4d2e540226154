"""Operators on literals, with the answers worked out by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S, texts as T
from lodestar.operators import candidates as C, cleaning as K, disaggregation as D, estimation as E, linkage as L, metrics as M, panel as P, quality as Q, resampling as R, spatial as G
from lodestar.operators.candidates import Filter, Matching

RECORDS = "record_id bigint, key string, zone string, bfe double, year int"
ENTITIES = "entity_id bigint, key string, zone string, elev double, built int"


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(1, "68025", "A", 10.0, 1950), (2, "68025", "AE", 11.0, 1960), (3, "68025", "X", None, 1970), (4, "68025", "A", 30.0, 1980), (5, "99999", "X", 1.0, 1990), (6, None, "X", 1.0, 1990), (7, "68025", None, 1.0, 1990)], ENTITIES)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(1, "68025", "A04", None, None), (2, "68025", "B", None, None), (3, "68025", None, None, None), (4, None, "X", None, None), (5, "68025", "X500", None, None), (6, "68025", "ae", 10.5, None), (7, "68025", "A", 10.2, 1981), (8, "68025", "A", 99.0, None)], RECORDS)


def found(records, entities, m):
    out = {r.record: set() for r in records.select(F.col("record_id").alias("record")).collect()}
    for r in C.candidate_pairs(records, entities, m).collect():
        out[r.record].add(r.entity)
    return out


def test_chain_falls_back_to_weaker_zones_and_to_the_key(records, entities):
    got = found(records, entities, Matching())
    assert got == {1: {1, 4}, 2: {3}, 3: {1, 2, 3, 4, 7}, 4: set(), 5: set(), 6: {2}, 7: {1, 4}, 8: {1, 4}}


def test_strict_needs_a_zone(records, entities):
    assert found(records, entities, Matching("strict"))[3] == set()


def test_canonical_zones(records, entities):
    got = found(records, entities, Matching("canonical"))
    assert got[1] == {1, 4} and got[2] == {3} and got[3] == set() and got[5] == set()


def test_filters_apply_only_where_they_leave_a_candidate(records, entities):
    m = Matching(filters=(Filter("bfe", "elev", "within", 1.0), Filter("year", "built", "years", 5)))
    got = found(records, entities, m)
    assert got[7] == {1}  # the elevation leaves one, the year would leave none
    assert got[8] == {1, 4} and got[1] == {1, 4} and got[6] == {2}


def test_stats_have_every_record(records, entities):
    got = {r.record: (r.n_candidates, r.matched) for r in C.record_stats(records, entities).collect()}
    assert got[4] == (0, False) and got[3] == (5, True) and len(got) == 8


def test_variants_agree_without_digits_or_nulls(spark, entities):
    plain = spark.createDataFrame([(i, "68025", z, None, None) for i, z in enumerate(["A", "AE", "X"])], RECORDS)
    a, b, c = (found(plain, entities, Matching(v)) for v in ("chain", "strict", "canonical"))
    assert a == b == c


def test_expectation_sums_to_one_and_draws_approach_it(records, entities):
    p = {r.entity: r.probability for r in D.expected_probability(records, entities).collect()}
    assert abs(sum(p.values()) - 1) < 1e-12
    assert abs(p[2] - (1 / 5 + 1) / 6) < 1e-12
    draws = D.hashed_draws(records, entities, 2000)
    q = {r.entity: r.probability for r in D.draw_counts(draws).collect()}
    assert all(abs(p[e] - q.get(e, 0)) < 0.02 for e in p)
    assert sorted(map(tuple, D.hashed_draws(records.repartition(5), entities, 3).collect())) == sorted(map(tuple, draws.where("draw < 3").collect()))


def test_weighted_draws_follow_the_weights(spark):
    pairs = spark.createDataFrame([(1, 10, 1.0), (1, 11, 3.0)], "record bigint, entity bigint, w0 double")
    got = D.weighted_draws(pairs, F.col("w0"), 4000).groupBy("entity").count().collect()
    assert abs({r.entity: r["count"] for r in got}[11] / 4000 - 0.75) < 0.03
    w = D.weighted_probability(pairs, F.col("w0")).collect()
    assert {r.entity: r.probability for r in w} == {10: 0.25, 11: 0.75}


def brute_auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


def test_ranking_metrics(spark):
    r = np.random.default_rng(2)
    s, y = np.round(r.random(300), 1), r.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    auc = M.roc_auc(df, "s", "y").first()["roc_auc"]
    assert abs(auc - brute_auc(s, y)) < 1e-12
    assert abs(M.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()["roc_auc"] + auc - 1) < 1e-12
    order = sorted(set(s), reverse=True)
    rec, pre = [0.0], [1.0]
    for t in order:
        tp = int(((s >= t) & (y == 1)).sum())
        rec.append(tp / (y == 1).sum())
        pre.append(tp / (s >= t).sum())
    want = sum((b - a) * (c + d) / 2 for a, b, c, d in zip(rec, rec[1:], pre, pre[1:], strict=False))
    assert abs(M.pr_auc(df, "s", "y").first()["pr_auc"] - want) < 1e-12
    assert M.roc_auc(df.where("y = 1"), "s", "y").first()["roc_auc"] is None
    assert M.roc_curve(df, "s", "y").count() == len(order)


def test_calibration_ks_and_p_value(spark):
    df = spark.createDataFrame([(i / 100, int(i % 3 == 0)) for i in range(100)], "s double, y int")
    bins = M.calibration(df, "s", "y").collect()
    assert len(bins) == 10 and sum(b.n for b in bins) == 100
    both = spark.createDataFrame([(float(i), i % 2) for i in range(100)], "v double, a int")
    k = M.ks_statistic(both, "v", "a").first()
    assert abs(k.ks - 0.02) < 1e-12 and M.ks_p_value(k.ks, 50, 50) > 0.99 and M.ks_p_value(0.5, 200, 200) < 1e-6


def test_exact_match_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r"), (9, "s")], "id int, v string")
    got = L.exact_match(a, b, ["id"]).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"id", "v", "v_right", "_merge"}
    stats = L.match_statistics(L.exact_match(a, b, ["id"]), ["id"]).first()
    assert (stats.n_matched, stats.n_unmatched) == (3, 1)
    assert {r.id: r._merge for r in L.exact_match(a, b, ["id"], how="outer").collect()}[9] == "right_only"


@pytest.mark.parametrize(("a", "b", "want"), [("Hello", "hello", 1.0), ("abc", "xyz", 0.0), ("", "", 1.0), ("", "a", 0.0), ("kitten", "sitting", 1 - 3 / 7)])
def test_levenshtein(spark, a, b, want):
    assert abs(spark.range(1).select(S.levenshtein_similarity(F.lit(a), F.lit(b)).alias("s")).first().s - want) < 1e-12


def test_jaro_winkler_and_fuzzy(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dwayne", "duane"), ("abc", "axyz"), ("", "a"), (None, "a")], "a string, b string")
    got = [r.s for r in df.select(S.jaro_winkler_similarity("a", "b").alias("s")).collect()]
    assert abs(got[0] - 0.9611111) < 1e-6 and abs(got[1] - 0.84) < 1e-6 and abs(got[2] - 0.575) < 1e-9 and got[3] == 0.0 and got[4] is None
    left, right = spark.createDataFrame([("apple",), ("zzz",)], "n string"), spark.createDataFrame([("aple", 1), ("apples", 2)], "m string, o int")
    best = L.fuzzy_match(left, right, "n", "m", 0.7, order=F.col("o")).collect()
    assert [(r.left_value, r.right_value) for r in best] == [("apple", "apples")]
    assert L.fuzzy_match(left, spark.createDataFrame([("green apple pie",)], "m string"), "n", "m", 0.5, "contains").count() == 1


def test_codes_zones_and_rounding(spark):
    row = spark.range(1).select(S.padded_code(F.lit(123.0), 5).alias("z"), S.padded_code(F.lit(1234567), 5).alias("l"), S.padded_code(F.lit(None), 5).alias("n"), S.stripped_zone(F.lit("A04")).alias("a"), S.stripped_zone(F.lit("X500")).alias("x"), S.canonical_zone(F.lit("b")).alias("b"), S.round_half_even(F.lit(2.5), 0).alias("r"), S.first_positive([F.lit(None), F.lit(-1.0)], [F.lit(4.0)]).alias("p"), S.year_of(F.lit("1987-02-03")).alias("y"), S.year_of(F.lit("no")).alias("ny")).first()
    assert (row.z, row.l, row.n, row.a, row.x, row.b, row.r, row.p, row.y, row.ny) == ("00123", "1234567", None, "A", "X500", "X", 2.0, 4.0, 1987, None)


def test_formats(spark):
    row = spark.range(1).select(S.format_coefficient(F.lit(0.123), F.lit(0.045), F.lit(0.006)).alias("c"), S.format_f(F.lit(12.34), F.lit(3), F.lit(100), F.lit(0.0005)).alias("f"), S.format_count(F.lit(12345)).alias("n"), S.format_percent(F.lit(0.5)).alias("p"), S.format_percent(F.lit(45.0)).alias("q"), S.format_difference(F.lit(0.5)).alias("d"), S.format_interval(F.lit(1.0), F.lit(2.0)).alias("i")).first()
    assert tuple(row) == ("0.123** (0.045)", "F(3, 100) = 12.34, p = <0.001", "N = 12,345", "50.0%", "45.0%", "+0.500", "[1.000, 2.000]")


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 9.0), (3, "a", 9.0), (4, None, 1.0), (5, None, 2.0), (6, "b", None), (7, "b", None)], "id int, g string, v double")
    assert sorted(r.id for r in K.largest_per_group(df, "g", "v", "id").collect()) == [2, 4, 5, 6]
    assert [r.k for r in K.surrogate_key(df, "k", [F.col("id").desc()]).orderBy("id").collect()] == [7, 6, 5, 4, 3, 2, 1]
    assert [r.c for r in K.dense_codes(df, "g", "c").orderBy("id").collect()] == [0, 0, 0, -1, -1, 1, 1]
    text = spark.createDataFrame([("1", "x"), ("2", "3")], "a string, b string")
    assert dict(K.cast_or_keep(text, {"a": "int", "b": "int", "c": "int"}).dtypes) == {"a": "int", "b": "string"}
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "x double")
    assert [r.x for r in K.infinities_to_null(odd).collect()] == [None, None, 1.0]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, -1.0), (2, None, -1.0), (None, "z", None)], "id int, g string, v double")
    rules = [Q.no_missing(df, ["id", "absent"]), Q.unique("id"), Q.value_range("v", 0), Q.categorical("g", ["a"]), Q.no_duplicates(df), Q.row_count(5), Q.non_negative("v")]
    assert [(r.n_failures, r.passed) for r in Q.validate(df, rules).collect()] == [(1, False), (2, False), (2, False), (1, False), (1, False), (4, False), (2, False)]
    with pytest.raises(ValueError):
        Q.validate_or_raise(df, rules)
    assert {r.column: r.n_null for r in Q.null_counts(df).collect()} == {"id": 1, "g": 2, "v": 1}
    assert {r.column: r.status for r in Q.schema_report(df, {"id": "int", "g": "float", "q": "int"}).collect()} == {"id": "ok", "g": "type", "q": "missing"}
    a, b = Q.table_hash(df).first(), Q.table_hash(df.orderBy(F.desc("v")).repartition(3)).first()
    assert a == b and Q.table_hash(df.withColumn("v", F.col("v") + 1)).first() != a
    assert Q.column_coverage(df, []) == ([], [], 1.0) and Q.compare_columns(df, df.drop("g"))["removed"] == ["g"]


def test_panel(spark):
    rows = [(i, t, float(i * t), int(i <= 5 and t >= 4)) for i in range(1, 11) for t in range(1, 7) if not (i > 7 and t > 4)]
    df = spark.createDataFrame(rows, "id int, period int, y double, t int")
    assert P.balance(df, "id", "period").select("id").distinct().count() == 7
    assert P.balance(df, "id", "period", "zero").count() == 60
    filled = {(r.id, r.period): r.y for r in P.balance(df, "id", "period", "ffill").collect()}
    assert filled[(9, 6)] == 36.0
    e = {(r.id, r.period): r.event_time for r in P.event_time(df, "id", "period", "t").collect()}
    assert e[(1, 2)] == -2 and e[(9, 1)] is None
    d = P.diagnostics(df, "id", "period", "t").first()
    assert (d.n_units, d.n_periods, d.n_obs, d.balanced, d.treated_units, d.control_units) == (10, 6, 54, False, 5, 5)


def test_regression_against_numpy(spark):
    r = np.random.default_rng(7)
    x, z, g = r.normal(size=200), r.normal(size=200), r.integers(0, 20, 200)
    y = 1 + 2 * x - z + r.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for a, b, c, k in zip(y, x, z, g, strict=True)], "y double, x double, z double, g int")
    spec = E.Specification("s", "y", ("x", "z"), cluster="g")
    m = np.column_stack([np.ones(200), x, z])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    u = y - m @ beta
    inv = np.linalg.inv(m.T @ m)
    plain, right, compat = (E.ols(df, spec, e) for e in ("homoskedastic", "clustered", "compat_clustered"))
    assert np.allclose(list(plain.coefficients.values()), beta)
    assert np.allclose(list(plain.errors.values()), np.sqrt(np.diag(inv * (u @ u) / 197)))
    factor = 20 / 19 * 199 / 197
    scores = np.array([(m[g == k] * u[g == k, None]).sum(0) for k in range(20)])
    assert np.allclose(list(right.errors.values()), np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * factor))
    assert np.allclose(list(compat.errors.values()), np.sqrt(np.diag(inv @ ((m * u[:, None] ** 2).T @ m) @ inv) * factor))
    assert plain.stars == "***"
    with pytest.raises(ValueError, match="Insufficient"):
        E.ols(df.limit(2), E.Specification("s", "y", ("x", "z")))
    effects = E.ols(df, E.Specification("fe", "y", ("x", "z"), ("g",)))
    dm = lambda v: v - np.array([v[g == k].mean() for k in g])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), dm(x), dm(z)]), dm(y), rcond=None)[0]
    assert np.allclose(list(effects.coefficients.values()), want, atol=1e-8)


def test_t_distribution():
    assert abs(E.t_cdf(2.0, 10) - 0.963306) < 1e-4 and abs(E.t_quantile(0.975, 10) - 2.228139) < 1e-3
    assert abs(E.t_cdf(1.96, 1000) - 0.975) < 1e-4 and E.t_quantile(0.975, 50, compat=True) == 1.96 * 1.01


def test_jackknife_and_leave_out(records, entities):
    full = {r.entity: r.probability for r in D.expected_probability(records, entities).collect()}
    jack = R.jackknife(records, entities).collect()
    for r in jack:
        assert abs(r.full - full[r.entity]) < 1e-12
    left = {e.entity: e.probability for e in D.expected_probability(records.where("record_id <> 6"), entities).collect()}
    mine = next(r for r in jack if r.entity == 2 and r.profile.zone == "ae")
    assert abs(mine.without - left[2]) < 1e-12


def test_folds_bands_and_blocks(spark):
    df = spark.createDataFrame([(i, i % 7, float(i)) for i in range(100)], "id int, g int, v double")
    folds = R.group_folds(df, "g", 3)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [28, 29, 43] or sum(sizes) == 100
    assert {r.band: r["count"] for r in R.quantile_bands(df, "v", 4).groupBy("band").count().collect()} == {0: 25, 1: 25, 2: 25, 3: 25}
    assert R.spatial_blocks(df, "v", "v", 4).agg(F.max("block")).first()[0] <= 3
    fitted = R.cross_validated_r2(df.withColumn("f", F.col("id") % 5).withColumn("y", 3 * F.col("v") + 1), "f", "y", "v").collect()
    assert all(abs(r.r2 - 1) < 1e-9 for r in fitted)
    assert {r.stratum: r["count"] for r in R.strata(df, "v").groupBy("stratum").count().collect()} == {"low": 50, "mid": 40, "high": 10}


def test_distances_and_neighbours(spark):
    cities = spark.createDataFrame([(1, 40.7128, -74.0060), (2, 34.0522, -118.2437), (3, 41.8781, -87.6298), (4, 37.7749, -122.4194)], "id bigint, lat double, lon double")
    d = {(r.id, r.id2): r.distance for r in G.distance_pairs(cities, cities).collect()}
    assert 3.9e6 < d[(1, 2)] < 4.0e6 and d[(1, 1)] == 0
    near = {r.id: r.id2 for r in G.nearest(cities, cities.where("id <> 2"), 1, 6e5).collect()}
    assert near == {1: 1, 2: 4, 3: 3, 4: 4}
    lists = {r.id: r.neighbours for r in G.within_distance(cities, 6e5).collect()}
    assert lists == {1: [], 2: [4], 3: [], 4: [2]}


def test_near_pairs_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-89.9, 89.9, 300), r.uniform(-180, 180, 300), strict=True))] + [(900, 89.95, 10.0), (901, 89.95, -170.0), (902, 0.0, 179.99), (903, 0.0, -179.99)]
    pts = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    for most in (30_000.0, 800_000.0):
        want = {(x.id, x.id2) for x in G.distance_pairs(pts, pts).where(F.col("distance") <= most).collect()}
        got = [(x.id, x.id2) for x in G._near_pairs(pts, pts, most).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_polygons(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]
    polys = spark.createDataFrame([(1, square), (2, [[(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)]]), (3, [[(8.0, 4.0), (9.0, 4.0), (9.0, 9.0)]])], "pid bigint, rings array<array<struct<x: double, y: double>>>")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 20.0, 0.0)], "id bigint, x double, y double")
    assert [(r.id, r.pid) for r in G.points_in_polygons(pts, polys).collect()] == [(1, 1)]
    away = {r.id: r.distance for r in G.distance_to_polygons(pts, polys).collect()}
    assert away == {1: 0.0, 2: 0.5, 3: 0.0, 4: pytest.approx(math.hypot(11, 4))}
    pair = lambda k: {(r.pid, r.neighbour) for r in G.contiguity(polys, k).collect()}
    assert pair("rook") == {(1, 2), (2, 1)} and pair("queen") == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert {r.pid: r.area for r in G.centroid(polys).collect()}[1] == 15.0
    assert {r.id for r in G.within_buffer(pts, polys, 1.0).collect()} == {1, 2, 3}


def test_raster(spark):
    cells = spark.createDataFrame([(1, r, c, 40.0, float(c * 10)) for r in range(3) for c in range(3)], "tile int, row bigint, col bigint, lat double, elev double")
    slope = {(r.row, r.col): r.slope for r in G.slope_degrees(cells, 0.001).collect()}
    want = math.degrees(math.atan(10 / (111.32 * math.cos(math.radians(40)))))
    assert all(abs(v - want) < 1e-9 for v in slope.values())
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 0, 0, None), (2, 0.0, 0.0, 0, 0, 7.0), (3, 0.0, 0.0, 0, 0, 9.0)], "tile int, x0 double, y0 double, row bigint, col bigint, elev double")
    assert G.sample_raster(spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "id bigint, x double, y double"), tiles, 1.0).orderBy("id").collect() == [(1, 7.0), (2, None)]


def test_texts(spark):
    t = "Title\nManuscript word limit: no more than 8000 words\nDouble-blind review. Submit at ScholarOne. Submission fee $1,200. Double-spaced, Times New Roman 12 pt, 2.5 cm margins. APA style. .docx or pdf. Figures need 300 dpi. Data availability statement is required. APC 2,500 USD."
    row = spark.createDataFrame([(t,)], "t string").select(T.word_limit(F.col("t")).alias("w"), T.peer_review(F.col("t")).alias("p"), T.submission_system(F.col("t")).alias("s"), T.submission_fee(F.col("t")).alias("f"), T.line_spacing(F.col("t")).alias("l"), T.font(F.col("t")).alias("o"), T.margins(F.col("t")).alias("m"), T.reference_style(F.col("t")).alias("r"), T.file_formats(F.col("t"), [".docx", "pdf", "tex"]).alias("x"), T.dpi(F.col("t"), "figures").alias("d"), T.data_availability_required(F.col("t")).alias("a"), T.processing_charge(F.col("t")).alias("c")).first()
    assert (row.w, row.p, row.s, row.f, row.l, tuple(row.o), tuple(row.m), row.r, row.x, row.d, row.a, tuple(row.c)) == (8000, "double-blind", "ScholarOne", 1200, "double", ("Times New Roman", 12), (2.5, "cm"), "author-year", [".docx", "pdf"], 300, True, (2500, "USD"))
    md = "---\ntitle: x\n---\nOne `code` [two](http://a) ![three](b)\n```\nskip\n```\nfour"
    row = spark.createDataFrame([(md,)], "t string").select(T.markdown_words(F.col("t")).alias("n"), T.slug(F.lit(" A b--C! ")).alias("s"), T.slug(F.lit("--")).alias("e"), T.html_to_text(F.lit("<p>a&amp;b</p><script>x</script>")).alias("h"), T.plain_whitespace(F.lit("a \t b\r\n\n\n\nc–d ")).alias("w")).first()
    assert (row.n, row.s, row.e, row.h, row.w) == (4, "a_b_c", "journal", "\na&b\nx", "a b\n\nc-d")
    assert spark.range(1).select(T.tracker_status(F.lit("VALID - ACTION NEEDED")).alias("a"), T.tracker_status(F.lit("invalid")).alias("b")).first() == ("VALID - ACTION NEEDED", "INVALID")


def test_slugs_keep_ascii_letters_and_digits_only(spark):
    texts = ["", None, "___", "é", "A_b__C9", "_x_", "Straße No.1\n\tЖ ２ 3", "a😀b\u212ac\u0130d", "\x00z\x7f", "@A[`a{/0:"]
    want = ["journal", "journal", "journal", "journal", "a_b_c9", "x", "stra_e_no_1_3", "a_b_c_d", "z", "a_a_0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.slug(F.col("t")).alias("s")).collect()
    assert [r.s for r in sorted(rows)] == want


def test_sources(spark, tmp_path):
    from lodestar.sources import io, synthetic

    df = spark.createDataFrame([(1, "a")], "id int, v string")
    for kind in ("parquet", "csv", "json"):
        io.save(df, f"{tmp_path}/x.{kind}")
    paths = io.find_inputs(spark, str(tmp_path), ["*.csv", "*.parquet", "*.json"])
    assert len(paths) == 3
    both, bad = io.load_all(spark, [*paths, f"{tmp_path}/none.parquet"])
    assert both.count() == 3 and len(bad) == 1 and io.count_rows(spark, paths[-1]) == 1
    with pytest.raises(ValueError, match="Unsupported"):
        io.load(spark, "x.gpkg")
    assert synthetic.panel(spark).where("treatment = 1").count() == 25 * 12
    assert synthetic.time_series(spark, 2, 5).count() == 10
    assert synthetic.unbalanced_panel(spark).count() < 1200


def test_streaming_equals_batch(spark, tmp_path):
    from lodestar.streaming.qa import rolling_metrics

    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", "k", None if i % 4 == 0 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id int, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = rolling_metrics(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("qa").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("qa").collect())) == sorted(map(str, rolling_metrics(df).collect()))


def test_ranks_of_large_integers(spark):
    """Values that a double can't tell apart keep their own ranks."""
    rows = [(2**53 + i, i) for i in range(200)]
    out = M.spearman(spark.createDataFrame(rows, "x bigint, y bigint"), "x", "y").first()
    assert out.spearman == pytest.approx(1.0)


def test_running_sums_over_all_kinds_of_scores(spark):
    import math

    scores = [0.0, -0.0, -1.5, 1e-300, 1e300, -1e300, 0.1, 0.1, 0.30000001, 2.0, -2.0, float("inf"), -7.25]
    rows = [(s, i % 2) for i, s in enumerate(scores)]
    got = {r.s: (r.tp, r.fp) for r in M.running(M.by_score(spark.createDataFrame(rows, "s double, y int"), "s", "y")).collect()}
    for s, (tp, fp) in got.items():
        assert tp == sum(y for x, y in rows if x >= s) and fp == sum(1 - y for x, y in rows if x >= s), s
    assert len(got) == len({s + 0.0 if not math.isinf(s) else s for s in scores})
    one = M.all_metrics(spark.createDataFrame(rows, "s double, y int").where("abs(s) < 3"), "s", "y").first()
    assert 0 <= one.roc_auc <= 1 and 0 <= one.pr_auc <= 1


def test_t_distribution_compat():
    from lodestar.operators.estimation import t_cdf, t_quantile

    assert t_cdf(0.0, 10, True) == 0.5 and t_cdf(2.0, 10, True) + t_cdf(-2.0, 10, True) == pytest.approx(1.0)
    assert t_quantile(0.975, 20, True) == pytest.approx(1.96 * 1.025) and t_quantile(0.975, 500, True) == pytest.approx(1.96 / math.sqrt(2), abs=0.02)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)


def test_robustness_results(spark):
    from lodestar.operators import estimation as E

    rows = [(u, p, 2.0 * (p >= 13 and u <= 25) + u + 0.1 * p + ((u * 7 + p * 13) % 11) / 10, int(p >= 13 and u <= 25), int(u <= 25), 1e9 + u * p % 7) for u in range(1, 51) for p in range(1, 25)]
    panel = spark.createDataFrame(rows, "id int, period int, outcome double, treatment int, ever_treated int, control double")
    placebo = E.placebo_tests(panel, "id", "period", "outcome", "ever_treated").collect()
    assert len(placebo) == 4 and all(r.test_type == "placebo" and "placebo" in r.name for r in placebo)
    assert E.placebo_tests(panel.drop("period"), "id", "period", "outcome", "ever_treated").count() == 0
    named = E.specifications("outcome", "treatment", ["control"], "id", "period")
    assert set(named) == {"baseline", "no_fe", "with_controls", "unit_fe_only"}
    tests = E.restriction_tests(panel, named["with_controls"]).collect()
    assert {r.test_type for r in tests} == {"sample", "specification"} and {r.name for r in tests} == {"full", "trimmed", "winsorised", "no_effects", "no_controls"}
    assert next(r.effect for r in tests if r.name == "full") == pytest.approx(2.0, abs=0.2)
    with pytest.raises(ValueError, match="Insufficient observations"):
        E.two_column_ols(panel.limit(2), "outcome", "control")
    far = spark.createDataFrame([(1e9 + x, 3.0 * x + 5 + (x % 3) / 100) for x in range(50)], "x double, y double")
    assert E.two_column_ols(far, "y", "x").coefficients["x"] == pytest.approx(3.0, abs=1e-3)


def test_fuzzy_ties_and_pieces(spark):
    from lodestar.operators import linkage as L

    right = spark.createDataFrame([("abcx", 2), ("abcy", 1), ("zz", 3), ("", 4)], "r string, at int")
    left = spark.createDataFrame([("abcd",), ("",), ("z",), (None,)], "l string")
    got = {r.left_value: r.right_value for r in L.fuzzy_match(left, right, "l", "r", 0.7, order=F.col("at")).collect()}
    assert got == {"abcd": "abcy", "": ""}
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(120)]
    a, b = words[:60], words[60:]
    found = L.fuzzy_match(spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string"), "l", "r", 0.6)

    def far(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    want = {}
    for x in set(a):
        best = max((1 - far(x, y) / max(len(x), len(y)) for y in b))
        if best >= 0.6 - 1e-12:
            want[x] = best
    assert {x.left_value: pytest.approx(x.score) for x in found.collect()} == want


def test_distances_by_reach(spark):
    from lodestar.operators import spatial as G

    r = random.Random(5)
    rings = [(i, [[(x := r.uniform(0, 50), y := r.uniform(0, 50)), (x + 1, y), (x + 1, y + 1)]]) for i in range(20)]
    polygons = spark.createDataFrame([(p, [[{"x": a, "y": b} for a, b in ring] for ring in q]) for p, q in rings], "pid bigint, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(i, r.uniform(-300, 300), r.uniform(-300, 300)) for i in range(30)] + [(99, 5000.0, 5000.0)], "id bigint, x double, y double")
    near, far = ({x.id: x.distance for x in G.distance_to_polygons(points, polygons, most_stated=n).collect()} for n in (10_000, 0))
    assert near.keys() == far.keys() and all(near[i] == pytest.approx(far[i]) for i in near)


def test_draws_are_not_counted_by_row(spark):
    """Nearly all draws differ, so a task that counts them by row holds them all; null values are no part of a mean."""
    import hashlib

    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i)) for i in range(40)], "k bigint, v double")
    means = R.resampled_means(df, "k", "v", 3)
    got = {r["replicate"]: r["mean"] for r in means.collect()}
    for rep in range(3):
        drawn = [int(hashlib.md5(f"42|{rep}|{i}".encode()).hexdigest()[:15], 16) % 40 for i in range(40)]
        known = [float(x) for x in drawn if x % 5]
        assert abs(got[rep] - sum(known) / len(known)) < 1e-9
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [replicate" in plan and "row#" not in "".join(x for x in plan.split("\n") if "Aggregate [" in x)


def test_counts_by_size_are_those_of_the_draws(spark):
    records = spark.createDataFrame([(i, str(i % 3), None) for i in range(40)], "record_id bigint, key string, zone string")
    entities = spark.createDataFrame([(i, str(i % 3), None) for i in range(15)], "entity_id bigint, key string, zone string")
    m = C.Matching(use_zone=False)
    rows = lambda df: sorted(map(tuple, df.select("size", "entity", "draw_count").collect()))
    counts = D.drawn_counts_by_size(records, entities, [2, 5, 7], 3, m)
    assert rows(counts) == rows(R.nested_draw_counts(D.hashed_draws(records, entities, 7, 3, m), [2, 5, 7]))
    truth = entities.where("entity_id > 6").select(F.col("entity_id").alias("entity"))
    for df in (R.count_metrics(counts, truth, "size"), R.seed_metrics(records, entities, 3, [1, 2], truth, m)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Window [" in x and "draw_count" in x]
