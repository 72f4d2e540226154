"""Balanced and contiguity groups, and ridge regression from moments, against sequential versions and numpy."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import learning as L, moments as M


@pytest.mark.parametrize(("n", "k"), [(103, 5), (40, 7), (9, 4)])
def test_balanced_groups(spark, n, k):
    r = random.Random(n)
    points = [(i, r.gauss(0, 1) + 3 * (i % 3 == 0), r.gauss(0, 1)) for i in range(n)]
    out = L.balanced_groups(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", k).collect()
    sizes = sorted(sum(x.group == g for x in out) for g in range(k))
    assert len(out) == n and sizes == sorted(n // k + (i < n % k) for i in range(k))


def test_balanced_groups_cost_little_more_than_the_best(spark):
    """All ways to part eight points in two halves; and against strips of equal size on more."""
    r = random.Random(4)
    points = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(8)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {x.id: x.group for x in L.balanced_groups(df, "id", "x", "y", 2).collect()}
    centres = L.kmeans_centres(df, "x", "y", 2)
    cost = lambda half: sum(math.dist(p[1:], centres[0 if p[0] in half else 1]) for p in points)
    best = min(cost(set(h)) for h in itertools.combinations(range(8), 4))
    assert cost({i for i, g in got.items() if g == 0}) <= best * 1.1 + 1e-9


def test_balanced_groups_of_one_place(spark):
    df = spark.range(10).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert sorted(r["count"] for r in L.balanced_groups(df, "id", "x", "y", 3).groupBy("group").count().collect()) == [3, 3, 4]


def ward(units, links, k):
    """Always the cheapest pair of neighbours, one at a time."""
    clusters = {i: [(x, y)] for i, x, y in units}
    near = {frozenset(e) for e in links}

    def cost(a, b):
        p, q = np.array(clusters[a]), np.array(clusters[b])
        return len(p) * len(q) / (len(p) + len(q)) * float(((p.mean(0) - q.mean(0)) ** 2).sum())

    while len(clusters) > k and near:
        a, b = min((tuple(sorted(e)) for e in near), key=lambda e: (round(cost(*e), 9), *e))
        clusters[a] += clusters.pop(b)
        near = {frozenset(a if i == b else i for i in e) for e in near}
        near = {e for e in near if len(e) == 2}
    return clusters


def test_contiguity_groups_against_one_merge_at_a_time(spark):
    """Towns on a grid that the cheapest merges keep apart, so that any order of merging finds them."""
    r = random.Random(5)
    shift = {0: (0, 0), 1: (9, 0), 2: (0, 9), 3: (9, 9)}
    units, links = [], []
    for t, (dx, dy) in shift.items():
        for i in range(3):
            for j in range(3):
                units.append((t * 9 + 3 * i + j, dx + i + r.uniform(-0.2, 0.2), dy + j + r.uniform(-0.2, 0.2)))
                links += [(t * 9 + 3 * i + j, t * 9 + 3 * a + b) for a, b in ((i + 1, j), (i, j + 1)) if a < 3 and b < 3]
    links += [(2, 9), (8, 27), (5, 20), (17, 30), (26, 33)]
    both = [*links, *[(b, a) for a, b in links]]
    u, e = spark.createDataFrame(units, "id int, x double, y double"), spark.createDataFrame(both, "id int, neighbour int")
    for k in (4, 1):
        groups = {}
        for x in L.contiguity_groups(u, e, k).collect():
            groups.setdefault(x.group, set()).add(x.id)
        want = ward(units, links, k)
        where = {(x, y): i for i, x, y in units}
        assert sorted(map(sorted, groups.values())) == sorted(sorted(where[p] for p in c) for c in want.values())
    for k in (2, 7, 20):  # groups hang together
        groups = {}
        for x in L.contiguity_groups(u, e, k).collect():
            groups.setdefault(x.group, set()).add(x.id)
        assert len(groups) == k
        for own in groups.values():
            seen, todo = set(), [min(own)]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [b for a, b in both if a == i and b in own]
            assert seen == own


def test_parts_that_do_not_touch(spark):
    u = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id int, x double, y double")
    e = spark.createDataFrame([(0, 1), (3, 4)], "id int, neighbour int")
    assert {x.id: x.group for x in L.contiguity_groups(u, e, 1).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert L.contiguity_groups(u, e.where("id < 0"), 2).select("group").distinct().count() == 5


def data(n=300):
    r = np.random.default_rng(3)
    x = r.normal(1e4, 3, (n, 3)) * [1, 2, 0.1]
    y = 2 * x[:, 0] - x[:, 1] + r.normal(0, 2, n) + 1e5
    return x, y, r.integers(0, 4, n)


def plain_ridge(x, y, penalty):
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 0, s, 1)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - m) / s @ w + y.mean()


def r2(y, fitted):
    return 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_from_moments(spark):
    x, y, f = data()
    rows = [(int(f[i]), *map(float, x[i]), float(y[i]), i) for i in range(len(y))] + [(0, None, 1.0, 1.0, 1.0, 900), (1, 1.0, float("nan"), 1.0, 1.0, 901)]
    df = spark.createDataFrame(rows, "f int, a double, b double, c double, y double, id int").repartition(3)
    names, penalties = ["a", "b", "c"], [0.0, 1.0, 100.0, 1e5]
    score = lambda test, train, p, own=(0, 1, 2): r2(y[test], plain_ridge(x[train][:, own], y[train], p)(x[test][:, own]))
    got = {(r.penalty, r.fold): r.r2 for r in M.ridge_scores(df, "f", names, "y", penalties).collect()}
    assert len(got) == 16 and all(math.isclose(v, score(f == k, f != k, p), rel_tol=1e-6, abs_tol=1e-7) for (p, k), v in got.items())
    for r in M.nested_ridge(df, "f", names, "y", penalties).collect():
        inner = {p: np.mean([score(f == g, (f != g) & (f != r.fold), p) for g in range(4) if g != r.fold]) for p in penalties}
        best = max(penalties, key=lambda p: (inner[p], -p))
        assert r.penalty == best and math.isclose(r.inner_r2, inner[best], rel_tol=1e-6) and math.isclose(r.r2, score(f == r.fold, f != r.fold, best), rel_tol=1e-6)
    drop = {r.left_out: r.mean_r2 for r in M.ablation(df, "f", names, "y").collect()}
    for i, name in enumerate(names):
        own = [j for j in range(3) if j != i]
        assert math.isclose(drop[name], np.mean([score(f == k, f != k, 1.0, own) for k in range(4)]), rel_tol=1e-6)
    assert drop["c"] > drop["a"] and drop[None] >= drop["a"]
    again = [r.mean_r2 for r in M.repeated_scores(df, "id", names, "y", 3, 4).collect()]
    assert len(set(again)) == 4 and all(abs(v - drop[None]) < 0.1 for v in again)


def test_moments_add_up():
    x, y, f = data(50)
    every = np.column_stack([x, y])
    of = lambda v: M.Moments(len(v), v.mean(0), (v - v.mean(0)).T @ (v - v.mean(0)))
    both, whole = of(every[:20]) + of(every[20:]), of(every)
    assert both.n == 50 and np.allclose(both.mean, whole.mean) and np.allclose(both.products, whole.products, rtol=1e-9)
    assert M.Ridge.fit(whole, 1.0, []).r2(whole) == pytest.approx(0.0)


def test_extra_trees(spark):
    """Grown by levels as by a plain version over the same thresholds; better than the mean on new rows."""
    from lodestar.operators.extra_trees import ExtraTreesRegressor, Forest, grow

    r = np.random.default_rng(1)
    x = r.normal(0, 1, (400, 3))
    y = np.where(x[:, 0] > 0.3, 5.0, 0.0) + x[:, 1] + r.normal(0, 0.1, 400)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    forest = grow(df, 3, 4, 3, 2, 7)
    again = grow(df.repartition(5), 3, 4, 3, 2, 7)
    assert (forest.feature == again.feature).all() and np.allclose(forest.threshold, again.threshold)
    where = forest.nodes(x, 3)
    for t in range(4):
        for node in np.unique(where[t]):
            assert math.isclose(forest.value[t, node], y[where[t] == node].mean(), abs_tol=1e-9)
        root = forest.feature[t, 0], forest.threshold[t, 0]
        assert x[:, root[0]].min() <= root[1] <= x[:, root[0]].max()
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y, strict=True)], ["features", "t"])
    model = ExtraTreesRegressor(trees=12, depth=6).setLabelCol("t").fit(rows.limit(300))
    fitted = np.array([p.prediction for p in model.transform(rows).collect()])
    assert r2(y[300:], fitted[300:]) > 0.8 and isinstance(model.forest, Forest)
    scores = L.cross_validate(spark.createDataFrame([(int(i % 3), *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "f int, a double, b double, c double, y double"), "f", "extra_trees", ["a", "b", "c"], "y")
    assert all(s.r2 > 0.6 for s in scores.collect())
