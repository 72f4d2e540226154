"""Files laid out for boxes, features by line, folds of any number of groups, KS over large integers, draws by record."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.operators import disaggregation as D, metrics as M, resampling as R
from lodestar.operators.candidates import Columns, Matching
from lodestar.sources import io


def scanned(df):
    """Rows that the file scan gave, after the query ran."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text = plan.toString()
    todo, found = [plan], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan"):
            found += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found, text


def test_a_box_reads_few_rows(spark, tmp_path):
    points = spark.range(40_000).select("id", (F.rand(1) * 100).alias("x"), (F.rand(2) * 50).alias("y"))
    io.save_for_boxes(points.unionByName(spark.createDataFrame([(-1, None, 3.0)], "id bigint, x double, y double")), str(tmp_path / "p"), "x", "y", 16)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 40_001
    some = io.in_box(back, (10.0, 10.0, 14.0, 13.0), ("x", "y", "x", "y"))
    rows, plan = scanned(some.select("id", "x", "y"))
    assert "PushedFilters" in some._jdf.queryExecution().executedPlan().toString() and rows < 10_000
    files = some.select(F.input_file_name()).distinct().count()
    assert some.count() == back.where("x BETWEEN 10 AND 14 AND y BETWEEN 10 AND 13").count() > 100 and files <= 6


def test_features_by_line(spark, tmp_path):
    shape = "struct<type: string, coordinates: array<array<array<double>>>>"
    df = spark.createDataFrame([(1, "a", ("Polygon", [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]])), (2, None, ("Polygon", [[[5.0, 5.0], [6.0, 5.0], [5.0, 6.0], [5.0, 5.0]]]))], f"id bigint, name string, geometry {shape}")
    io.save_geojson(df, str(tmp_path / "f"))
    back = io.load_geojson(spark, str(tmp_path / "f")).select("properties.*", "geometry")
    assert {(r.id, r.name, r.geometry.type, str(r.geometry.coordinates)) for r in back.collect()} == {(r.id, r.name, r.geometry.type, str(r.geometry.coordinates)) for r in df.collect()}


def test_folds_by_one_rule(spark):
    """Largest first, each to the lightest: group by group here, by distinct sizes there."""
    r = random.Random(3)
    sizes = {f"g{i:04d}": r.choice((1, 1, 1, 2, 3, 3, 7, 40, r.randint(1, 90))) for i in range(400)} | {None: 25}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    for folds in (1, 3, 7):
        load, want = [0] * folds, {}
        for g, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or "")):
            want[g] = load.index(min(load))
            load[want[g]] += n
        out = R.group_folds(df, "g", folds).groupBy("g", "fold").count().collect()
        assert {x.g: x.fold for x in out} == want and len(out) == len(sizes)
    assert R.group_folds(df.where("g = 'none'"), "g", 3).count() == 0


def test_ks_of_large_integers(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + i, int(i >= 4)) for i in range(8)], "v bigint, s int")
    assert M.ks_statistic(df, "v", "s").first().ks == 1.0


def test_diagnostics_by_record_and_by_draw(spark, monkeypatch):
    records = spark.createDataFrame([(i, "k", "A") for i in range(20)], "id int, key string, zone string")
    entities = spark.createDataFrame([(100 + i, "k", "A") for i in range(6)], "id int, key string, zone string")
    m = Matching("strict", columns=Columns("id", "id", "key", "zone"))
    out = []
    for few in (64, 0):
        monkeypatch.setattr(D, "FEW_DRAWS", few)
        out.append(sorted(map(tuple, D.record_diagnostics(records, entities, 31, 5, m).collect())))
    assert out[0] == out[1] and len(out[0]) == 20


def test_weighted_draws_against_brute_force(spark):
    """With weights of 0 at the beginning, in the middle and at the end."""
    import hashlib

    weights = {r: [(e, w) for e, w in enumerate(own)] for r, own in {1: [0, 2, 0, 0, 1, 3, 0], 2: [1], 3: [0, 0, 5], 4: [1, 1, 1, 1], 5: [4, 0]}.items()}
    pairs = spark.createDataFrame([(r, e, float(w)) for r, own in weights.items() for e, w in own], "record int, entity int, w double").repartition(3)
    got = {(x.record, x.draw): x.entity for x in D.weighted_draws(pairs, F.col("w"), 40, 9).collect()}
    want = {}
    for r, own in weights.items():
        total = sum(w for _, w in own)
        for i in range(40):
            u, upto = int(hashlib.md5(f"9|{r}|{i}".encode()).hexdigest()[:15], 16) / (1 << 60), 0.0
            for e, w in own:
                upto += w
                if upto / total > u:
                    want[r, i] = e
                    break
    assert got == want and len(want) == 200
