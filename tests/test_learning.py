from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import learning as L


def test_groups_are_balanced(spark):
    df = spark.range(103).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    sizes = [r["count"] for r in L.balanced_groups(df, "id", "x", "y", 8).groupBy("group").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert L.kmeans_groups(df, "x", "y", 4).select("group").distinct().count() == 4


def test_cross_validation_and_leakage(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4).alias("f"), (F.col("id") % 17).cast("double").alias("a")).withColumn("y", 2 * F.col("a") + 1)
    scores = L.cross_validate(df, "f", "ridge", ["a"], "y")
    assert scores.count() == 4 and L.summary(scores).first()["mean"] > 0.9
    gap = L.leakage(scores, scores).first()
    assert gap.leakage == 0 and gap.leakage_pct == 0


def test_leakage_of_contiguous_folds(spark):
    df = spark.range(41).select(F.col("id"), (F.col("id") % 4).alias("f"), (F.col("id") % 17).cast("double").alias("a"), F.lit(3.0).alias("same")).withColumn("y", 2 * F.col("a") + 1)
    folds = [r["count"] for r in L.contiguous_folds(df, "id", 4).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [11, 10, 10, 10]
    ends = L.contiguous_folds(df, "id", 4).groupBy("fold").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("fold").collect()
    assert [(r.a, r.b) for r in ends] == [(0, 10), (11, 20), (21, 30), (31, 40)]
    out = L.scaled(df, df, ["a", "same"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("same").alias("z")).first()
    assert abs(out.m) < 1e-9 and abs(out.s - 1) < 1e-9 and out.z == 0
    assert L.spatial_leakage(df, "f", "id", "ridge", ["a", "same"], "y").first().leakage is not None
