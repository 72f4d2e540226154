"""Synthetic tables, made where they are used: every value follows from its keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(seed: int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, *keys: Column) -> Column:
    a, b = uniform(seed, F.lit("a"), *keys), uniform(seed, F.lit("b"), *keys)
    return F.sqrt(-2 * F.ln(a)) * F.cos(b * 6.283185307179586)


def panel(spark: SparkSession, units: int = 50, periods: int = 24, start: int = 13, treated_share: float = 0.5, effect: float = 1.0, seed: int = 42) -> DataFrame:
    """Balanced: units treated from ``start`` on, a unit effect, a trend and noise."""
    grid = spark.range(1, units + 1).withColumnRenamed("id", "unit_id").withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    treated = (F.col("unit_id") <= int(units * treated_share)) & (F.col("period") >= start)
    y = normal(seed, F.col("unit_id")) + 0.1 * F.col("period") + effect * treated.cast("double") + normal(seed + 1, F.col("unit_id"), F.col("period"))
    return grid.withColumn("treatment", treated.cast("int")).withColumn("outcome", y)


def unbalanced_panel(spark: SparkSession, missing: float = 0.1, seed: int = 42, **params) -> DataFrame:
    return panel(spark, seed=seed, **params).where(uniform(seed + 2, F.col("unit_id"), F.col("period")) >= missing)


def cross_section(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    df = spark.range(1, rows + 1)
    for i in (1, 2):
        df = df.withColumn(f"x{i}", normal(seed + i, F.col("id")))
    return df.withColumn("y", 1 + 2 * F.col("x1") - F.col("x2") + normal(seed + 3, F.col("id")))


def spatial(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    df = spark.range(1, rows + 1)
    return df.withColumn("latitude", 40 + 2 * uniform(seed, F.col("id"))).withColumn("longitude", -100 + 2 * uniform(seed + 1, F.col("id")))


def linkage_pair(spark: SparkSession, rows: int = 1000, overlap: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    left = spark.range(1, rows + 1).withColumn("name", F.concat(F.lit("name "), F.col("id")))
    return left, left.where(uniform(seed, F.col("id")) < overlap).withColumn("value", normal(seed + 1, F.col("id")))


def regression_discontinuity(spark: SparkSession, rows: int = 1000, cutoff: float = 0.0, jump: float = 1.0, seed: int = 42) -> DataFrame:
    df = spark.range(1, rows + 1).withColumn("running", 2 * uniform(seed, F.col("id")) - 1)
    return df.withColumn("treated", (F.col("running") >= cutoff).cast("int")).withColumn("outcome", F.col("running") + jump * F.col("treated") + 0.3 * normal(seed + 1, F.col("id")))


def time_series(spark: SparkSession, series: int = 10, length: int = 100, rho: float = 0.7, seed: int = 42) -> DataFrame:
    """AR(1) within each series, by a fold over its shocks."""
    shock = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: normal(seed, F.col("series"), t))
    walk = F.aggregate(shock, F.array().cast("array<double>"), lambda acc, e: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * rho + e)))
    return spark.range(series).withColumnRenamed("id", "series").select("series", F.posexplode(walk).alias("t", "value"))


def event_study(spark: SparkSession, units: int = 50, periods: int = 24, start: int = 12, lag_effect: float = 0.2, seed: int = 42) -> DataFrame:
    """A panel whose effect grows with the time since treatment; half of the units are never treated."""
    df = panel(spark, units, periods, start, 0.5, 0.0, seed)
    since = F.when(F.col("unit_id") <= units // 2, F.col("period") - start)
    return df.withColumn("event_time", since).withColumn("outcome", F.col("outcome") + F.coalesce(F.greatest(since + 1, F.lit(0)) * lag_effect, F.lit(0.0)))
