"""Panels: balance, event time, treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def diagnostics(df: DataFrame, unit: str, period: str, treatment: str | None = None) -> DataFrame:
    ever = [F.countDistinct(F.when(F.col(treatment) == 1, F.col(unit))).alias("treated_units"), F.avg(F.col(treatment).cast("double")).alias("treatment_share")] if treatment else []
    out = df.agg(F.countDistinct(unit).alias("n_units"), F.countDistinct(period).alias("n_periods"), F.count(F.lit(1)).alias("n_obs"), *ever)
    cells = F.col("n_units") * F.col("n_periods")
    control = [(F.col("n_units") - F.col("treated_units")).alias("control_units")] if treatment else []
    return out.select("*", (F.col("n_obs") == cells).alias("balanced"), F.try_divide(F.col("n_obs").cast("double"), cells).alias("balance_rate"), *control)


def balance(df: DataFrame, unit: str, period: str, method: str = "drop") -> DataFrame:
    """drop: units with a row in every period; ffill, zero: the full grid, filled by the last value or with zeros."""
    if method == "drop":
        periods = df.agg(F.countDistinct(period).alias("_p"))
        counted = df.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(unit)))
        return counted.crossJoin(periods).where("_c = _p").drop("_c", "_p")
    grid = df.select(unit).distinct().crossJoin(df.select(period).distinct())  # the grid is what is asked for
    full = grid.join(df, [unit, period], "left")
    rest = [c for c in df.columns if c not in (unit, period)]
    if method == "ffill":
        w = W.partitionBy(unit).orderBy(period).rowsBetween(W.unboundedPreceding, 0)
        return full.select(unit, period, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in rest])
    if method == "zero":
        kinds = dict(df.dtypes)
        numeric = [c for c in rest if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
        return full.na.fill(0, subset=numeric).select(unit, period, *rest)
    raise ValueError(f"unknown method {method}")


def event_time(df: DataFrame, unit: str, period: str, treatment: str | None = None, start: str | None = None) -> DataFrame:
    """event_time: periods since the given start, or since the unit's first treated period; null if never."""
    first = F.col(start) if start else F.min(F.when(F.col(treatment) == 1, F.col(period))).over(W.partitionBy(unit))
    return df.withColumn("event_time", F.col(period) - first)


def treatment_indicators(df: DataFrame, unit: str, period: str, treatment: str, start: str | None = None) -> DataFrame:
    """ever_treated, and post (0 without a start) where a start column is named."""
    out = df.withColumn("ever_treated", F.max(treatment).over(W.partitionBy(unit)))
    return out.withColumn("post", F.coalesce((F.col(period) >= F.col(start)).cast("int"), F.lit(0))) if start else out


def event_means(df: DataFrame, outcome: str, lo: int, hi: int) -> DataFrame:
    """Mean, deviation, count and standard error of the outcome by event time, with a 1.96 band."""
    out = df.where(F.col("event_time").between(lo, hi)).groupBy("event_time").agg(F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("std"), F.count(outcome).alias("n"))
    se = F.col("std") / F.sqrt("n")
    return out.select("*", se.alias("se"), (F.col("mean") - 1.96 * se).alias("lo"), (F.col("mean") + 1.96 * se).alias("hi"))
