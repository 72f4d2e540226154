"""Summaries of columns and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import quantiles


def group_rates(df: DataFrame, key: str, column: str, hit: Column, digits: int = 3) -> DataFrame:
    """key, column_mean, column_sum, count, match_rate: rows without a key are left out; the rate is rounded."""
    n = F.count(F.lit(1))
    out = df.where(F.col(key).isNotNull()).groupBy(key)
    return out.agg(F.avg(column).alias(f"{column}_mean"), F.sum(column).alias(f"{column}_sum"), n.alias("count"), F.round(F.count_if(hit) / n, digits).alias("match_rate"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, lo, hi, n: equal widths from the least to the largest value, which lies in the last bin; empty bins have 0."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("all"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("a"), width), F.lit(0))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).crossJoin(ends).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.where("all > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda i: F.col("a") + width * i
    return grid.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n, mean, std, min, q25, q50, q75, max by few passes over all columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.join(quantiles(long, "v", (0.25, 0.5, 0.75), ("column_name",), "q"), "column_name", "left").select("column_name", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def cell_sums(cells: DataFrame, grid: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value: sums by cell over a grid of cells; a cell without rows has 0."""
    sums = cells.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return grid.select(*keys).distinct().join(sums, list(keys), "left").select(*keys, F.coalesce("_sum", F.lit(0)).alias(value))


def registry_place(column: str, names: Sequence[str]) -> list[Column]:
    """What to order by for the order in which a registry names the values; others come last by name."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)) if names else F.lit(0)
    return [F.when(place > 0, place).otherwise(len(names) + 1), F.col(column)]


def in_registry_order(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.orderBy(*registry_place(column, names))
