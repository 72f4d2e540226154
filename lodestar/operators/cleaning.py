"""Cleaning of rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import finite
from ..storage import stored


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def drop_duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """One row of each; with keys the first in ``order``. Nulls are equal."""
    if not keys:
        return df.dropDuplicates()
    w = W.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in df.columns]))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def infinities_to_null(df: DataFrame, fill: float | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    out = df.select(*[finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
    return out if fill is None else out.na.fill(fill)


def cast_or_keep(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts whole columns; one in which a value can't be cast stays as it is. One pass tells which."""
    have = {c: t for c, t in types.items() if c in df.columns}
    if not have:
        return df
    failed = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in have.items()]).first()
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in have.items() if not failed[c]})


def surrogate_key(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """1, 2, 3 ... in an explicit order, numbered by range so that no task holds all rows.

    The ranges are sampled, so the rows are written with their places once, before the sizes of the ranges are counted.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    within = stored(placed.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(*order))), "numbered")
    sums = within.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sums.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return within.join(before, "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_range", "_place", "_before")


def largest_per_group(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row with the largest value of each group, of equals the lowest ``tie``; an all-null group keeps its lowest
    ``tie``; rows without a group all stay."""
    w = W.partitionBy(group).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    best = df.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.unionByName(df.where(F.col(group).isNull()))


def in_force(effective: Column, termination: Column, start: Column, end: Column) -> Column:
    """In force at some time of the window; no termination means still in force."""
    return (effective <= end) & (termination.isNull() | (termination >= start))


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """0, 1, 2 ... by value, -1 for null: the distinct values are numbered and joined back."""
    values = surrogate_key(df.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull()).distinct(), "_k", [F.col("_v")])
    return df.join(values, df[column] == values["_v"], "left").withColumn(out, F.coalesce(F.col("_k") - 1, F.lit(-1)).cast("bigint")).drop("_v", "_k")
