"""Sums of a Gaussian in the difference of two values, plus a constant, over all pairs of a group, without the pairs.

Values fall into cells half a sigma wide. With z the distance of two centres and d that of the values' places in their
cells, the Gaussian at z + d is its Taylor series at z, and powers of d part into powers of either place. So a cell is
its sums of powers, the cells near another add up to one polynomial there, and a value costs its cell's polynomial.
Beyond ``ORDER`` the series is below 1e-16 (|d| is at most a half, and the p-th term at most 2 * |d|**p / sqrt(p!)), and
a cell is only left out where its Gaussian is lost in the constant's rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import stored

ORDER = 20
#: Errors are some 1e-15 of the Gaussian's peak, so a constant below this would show them.
LEAST_FLOOR = 1e-6


def _centre(sigma: float) -> Column:
    return F.rint(F.col("x") / (sigma / 2)) * (sigma / 2)


def _place(sigma: float) -> Column:
    return (F.col("x") - F.col("c")) / sigma


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, at, z, m0, m1, ...) with the polynomial (a0, a1, ...) of each source cell about the target's centre."""
    for b in batches:
        z = b.column("z").to_numpy(zero_copy_only=False)
        slopes = [np.exp(-z * z / 2), -z * np.exp(-z * z / 2)]
        for p in range(1, ORDER):
            slopes.append(-z * slopes[p] - p * slopes[p - 1])
        sums = [b.column(f"m{n}").to_numpy(zero_copy_only=False) for n in range(ORDER + 1)]
        a = {f"a{m}": pa.array(sum(sums[n] * slopes[m + n] for n in range(ORDER + 1 - m)) / math.factorial(m)) for m in range(ORDER + 1)}
        kept = {name: b.column(name) for name in b.schema.names if name != "z" and name not in {f"m{n}" for n in range(ORDER + 1)}}
        yield pa.RecordBatch.from_pydict(kept | a)


def gaussian_sums(sources: DataFrame, targets: DataFrame, keys: Sequence[str], sigma: float, floor: float) -> DataFrame:
    """The targets (keys, x, ...) with total: the sum of w * (exp(-((x - x') / sigma)**2 / 2) + floor) over the sources
    (keys, x', w) of the same keys. Sources without x' or w do not count; the total is null without x or any source.

    Both tables are read more than once. Values that are not numbers make the totals what they make of the pairs.
    """
    if not (sigma > 0 and floor >= LEAST_FLOOR):
        raise ValueError(f"sigma must be positive and the constant at least {LEAST_FLOOR}")
    reach = math.sqrt(2 * math.log(2**53 / floor)) + 0.5
    cell = F.floor(F.greatest(F.least(F.col("c") / (reach * sigma), F.lit(2.0**60)), F.lit(-(2.0**60)))).alias("cell")
    known = sources.where(F.col("x").isNotNull() & F.col("w").isNotNull()).withColumn("c", _centre(sigma))
    whole = known.groupBy(*keys).agg((F.sum(F.when(F.isnan("x"), F.lit(float("nan"))).otherwise(F.col("w"))) * floor).alias("rest"))
    powers = [F.sum(F.col("w") * F.pow(-_place(sigma), F.lit(n)) / float(math.factorial(n))).alias(f"m{n}") for n in range(ORDER + 1)]
    cells = known.groupBy(*keys, "c").agg(*powers).withColumn("cell", cell)
    wanted = targets.where("x is not null").select(*keys, _centre(sigma).alias("c")).distinct()
    asked = wanted.select(*keys, F.col("c").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    z = (F.col("at") - F.col("c")) / sigma
    pairs = cells.join(asked, [*keys, "cell"]).withColumn("z", z).where(F.isnan("z") | (F.abs("z") <= reach)).drop("cell", "c")
    names = [f"a{m}" for m in range(ORDER + 1)]
    schema = StructType([*pairs.select(*keys, "at").schema, *[StructField(a, DoubleType()) for a in names]])
    moved = pairs.select(*keys, "at", "z", *[f"m{n}" for n in range(ORDER + 1)]).mapInArrow(_near, schema)
    near = moved.groupBy(*keys, F.col("at").alias("c")).agg(*[F.sum(a).alias(a) for a in names])
    here = stored(wanted.join(whole, list(keys)).join(near, [*keys, "c"], "left"), "polynomials")
    there = targets.withColumn("c", _centre(sigma)).join(here, [*keys, "c"], "left").withColumn("s", _place(sigma))
    value = F.col(names[-1])
    for a in reversed(names[:-1]):
        value = value * F.col("s") + F.col(a)
    total = F.when(F.isnan("x") & F.col("rest").isNotNull(), F.lit(float("nan"))).otherwise(F.col("rest") + F.coalesce(value, F.lit(0.0)))
    return there.select(*targets.columns, total.alias("total"))
