"""Exact quantiles by selection: a sketch brackets each wanted rank, and only values in a bracket are counted by value.

A mergeable sketch gives two values between which a rank must lie, a fraction of a thousandth of the rows apart. One
pass then counts the rows below each bracket, another counts the distinct values inside, and prefix sums in two levels
find the values at the ranks. No task holds more than a range of a bracket's distinct values, and a value that a third
of all rows have is one row. Quantiles interpolate between neighbours.

A sketch depends on the order in which its parts arrive, so it is written once: both counts must see the same brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..storage import stored
from .metrics import running

#: Accuracy of the sketch; its ranks are off by a share of 1 / ACCURACY at most, and brackets reach MARGIN times as far.
ACCURACY, MARGIN = 10_000, 3
#: Up to so many rows the bracket is all values.
SMALL = 20_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "_e") -> DataFrame:
    """by, out: an array of the quantiles at the shares, in their order; one row without ``by``. Nulls are left out.

    ``by``: keys with few values, such as names of columns. No values: an array of nulls (a row without ``by`` only).
    """
    shares = [float(p) for p in shares]
    keys = list(by)
    v = df.select(*keys, F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    ends = [x for p in shares for x in (max(0.0, p - MARGIN / ACCURACY), min(1.0, p + MARGIN / ACCURACY))]
    sketch = stored(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("ends")), "sketch")
    # the extremes and small tables have open brackets
    low = [F.when((F.col("n") <= SMALL) | F.lit(p <= MARGIN / ACCURACY), float("-inf")).otherwise(F.col("ends")[2 * i]) for i, p in enumerate(shares)]
    high = [F.when((F.col("n") <= SMALL) | F.lit(p >= 1 - MARGIN / ACCURACY), float("nan")).otherwise(F.col("ends")[2 * i + 1]) for i, p in enumerate(shares)]
    brackets = F.broadcast(sketch.select(*keys, "n", F.array(*low).alias("low"), F.array(*high).alias("high")))  # a row a key
    met = v.join(brackets, keys) if keys else v.crossJoin(brackets)
    below = met.groupBy(*keys, "n").agg(F.array(*[F.count_if(F.col("v") < F.col("low")[i]) for i in range(len(shares))]).alias("below"))
    which = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: (F.col("v") >= F.get("low", i)) & (F.col("v") <= F.get("high", i)))  # nan is above all
    inside = met.select(*keys, "v", F.explode(which).alias("i")).groupBy(*keys, "i", F.col("v").alias("s")).agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("bigint").alias("n"))
    sums = running(inside, (*keys, "i"), descending=False).select(*keys, "i", "s", "p", "tp")
    at = F.element_at(F.array(*[F.lit(p) for p in shares]), F.col("i") + 1) * (F.col("n") - 1)
    ranked = sums.join(F.broadcast(below), keys) if keys else sums.crossJoin(F.broadcast(below))
    ranked = ranked.withColumn("at", at).withColumn("from", F.get("below", F.col("i")) + F.col("tp") - F.col("p")).withColumn("to", F.get("below", F.col("i")) + F.col("tp"))
    value = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("to")), F.col("s")))
    found = ranked.groupBy(*keys, "i", "at").agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    part = F.col("at") - F.floor("at")
    between = F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(between)
    rows = F.array_sort(F.collect_list(F.struct("i", sure.alias("q"))))  # a row a share
    got = found.groupBy(*keys).agg(F.transform(rows, lambda x: x["q"]).alias("q"))
    none = F.array(*[F.lit(None).cast("double")] * len(shares))
    return got.select(*keys, F.when(F.size("q") == 0, none).otherwise(F.col("q")).alias(out))
