"""Ranking and probability metrics over (score, label), exact and tie-aware.

Rows are first counted by distinct score, so the windows run over distinct
scores. Scores fall into ranges by their logarithm, which keeps their order; the
sums of the ranges are few, and the other windows stay within a range. So the
table is read once, and no window holds all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import stored


def by_score(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), kind: str | None = "double") -> DataFrame:
    """keys, s, p (positives), n (negatives), null scores and labels left out; without a kind scores keep their own type."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return ok.groupBy(*keys, (F.col(score).cast(kind) if kind else F.col(score)).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))


def _range(s: Column, steps: int = 64) -> Column:
    """A number that never falls as s grows: so many ranges to each power of two."""
    x = s.cast("double")
    at = lambda v: F.least(F.greatest(F.floor(F.log2(v) * steps), F.lit(-2000 * steps)), F.lit(2000 * steps)).cast("int") + 3000 * steps
    return F.when(F.isnan(x), 9000 * steps).when(x > 0, at(x)).when(x < 0, -at(-x)).otherwise(0).cast("int")


def prefix_sums(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), value: str = "s", descending: bool = False) -> DataFrame:
    """Adds r (the range of the value) and, for each column, below_ (its sum over smaller values, or larger ones) and
    all_ (its sum over all), by keys. Values are distinct within the keys, and keep their own type."""
    placed = df.withColumn("r", _range(F.col(value)))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sums = placed.groupBy(*keys, "r").agg(*[F.sum(c).alias(c) for c in columns])
    own = W.partitionBy(*keys)
    across = own.orderBy(way("r")).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "r", *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(c).over(own).alias(f"all_{c}") for c in columns])
    within = W.partitionBy(*keys, "r").orderBy(way(value)).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(before, [*keys, "r"])
    return out.withColumns({f"below_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).drop(*[f"_b_{c}" for c in columns])


def running(counts: DataFrame, keys: tuple[str, ...] = (), descending: bool = True) -> DataFrame:
    """tp, fp: counts at or above each score (or at or below), and the totals all_p, all_n.

    Prefix sums in two levels: within ranges of scores, and over the sums of the ranges. Scores keep their own type.
    """
    out = prefix_sums(counts, ("p", "n"), keys, "s", descending)
    return out.select(*keys, "s", "p", "n", "all_p", "all_n", "r", (F.col("below_p") + F.col("p")).alias("tp"), (F.col("below_n") + F.col("n")).alias("fp"))


def roc_auc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, roc_auc: the share of (positive, negative) pairs in order, ties half; null with one class."""
    run = running(by_score(df, score, label, keys), keys, descending=False)
    # at or below: a positive beats all negatives strictly below and half of those tied
    part = F.col("p") * (F.col("fp") - F.col("n") + F.col("n") / 2.0)
    return run.groupBy(*keys).agg((F.sum(part) / F.nullif(F.max("all_p") * F.max("all_n"), F.lit(0))).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, threshold, precision, recall by distinct score."""
    run = running(by_score(df, score, label, keys), keys)
    return run.select(*keys, F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.nullif(F.col("all_p"), F.lit(0))).alias("recall"), "p", "n", "tp", "fp", "r")


def pr_auc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pr_auc: trapezoids over recall, beginning at recall 0 with precision 1."""
    curve = pr_curve(df, score, label, keys)
    # the point before a score is known from its own counts; above the first there is none
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    width = F.col("recall") - F.col("recall") * tp0 / F.nullif(F.col("tp"), F.lit(0))
    area = F.when(F.col("p") == 0, 0.0).otherwise(width * (F.col("precision") + before) / 2)
    return curve.groupBy(*keys).agg(F.sum(area).alias("pr_auc"))


def all_metrics(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, prevalence, roc_auc, pr_auc, brier, all from one running sum over distinct scores."""
    run = running(by_score(df, score, label, keys), keys)
    s, p, n, tp, fp = (F.col(c) for c in ("s", "p", "n", "tp", "fp"))
    tp0, fp0 = tp - p, fp - n
    before, now = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0)), tp / (tp + fp)
    area = F.sum(p * (now + before) / 2) / F.nullif(F.max("all_p"), F.lit(0))
    wins = F.sum(p * (F.col("all_n") - fp + n / 2.0)) / F.nullif(F.max("all_p") * F.max("all_n"), F.lit(0))
    size = F.sum(p + n)
    return run.groupBy(*keys).agg(size.alias("n"), (F.sum("p") / size).alias("prevalence"), wins.alias("roc_auc"), area.alias("pr_auc"), (F.sum(p * F.pow(s - 1, 2) + n * F.pow(s, 2)) / size).alias("brier"))


def roc_curve(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, threshold, fpr, tpr: every distinct score, collinear points kept."""
    run = running(by_score(df, score, label, keys), keys)
    return run.select(*keys, F.col("s").alias("threshold"), (F.col("fp") / F.nullif(F.col("all_n"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("all_p"), F.lit(0))).alias("tpr"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column, eps: float = 1e-10) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, observed: by exact quantile edges, empty bins left out."""
    from .quantiles import quantiles  # which needs the running sums above

    rows = stored(df.select(score, label), "scores")  # read once for the edges, once for the bins
    inner = F.slice("_e", 2, bins - 1)
    placed = rows.crossJoin(quantiles(rows, score, [i / bins for i in range(bins + 1)])).withColumn("bin", F.size(F.filter(inner, lambda x: x <= F.col(score))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def r_squared(y: Column, fitted: Column) -> Column:
    return 1 - F.sum(F.pow(y - fitted, 2)) / (F.var_pop(y) * F.count(y))


def ks_statistic(df: DataFrame, value: str, sample: str) -> DataFrame:
    """ks, n1, n0: the largest distance of the two empirical distributions; sample is 1 or 0."""
    run = running(by_score(df, value, sample, kind=None), descending=False)
    return run.agg(F.max(F.abs(F.col("tp") / F.col("all_p") - F.col("fp") / F.col("all_n"))).alias("ks"), F.max("all_p").alias("n1"), F.max("all_n").alias("n0"))


def ks_p_value(ks: float, n1: int, n0: int) -> float:
    """The asymptotic series."""
    import math

    root = math.sqrt(n1 * n0 / (n1 + n0))
    x = (root + 0.12 + 0.11 / root) * ks
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0 else 1.0


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean, by counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("s")).agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("bigint").alias("n"))
    ranks = running(counts, descending=False).select(F.col("s").alias("_v"), (F.col("tp") - (F.col("p") - 1) / 2.0).alias(out))
    return df.join(ranks, df[value] == ranks["_v"]).drop("_v")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's; null for fewer than two rows or without variation."""
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of average ranks, over rows with both values; null for fewer than two."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(correlation("rx", "ry").alias("spearman"), correlation("x", "y").alias("pearson"))
