"""Least squares with fixed effects: sums of products in Spark, k x k algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import stored
from .quantiles import quantiles


@dataclass(frozen=True)
class Specification:
    name: str
    outcome: str
    regressors: tuple[str, ...]
    effects: tuple[str, ...] = ()
    cluster: str | None = None


@dataclass(frozen=True)
class Estimate:
    """Of the first regressor; all coefficients and errors by name."""

    n_obs: int
    r_squared: float
    coefficients: dict[str, float]
    errors: dict[str, float]
    t: float
    p: float
    ci: tuple[float, float]
    stars: str


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def t_cdf(t: float, df: float, compat: bool = False) -> float:
    """The normal above 100 degrees of freedom. Below, the exact integral; ``compat`` has the approximation by
    half of 1 - (1 + x^2 / df)^(-df / 2) on the side of t, with x = t / sqrt(df)."""
    if df > 100:
        return normal_cdf(t)
    if compat:
        x = t / math.sqrt(df)
        return 0.5 + math.copysign(0.5, t) * (1 - (1 + x * x / df) ** (-df / 2)) if t else 0.5
    grid = np.linspace(0.0, abs(t), 4001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    half = float(np.trapezoid(density, grid))
    return 0.5 + math.copysign(min(half, 0.5), t)


def t_quantile(p: float, df: float, compat: bool = False) -> float:
    """The inverse of ``t_cdf``; ``compat``: above 100 degrees of freedom a closed approximation of the inverse error
    function, which lacks the factor of the root of 2 to be a quantile; below it a correction of 1.96, whatever p."""
    if compat and df <= 100:
        return 1.96 * (1 + 0.5 / df)
    if compat:
        a, x = 8 * (math.pi - 3) / (3 * math.pi * (4 - math.pi)), 2 * p - 1
        inner = 2 / (math.pi * a) + math.log(1 - x * x) / 2
        return math.copysign(math.sqrt(math.sqrt(inner * inner - math.log(1 - x * x) / a) - inner), x)
    lo, hi = -200.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def within(df: DataFrame, columns: Sequence[str], effects: Sequence[str], passes: int = 1) -> DataFrame:
    """Takes group means off, one effect after the other. One pass is exact for one effect or a balanced panel; more
    passes approach the two-way result."""
    out = df
    for _ in range(passes):
        for e in effects:
            w = W.partitionBy(e)
            out = out.withColumns({c: F.col(c).cast("double") - F.avg(c).over(w) for c in columns})
    return out


def gram(df: DataFrame, columns: Sequence[str], weight: Column | None = None) -> np.ndarray:
    """Sums of products of the columns and a constant, in that order after the constant, by one aggregation."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    w = weight if weight is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = df.agg(*[F.sum(w * terms[i] * terms[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def specifications(outcome: str, treatment: str, controls: Sequence[str], unit: str, period: str) -> dict[str, Specification]:
    """The named specifications of a panel: with both effects, without, with controls, with the unit's alone."""
    return {
        "baseline": Specification("baseline", outcome, (treatment,), (unit, period), unit),
        "no_fe": Specification("no_fe", outcome, (treatment,), (), unit),
        "with_controls": Specification("with_controls", outcome, (treatment, *controls), (unit, period), unit),
        "unit_fe_only": Specification("unit_fe_only", outcome, (treatment,), (unit,), unit),
    }


def ols(df: DataFrame, spec: Specification, errors: str = "homoskedastic", passes: int = 1, compat: bool = False) -> Estimate:
    """errors: homoskedastic; clustered (scores added by cluster); compat_clustered (no cross terms within clusters,
    with the factor for clusters). ``compat``: t values by the approximations of ``t_cdf`` and ``t_quantile``.

    The sample is written once and read by one aggregation of means and products about them, so that large means cost no
    digits, and for clusters by a second one of their scores."""
    names = [*spec.regressors]
    used = list(dict.fromkeys([spec.outcome, *names, *spec.effects, *([spec.cluster] if spec.cluster else [])]))
    data = df.select(*used).na.drop()
    if spec.effects:
        data = within(data, [spec.outcome, *names], spec.effects, passes)
    every = [*names, spec.outcome]
    data = stored(data.select(*dict.fromkeys([*every, *([spec.cluster] if spec.cluster else [])])), "sample")  # what is before is run once
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    clusters = [F.count_distinct(spec.cluster).alias("clusters")] if spec.cluster else []
    row = data.agg(F.count(F.lit(1)).alias("n"), *clusters, *[F.avg(c).alias(f"m{i}") for i, c in enumerate(every)], *[F.covar_pop(F.col(every[i]).cast("double"), F.col(every[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(len(every))])
    k, n = len(names) + 1, int(row["n"])
    g = np.zeros((k + 1, k + 1))
    g[0, 0] = n
    for i, j in pairs:
        g[i + 1, j + 1] = g[j + 1, i + 1] = n * (row[f"c{i}_{j}"] or 0.0)
    data = data.withColumns({c: F.col(c).cast("double") - float(v) for c, v in zip(every, shift, strict=True)})
    if n < k + 1:
        raise ValueError("Insufficient observations")
    xx, xy, yy = g[:k, :k], g[:k, k], g[k, k]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    ssr = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    sst = float(yy - g[0, k] ** 2 / n)
    # back: the constant is that of the columns as they were
    back = np.eye(k)
    back[0, 1:] = -shift[:-1]
    if errors == "homoskedastic" or not spec.cluster:
        cov = inverse * ssr / (n - k)
    else:
        fitted: Column = F.lit(float(beta[0]))
        for b, c in zip(beta[1:], names, strict=True):
            fitted = fitted + float(b) * F.col(c)
        u = F.col(spec.outcome) - fitted
        groups = row["clusters"]
        if errors == "compat_clustered":
            meat = gram(data, names, u * u)
        else:
            scores = data.groupBy(spec.cluster).agg(F.sum(u).alias("s0"), *[F.sum(u * F.col(c)).alias(f"s{i + 1}") for i, c in enumerate(names)])
            sums = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
            meat = np.array([[sums[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float)
        factor = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 else 1.0
        cov = inverse @ meat @ inverse * factor
    cov = back @ cov @ back.T
    beta = back @ beta
    beta[0] += shift[-1]
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    t = float(beta[1] / se[1]) if se[1] > 0 else float("nan")
    p = 2 * (1 - t_cdf(abs(t), n - k, compat)) if se[1] > 0 else float("nan")
    reach = t_quantile(0.975, n - k, compat) * se[1]
    labels = ["const", *names]
    return Estimate(n, 1 - ssr / sst if sst > 0 else 0.0, dict(zip(labels, map(float, beta), strict=True)), dict(zip(labels, map(float, se), strict=True)), t, p, (float(beta[1] - reach), float(beta[1] + reach)), stars(p))


def simple_ols(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r_squared, n: one aggregation, by group if asked."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.count(F.lit(1)).alias("n"))


def two_column_ols(df: DataFrame, y: str, x: str) -> Estimate:
    """A line through rows with both values; with fewer than three of them there is nothing to estimate."""
    return ols(df, Specification("simple", y, (x,)))


#: Columns of robustness results.
RESULT = "name string, test_type string, effect double, error double, p double, n bigint"


def _results(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), RESULT)


def placebo_tests(df: DataFrame, unit: str, period: str, outcome: str, treated: str, n_placebos: int = 4, pre_period_end: int = 12) -> DataFrame:
    """name, test_type (placebo), effect, error, p, n: false starts before the treatment, each estimated with both effects.

    The last ``n_placebos`` even periods up to the end of the time before. Without a period column the result is empty.
    """
    if period not in df.columns:
        return _results(df, [])
    early, rows = df.where(F.col(period) <= pre_period_end), []
    for p in range(pre_period_end - 2 * (n_placebos - 1), pre_period_end + 1, 2):
        fake = early.withColumn("_fake", ((F.col(treated) == 1) & (F.col(period) >= p)).cast("double"))
        e = ols(fake, Specification("placebo", outcome, ("_fake",), (unit, period), unit), "clustered", 2)
        rows.append((f"placebo_period_{p}", "placebo", e.coefficients["_fake"], e.errors["_fake"], e.p, e.n_obs))
    return _results(df, rows)


def restriction_tests(df: DataFrame, spec: Specification, errors: str = "clustered") -> DataFrame:
    """name, test_type (sample or specification), effect, error, p, n: the estimate over restricted samples and other specifications."""
    first, rows = spec.regressors[0], []
    samples = {"full": df, "trimmed": trimmed(df, spec.outcome), "winsorised": winsorised(df, spec.outcome)}
    tries = [(name, "sample", part, spec) for name, part in samples.items()]
    tries += [("no_effects", "specification", df, Specification("no_effects", spec.outcome, spec.regressors, (), spec.cluster))]
    if len(spec.regressors) > 1:
        tries += [("no_controls", "specification", df, Specification("no_controls", spec.outcome, (first,), spec.effects, spec.cluster))]
    for name, kind, part, one in tries:
        e = ols(part, one, errors)
        rows.append((name, kind, e.coefficients[first], e.errors[first], e.p, e.n_obs))
    return _results(df, rows)


def placebo_periods(df: DataFrame, unit: str, period: str, outcome: str, treated: str, periods: Sequence[int] = (6, 8, 10, 12), before: int | None = None) -> DataFrame:
    """Difference in differences of false starts before the treatment: one row for each period, from one aggregation."""
    if period not in df.columns:
        return df.sparkSession.createDataFrame([], "placebo_period int, effect double, n bigint")
    use = [p for p in periods if before is None or p <= before]
    early = df if before is None else df.where(F.col(period) <= before)
    fake = early.withColumn("placebo_period", F.explode(F.array(*[F.lit(p) for p in use])))
    after = F.col(period) >= F.col("placebo_period")
    on = F.col(treated) == 1
    mean = lambda c: F.avg(F.when(c, F.col(outcome)))
    return fake.groupBy("placebo_period").agg((mean(on & after) - mean(on & ~after) - mean(~on & after) + mean(~on & ~after)).alias("effect"), F.count(F.lit(1)).alias("n"))


def trimmed(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows between two exact percentiles, bounds included."""
    return df.crossJoin(quantiles(df, column, (lo, hi))).where(F.col(column).between(F.col("_e")[0], F.col("_e")[1])).drop("_e")


def winsorised(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    return df.crossJoin(quantiles(df, column, (lo, hi))).withColumn(column, F.least(F.greatest(F.col(column), F.col("_e")[0]), F.col("_e")[1])).drop("_e")
