"""Data-quality rules, metrics and audits. The plain rules of a table are one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import md5
from json import JSONEncoder

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F


@dataclass(frozen=True)
class Rule:
    """failures: an aggregate that counts what is wrong, or with ``over`` what is wrong among the groups of these columns,
    each with its number of rows ``n``. The rule passes at 0 (or as ``passes`` says of the count)."""

    name: str
    failures: Column
    severity: str = "error"
    passes: Callable[[Column], Column] = lambda n: n == 0
    over: tuple[str, ...] = ()


def no_missing(df: DataFrame, columns: Sequence[str]) -> Rule:
    """Columns that the table doesn't have are skipped."""
    have = [c for c in columns if c in df.columns]
    total: Column = F.lit(0)
    for c in have:
        total = total + F.count_if(F.col(c).isNull())
    return Rule("no_missing_values", total if have else F.count_if(F.lit(False)))


def unique(column: str) -> Rule:
    """A null counts as a failure, as it is no distinct value."""
    return Rule("unique_values", F.sum(F.when(F.col(column).isNull(), F.col("n")).otherwise(F.col("n") - 1)), over=(column,))


def value_range(column: str, low: float | None = None, high: float | None = None, severity: str = "warning") -> Rule:
    x, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return Rule("value_range", F.count_if(bad), severity)


def categorical(column: str, allowed: Sequence) -> Rule:
    return Rule("categorical_values", F.count_if(~F.col(column).isin(*allowed)), over=(column,))


def date_range(column: str, low: str | None = None, high: str | None = None, severity: str = "warning") -> Rule:
    x, bad = F.try_to_timestamp(F.col(column).cast("string")), F.lit(False)
    if low:
        bad = bad | (x < F.lit(low).cast("timestamp"))
    if high:
        bad = bad | (x > F.lit(high).cast("timestamp"))
    return Rule("date_range", F.count_if(bad), severity)


def row_count(low: int | None = None, high: int | None = None) -> Rule:
    top = F.lit(True) if high is None else F.lit(high)
    return Rule("row_count", F.count(F.lit(1)), passes=lambda n: (n >= (low or 0)) & (top if high is None else n <= top))


def no_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> Rule:
    """Rows beyond the first of each; nulls are equal; columns that are missing are left out."""
    columns = [c for c in subset if c in df.columns] if subset else df.columns
    return Rule("no_duplicate_rows", F.sum(F.col("n") - 1), over=tuple(columns))


def non_negative(column: str) -> Rule:
    return Rule("positive_values", F.count_if(F.col(column) < 0))


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, severity, n_failures, passed: one row for each rule.

    All plain rules are one pass; those over groups share one aggregation for each set of columns. A rule that can't be
    applied to the table has failed, with null failures. Nothing runs before the result is read.
    """
    sets: dict[tuple[str, ...], list[int]] = {}
    broken = set()
    for i, r in enumerate(rules):
        try:
            _counted(df, r.over).agg(r.failures.cast("bigint"))  # is looked at by the analyser only
        except AnalysisException:  # no such column, or no such operation on its type
            broken.add(i)
        else:
            sets.setdefault(tuple(sorted(r.over)), []).append(i)
    out = df.sparkSession.range(1).select()
    for over, own in sets.items():
        one = _counted(df, over).agg(*[F.coalesce(rules[i].failures.cast("bigint"), F.lit(0)).alias(f"r{i}") for i in own])
        out = out.crossJoin(one)  # one row each

    def row(i: int, r: Rule) -> Column:
        n = F.lit(None).cast("bigint") if i in broken else F.col(f"r{i}")
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), n.alias("n_failures"), (F.lit(False) if i in broken else F.coalesce(r.passes(n), F.lit(False))).alias("passed"))

    return out.select(F.explode(F.array(*[row(i, r) for i, r in enumerate(rules)])).alias("x")).select("x.*")


def _counted(df: DataFrame, over: Sequence[str]) -> DataFrame:
    return df.groupBy(*over).agg(F.count(F.lit(1)).alias("n")) if over else df


def panel_rules(df: DataFrame, unit: str, period: str) -> list[Rule]:
    """What a panel must have: both keys, no unit twice in a period, ten rows."""
    return [no_missing(df, [unit, period]), no_duplicates(df, [unit, period]), row_count(low=10)]


def input_rules(df: DataFrame, key: str = "id") -> list[Rule]:
    """What an input must have: a row, and a key in each."""
    return [row_count(low=1), no_missing(df, [key])]


def as_dict(results: list[Row]) -> dict:
    """The results of ``validate`` as plain values, with the numbers of errors and warnings."""
    bad = [r for r in results if not r.passed]
    return {"passed": not any(r.severity == "error" for r in bad), "n_errors": sum(r.severity == "error" for r in bad), "n_warnings": sum(r.severity == "warning" for r in bad), "results": [r.asDict() for r in results]}


def validate_or_raise(df: DataFrame, rules: Sequence[Rule]) -> None:
    bad = [r for r in validate(df, rules).collect() if not r.passed and r.severity == "error"]
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n_failures}" for r in bad))


def report(results: list[Row]) -> str:
    return "\n".join(f"[{'PASS' if r.passed else r.severity.upper()}] {r.rule}: {r.n_failures}" for r in results)


#: Spark types of the type names in expected schemas.
KINDS = {"int": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double"), "str": ("string",), "bool": ("boolean",), "datetime": ("timestamp", "timestamp_ntz", "date")}


def schema_report(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """column, status, severity: a missing column is an error, another type a warning. No job runs."""
    kinds = dict(df.dtypes)
    rows = [(c, "missing" if c not in kinds else "ok" if kinds[c] in KINDS.get(t, (t,)) else "type", "error" if c not in kinds else "info" if kinds[c] in KINDS.get(t, (t,)) else "warning") for c, t in expected.items()]
    return df.sparkSession.createDataFrame(rows, "column string, status string, severity string")


def table_metrics(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, missing_cells, missing_pct, duplicate_rows, duplicate_pct."""
    width = len(df.columns)
    share = lambda x, y: F.coalesce(F.try_divide(100.0 * x, y), F.lit(0.0))
    # rows that are equal meet as one row with a count, which holds all that is asked
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_rows"))
    per = F.lit(0)
    for c in df.columns:
        per = per + F.col(c).isNull().cast("int")
    n, cells, dup = F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum(per * F.col("_rows")), F.lit(0)), F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0))
    return rows.agg(n.alias("n_rows"), F.lit(width).cast("bigint").alias("n_columns"), cells.cast("bigint").alias("missing_cells"), share(cells, n * width).alias("missing_pct"), dup.cast("bigint").alias("duplicate_rows"), share(dup, n).alias("duplicate_pct"))


def threshold_checks(metrics: DataFrame, missing: float = 5.0, rows: int = 10, duplicates: float = 1.0) -> DataFrame:
    checks = [("missing_pct", F.col("missing_pct"), F.col("missing_pct") > missing), ("n_rows", F.col("n_rows").cast("double"), F.col("n_rows") < rows), ("duplicate_pct", F.col("duplicate_pct"), F.col("duplicate_pct") > duplicates)]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"), w.alias("warning")) for k, v, w in checks])).alias("c")).select("c.*")


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_null, for columns with any."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])).alias("x")).select("x.*").where("n_null > 0")


def attrition(stages: DataFrame) -> DataFrame:
    """From (place, stage, n_rows, present): difference and percent to the last stage that exists and has rows."""
    there = stages.where(F.col("present") & (F.col("n_rows") > 0))
    before = F.lag("n_rows").over(W.orderBy("place"))  # a row a stage
    return there.select("stage", "n_rows", (F.col("n_rows") - before).alias("diff"), F.round(100.0 * (F.col("n_rows") - before) / before, 6).alias("diff_pct"))


def compare_columns(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    x, y = set(a.columns), set(b.columns)
    return {"added": sorted(y - x), "removed": sorted(x - y), "common": sorted(x & y)}


def column_coverage(df: DataFrame, required: Sequence[str]) -> tuple[list[str], list[str], float]:
    present = [c for c in required if c in df.columns]
    return present, [c for c in required if c not in df.columns], len(present) / len(required) if required else 1.0


def config_hash(config: dict) -> str:
    """MD5 of the configuration as JSON with sorted keys; what JSON does not know counts by its text."""
    text = JSONEncoder(sort_keys=True, default=str).encode(config)
    return md5(text.encode()).hexdigest()


def table_hash(df: DataFrame) -> DataFrame:
    """n_rows and an order-free hash over all rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash"))


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, status: left_only, right_only, changed or same; by hash if both have one, else by size and time."""
    a = left.select("path", F.lit(True).alias("l"), F.struct("hash", "size", "mtime").alias("x"))
    b = right.select(F.col("path").alias("p2"), F.lit(True).alias("r"), F.struct("hash", "size", "mtime").alias("y"))
    hashed = F.col("x.hash").isNotNull() & F.col("y.hash").isNotNull()
    same = F.when(hashed, F.col("x.hash") == F.col("y.hash")).otherwise(F.col("x.size").eqNullSafe(F.col("y.size")) & F.col("x.mtime").eqNullSafe(F.col("y.mtime")))
    return a.join(b, F.col("path") == F.col("p2"), "full").select(F.coalesce("path", "p2").alias("path"), F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(same, "same").otherwise("changed").alias("status"))


def metric_rows(metrics: DataFrame, stage: str, timestamp: str) -> DataFrame:
    """metric, value (as text), stage, timestamp: a table of one row as the rows of a quality report."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("x")).select("x.metric", "x.value", F.lit(stage).alias("stage"), F.lit(timestamp).alias("timestamp"))


def save_report(metrics: DataFrame, folder: str, stage: str, timestamp: str) -> str:
    """Writes the quality report of a stage as CSV with a header and returns its path."""
    path = f"{folder}/{stage}_quality_{timestamp}.csv"
    metric_rows(metrics, stage, timestamp).coalesce(1).write.option("header", True).csv(path)  # a row for each metric
    return path


def report_warnings(latest: DataFrame, missing: float = 5.0, rows: int = 10, duplicates: float = 1.0) -> DataFrame:
    """The rows of ``latest_metrics`` with warning: beyond the thresholds of ``threshold_checks``."""
    limit = F.when(F.col("metric") == "missing_pct", F.col("number") > missing).when(F.col("metric") == "duplicate_pct", F.col("number") > duplicates).when(F.col("metric") == "n_rows", F.col("number") < rows)
    return latest.withColumn("warning", F.coalesce(limit, F.lit(False)))


def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (added or removed), n and the common columns: rows that one table has and the other lacks, as often as it lacks them."""
    columns = [c for c in a.columns if c in b.columns]
    both = a.select(*columns, F.lit(-1).alias("_s")).unionByName(b.select(*columns, F.lit(1).alias("_s")))
    left = both.groupBy(*columns).agg(F.sum("_s").alias("n")).where("n <> 0")
    return left.select(F.when(F.col("n") > 0, "added").otherwise("removed").alias("side"), F.abs("n").alias("n"), *columns)


def latest_metrics(history: DataFrame) -> DataFrame:
    """Of (metric, value, stage, timestamp) the latest row of each stage and metric, with the value as a number."""
    w = W.partitionBy("stage", "metric").orderBy(F.col("timestamp").desc(), F.col("value"))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("stage", "metric", "timestamp", F.col("value").try_cast("double").alias("number"))
