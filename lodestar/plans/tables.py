"""Queries over cleaning, quality, linkage, panels, estimation, text and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S, texts as T
from ..operators import cleaning as K, estimation as E, linkage as L, metrics as M, panel as P, quality as Q, resampling as R, spatial as G, summaries
from ..operators.quantiles import quantiles
from ..streaming import qa
from .registry import query, r6, read

# ---- cleaning and projections


@query("""WITH x AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
SELECT p_partkey, p_brand, round(p_retailprice, 6) AS p_retailprice FROM x WHERE n = 1""")
def largest_per_group(spark, d):
    return K.largest_per_group(read(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_partkey", "p_brand", r6("p_retailprice", "p_retailprice"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates(spark, d):
    return K.drop_duplicate_rows(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS claim_id FROM orders")
def surrogate_key(spark, d):
    return K.surrogate_key(read(spark, d, "orders"), "claim_id", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "claim_id")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def dense_codes(spark, d):
    return K.dense_codes(read(spark, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("""SELECT c_custkey, CASE WHEN len(c_custkey::VARCHAR) >= 5 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS zip,
upper(c_mktsegment) AS zone, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1.0 END AS total, (c_custkey % 100000 // 10) % 10 // 2 AS zip_group FROM customer""")
def normalise_keys(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", S.padded_code(F.col("c_custkey"), 5).alias("zip"), F.upper("c_mktsegment").alias("zone"), S.first_positive([F.col("c_acctbal")], [F.lit(1.0)]).alias("total"), S.zip_digit_group(F.col("c_custkey") % 100000).cast("bigint").alias("zip_group"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_orderkey")
def in_force(spark, d):
    li = read(spark, d, "lineitem")
    ok = K.in_force(F.col("l_shipdate"), F.col("l_shipdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))
    return li.where(ok).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max,
count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""")
def group_statistics(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "std"), r6(F.median("value"), "median"), r6(F.min("value"), "min"), r6(F.max("value"), "max"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_values(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "o_orderpriority").limit(3)


@query("SELECT round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, round(quantile_cont(c_acctbal, 0.99), 6) AS p99 FROM customer")
def exact_quantiles(spark, d):
    edges = quantiles(read(spark, d, "customer"), "c_acctbal", (0.5, 0.95, 0.99))
    return edges.select(*[r6(F.col("_e")[i], n) for i, n in enumerate(("p50", "p95", "p99"))])


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def histogram(spark, d):
    o = read(spark, d, "orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return o.crossJoin(ends).select(F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)), F.lit(49)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(day(ts) AS INTEGER) AS period, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS control, round(avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS treated FROM events GROUP BY 1""")
def pivot_means(spark, d):
    e = read(spark, d, "events").select(F.dayofmonth("ts").alias("period"), (F.col("user_id") % 2).cast("string").alias("t"), "value")
    return e.groupBy("period").pivot("t", ["0", "1"]).agg(F.avg("value")).select("period", r6("0", "control"), r6("1", "treated"))


@query("""SELECT column_name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max, count(*) - count(v) AS missing
FROM (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1""")
def descriptive_statistics(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    lines = read(spark, d, "lineitem")
    out = summaries.describe(lines, cols).crossJoin(lines.agg(F.count(F.lit(1)).alias("rows")))
    return out.select("column_name", "n", *[r6(c, c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")], (F.col("rows") - F.col("n")).alias("missing"))


@query("SELECT n_name, coalesce(n, 0) AS n_orders, round(coalesce(total, 0), 2) AS total FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON n_nationkey = c_nationkey")
def lookup_and_sums(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    sums = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return n.join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"), (F.round(F.coalesce("total", F.lit(0.0)), 2) + 0.0).alias("total"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1)
SELECT count(*) AS n, round(avg(c / s), 6) AS uptake, round(covar_pop(c, s) / nullif(stddev_pop(c) * stddev_pop(s), 0), 6) + 0.0 AS corr FROM a JOIN b USING (k)""")
def ratio_and_correlation(spark, d):
    a = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    b = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("s"))
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.try_divide("c", "s")), "uptake"), r6(M.correlation("c", "s"), "corr"))


# ---- quality


@query("""SELECT * FROM (VALUES ('no_missing_values', 'error'), ('unique_values', 'error'), ('value_range', 'warning'), ('categorical_values', 'error'), ('date_range', 'warning'), ('row_count', 'error'), ('no_duplicate_rows', 'error'), ('positive_values', 'error')) v(rule, severity)
JOIN (SELECT unnest(['no_missing_values', 'unique_values', 'value_range', 'categorical_values', 'date_range', 'row_count', 'no_duplicate_rows', 'positive_values']) AS rule,
unnest([count(*) FILTER (WHERE l_orderkey IS NULL), count(*) - count(DISTINCT l_orderkey), count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49), count(DISTINCT CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_returnflag END),
count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1993-01-01'), count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), count(*) FILTER (WHERE l_discount < 0)]) AS n_failures FROM lineitem) USING (rule)
JOIN (SELECT 'row_count' AS rule, true AS rc) r ON true
QUALIFY true""".replace("JOIN (SELECT 'row_count' AS rule, true AS rc) r ON true\nQUALIFY true", "").replace("SELECT * FROM (VALUES", "SELECT rule, severity, n_failures, CASE WHEN rule = 'row_count' THEN n_failures >= 10 ELSE n_failures = 0 END AS passed FROM (VALUES"))
def quality_rules(spark, d):
    li = read(spark, d, "lineitem")
    return Q.validate(li, [Q.no_missing(li, ["l_orderkey", "not_there"]), Q.unique("l_orderkey"), Q.value_range("l_quantity", 2, 49), Q.categorical("l_returnflag", ["A", "N"]), Q.date_range("l_shipdate", "1993-01-01"), Q.row_count(10), Q.no_duplicates(li, ["l_orderkey", "l_linenumber", "not_there"]), Q.non_negative("l_discount")])


@query("""WITH m AS (SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dup FROM lineitem)
SELECT n AS n_rows, CAST(2 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS missing_cells, 0.0::DOUBLE AS missing_pct, dup AS duplicate_rows, round(100.0::DOUBLE * dup / n, 6) AS duplicate_pct FROM m""")
def table_metrics(spark, d):
    out = Q.table_metrics(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))
    return out.select("n_rows", "n_columns", "missing_cells", r6("missing_pct", "missing_pct"), "duplicate_rows", r6("duplicate_pct", "duplicate_pct"))


@query("""WITH m AS (SELECT count(*) AS n, 100.0::DOUBLE * (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*) AS dup FROM lineitem)
SELECT unnest(['missing_pct', 'n_rows', 'duplicate_pct']) AS metric, round(unnest([0.0::DOUBLE, n::DOUBLE, dup]), 6) AS value, unnest([false, n < 10, dup > 1.0]) AS warning FROM m""")
def threshold_checks(spark, d):
    out = Q.threshold_checks(Q.table_metrics(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")))
    return out.select("metric", r6("value", "value"), "warning")


@query("""WITH s AS (SELECT 1 AS place, 'events' AS stage, count(*) AS n FROM events UNION ALL SELECT 2, 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 3, 'gone', 0 UNION ALL SELECT 4, 'types', count(DISTINCT event_type) FROM events)
SELECT stage, n AS n_rows, n - lag(n) OVER (ORDER BY place) AS diff, round(100.0::DOUBLE * (n - lag(n) OVER (ORDER BY place)) / lag(n) OVER (ORDER BY place), 6) AS diff_pct FROM s WHERE n > 0""")
def attrition(spark, d):
    e = read(spark, d, "events")
    one = e.agg(F.count(F.lit(1)).alias("a"), F.countDistinct("user_id").alias("b"), F.countDistinct("event_type").alias("c"))
    rows = [(1, "events", F.col("a")), (2, "users", F.col("b")), (3, "gone", F.lit(0).cast("bigint")), (4, "types", F.col("c"))]
    stages = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), n.alias("n_rows"), F.lit(s != "gone").alias("present")) for i, s, n in rows])).alias("x")).select("x.*")
    return Q.attrition(stages)


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'left_only' WHEN a.path IS NULL THEN 'right_only' WHEN a.size = b.size THEN 'same' ELSE 'changed' END AS status
FROM (SELECT c_custkey::VARCHAR AS path, c_nationkey AS size FROM customer) a FULL JOIN (SELECT s_suppkey::VARCHAR AS path, s_nationkey AS size FROM supplier) b ON a.path = b.path""")
def manifest_diff(spark, d):
    nothing = F.lit(None).cast("string")
    a = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), nothing.alias("hash"), F.col("c_nationkey").alias("size"), nothing.alias("mtime"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), nothing.alias("hash"), F.col("s_nationkey").alias("size"), nothing.alias("mtime"))
    return Q.manifest_diff(a, b)


@query("""SELECT event_type AS stage, 'value' AS metric, max(ts) AS timestamp, round(arg_min(value, (-epoch_us(ts), CAST(value AS VARCHAR))), 6) AS number FROM events GROUP BY event_type""")
def latest_metrics(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("stage"), F.lit("value").alias("metric"), F.col("ts").alias("timestamp"), F.col("value").cast("string").alias("value"))
    return Q.latest_metrics(e).select("stage", "metric", "timestamp", r6("number", "number"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def category_difference(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).distinct().join(s, F.col("nation") == F.col("s_nationkey"), "left_anti")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def rolling_quality(spark, d):
    return qa.rolling_metrics(read(spark, d, "events")).select("window_start", "event_type", "n", "n_missing", r6("mean", "mean"))


# ---- linkage


@query("SELECT l_orderkey AS key, o_custkey, l_quantity AS qty, CASE WHEN o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def exact_linkage(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("qty"))
    return L.exact_match(li, read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), ["key"]).select("key", "o_custkey", "qty", "_merge")


@query("""WITH m AS (SELECT s_suppkey AS a, p_partkey AS b FROM supplier FULL JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON s_suppkey = p_partkey)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_matched, count(*) FILTER (WHERE b IS NULL) AS n_unmatched, round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(*)::DOUBLE, 6) AS match_rate FROM m""")
def linkage_statistics(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    b = read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("k"))
    return L.match_statistics(L.exact_match(a, b, ["k"], how="outer")).select("n_rows", "n_matched", "n_unmatched", r6("match_rate", "match_rate"))



def _fuzzy(spark: SparkSession, d: str, method: str, threshold: float) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return L.fuzzy_match(n, r, "n_name", "r_name", threshold, method).select("left_value", "right_value", r6("score", "score"))


_FUZZY = """WITH p AS (SELECT DISTINCT n_name AS a, r_name AS b, {s} AS score FROM nation, region), q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM p WHERE score >= {t})
SELECT a AS left_value, b AS right_value, round(score, 6) AS score FROM q WHERE n = 1"""


@query(_FUZZY.format(s="1 - levenshtein(lower(n_name), lower(r_name)) / greatest(length(n_name), length(r_name))::DOUBLE", t=0.2))
def fuzzy_levenshtein(spark, d):
    return _fuzzy(spark, d, "levenshtein", 0.2)


@query(_FUZZY.format(s="CASE WHEN contains(lower(r_name), lower(n_name)) THEN 1.0::DOUBLE ELSE 0.0 END", t=0.5))
def fuzzy_contains(spark, d):
    return _fuzzy(spark, d, "contains", 0.5)


@query()
def fuzzy_jaro_winkler(spark, d):
    """Without SQL: this rule counts common beginnings whatever the similarity, DuckDB's does not; tested by brute force."""
    return _fuzzy(spark, d, "jaro_winkler", 0.4)


# ---- panels and estimation


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Users by day: mean value, treated odd users from the 15th on."""
    e = read(spark, d, "events")
    t = ((F.col("unit") % 2 == 1) & (F.col("period") >= 15)).cast("int")
    return e.groupBy(F.col("user_id").alias("unit"), F.dayofmonth("ts").alias("period")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("x")).withColumn("t", t)


_PANEL = "pn AS (SELECT user_id AS unit, CAST(day(ts) AS INTEGER) AS period, avg(value) AS y, count(*) AS x, CAST(user_id % 2 = 1 AND day(ts) >= 15 AS INTEGER) AS t FROM events GROUP BY user_id, day(ts))"


@query(f"WITH {_PANEL}, a AS (SELECT count(DISTINCT unit) AS u, count(DISTINCT period) AS p, count(*) AS n, count(DISTINCT CASE WHEN t = 1 THEN unit END) AS tu, avg(t) AS ts FROM pn) SELECT u AS n_units, p AS n_periods, n AS n_obs, tu AS treated_units, round(ts, 6) AS treatment_share, n = u * p AS balanced, round(n / (u * p)::DOUBLE, 6) AS balance_rate, u - tu AS control_units FROM a")
def panel_diagnostics(spark, d):
    return P.diagnostics(panel(spark, d), "unit", "period", "t").select("n_units", "n_periods", "n_obs", "treated_units", r6("treatment_share", "treatment_share"), "balanced", r6("balance_rate", "balance_rate"), "control_units")


@query(f"WITH {_PANEL} SELECT unit, period, x FROM pn WHERE unit IN (SELECT unit FROM pn GROUP BY unit HAVING count(*) = (SELECT count(DISTINCT period) FROM pn))")
def balance_drop(spark, d):
    return P.balance(panel(spark, d), "unit", "period").select("unit", "period", "x")


_GRID = f"WITH {_PANEL}, g AS (SELECT unit, period FROM (SELECT DISTINCT unit FROM pn), (SELECT DISTINCT period FROM pn)), f AS (SELECT unit, period, x, y FROM g LEFT JOIN pn USING (unit, period))"


@query(_GRID + " SELECT unit, period, last_value(x IGNORE NULLS) OVER w AS x, round(last_value(y IGNORE NULLS) OVER w, 6) AS y FROM f WINDOW w AS (PARTITION BY unit ORDER BY period ROWS UNBOUNDED PRECEDING)")
def balance_ffill(spark, d):
    return P.balance(panel(spark, d), "unit", "period", "ffill").select("unit", "period", "x", r6("y", "y"))


@query(_GRID + " SELECT unit, period, coalesce(x, 0) AS x, round(coalesce(y, 0), 6) AS y FROM f")
def balance_zero(spark, d):
    return P.balance(panel(spark, d), "unit", "period", "zero").select("unit", "period", "x", r6("y", "y"))


@query(f"WITH {_PANEL}, e AS (SELECT *, period - min(CASE WHEN t = 1 THEN period END) OVER (PARTITION BY unit) AS event_time, max(t) OVER (PARTITION BY unit) AS ever_treated FROM pn) SELECT unit, period, event_time, ever_treated FROM e")
def event_time(spark, d):
    return P.treatment_indicators(P.event_time(panel(spark, d), "unit", "period", "t"), "unit", "period", "t").select("unit", "period", "event_time", "ever_treated")


@query(f"WITH {_PANEL}, e AS (SELECT y, period - min(CASE WHEN t = 1 THEN period END) OVER (PARTITION BY unit) AS event_time FROM pn), m AS (SELECT event_time, avg(y) AS mean, stddev_samp(y) AS std, count(y) AS n FROM e WHERE event_time BETWEEN -5 AND 5 GROUP BY 1) SELECT event_time, round(mean, 6) AS mean, n, round(std / sqrt(n), 6) AS se, round(mean - 1.96 * std / sqrt(n), 6) + 0.0 AS lo FROM m")
def event_study_means(spark, d):
    out = P.event_means(P.event_time(panel(spark, d), "unit", "period", "t"), "y", -5, 5)
    return out.select("event_time", r6("mean", "mean"), "n", r6("se", "se"), r6("lo", "lo"))


@query(f"WITH {_PANEL} SELECT unit, period, round(y - avg(y) OVER (PARTITION BY unit), 9) + 0.0 AS y_within FROM pn")
def within_transform(spark, d):
    return E.within(panel(spark, d), ["y"], ["unit"]).select("unit", "period", (F.round("y", 9) + 0.0).alias("y_within"))


@query(f"WITH {_PANEL}, w AS (SELECT unit, period, x - avg(x) OVER (PARTITION BY unit) AS a FROM pn), v AS (SELECT unit, period, a - avg(a) OVER (PARTITION BY period) AS b FROM w) SELECT unit, period, round(b, 9) + 0.0 AS x_within FROM v")
def two_way_within(spark, d):
    return E.within(panel(spark, d), ["x"], ["unit", "period"]).select("unit", "period", (F.round("x", 9) + 0.0).alias("x_within"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, count(*) AS n FROM lineitem GROUP BY 1")
def simple_ols(spark, d):
    out = E.simple_ols(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), r6("r_squared", "r_squared"), "n")


def _estimate(spark: SparkSession, e: E.Estimate) -> DataFrame:
    c = list(e.coefficients)
    rows = [(name, round(e.coefficients[name], 3), round(e.errors[name], 3), e.n_obs, round(e.r_squared, 6)) for name in c]
    return spark.createDataFrame(rows, "term string, coefficient double, error double, n bigint, r_squared double")


_OLS = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, sum(l_quantity * l_quantity) AS qq FROM lineitem),
u AS (SELECT sum(power(l_extendedprice - a - b * l_quantity, 2)) AS ssr FROM lineitem, s)
SELECT 'const' AS term, round(a, 3) AS coefficient, round(sqrt(ssr / (n - 2) * qq / (n * sxx)), 3) AS error, n, round(r2, 6) AS r_squared FROM s, u
UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(ssr / (n - 2) / sxx), 3), n, round(r2, 6) FROM s, u"""


@query(_OLS)
def ols_homoskedastic(spark, d):
    return _estimate(spark, E.ols(read(spark, d, "lineitem"), E.Specification("q", "l_extendedprice", ("l_quantity",))))


_CLUSTER = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, sum(l_quantity) AS q, sum(l_quantity * l_quantity) AS qq, count(DISTINCT l_suppkey) AS g FROM lineitem),
u AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e FROM lineitem, s),
c AS (SELECT {c} FROM u{g}),
m AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM c),
v AS (SELECT n, g, a, b, r2, n * sxx AS det, q, qq, {m} FROM s, m),
w AS (SELECT n, a, b, r2, g / (g - 1)::DOUBLE * (n - 1) / (n - 2) / det / det AS k, qq * qq * m00 - 2 * q * qq * m01 + q * q * m11 AS v0, q * q * m00 - 2 * n * q * m01 + n * n * m11 AS v1 FROM v)
SELECT 'const' AS term, round(a, 3) AS coefficient, round(sqrt(k * v0), 3) AS error, n, round(r2, 6) AS r_squared FROM w UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(k * v1), 3), n, round(r2, 6) FROM w"""


@query(_CLUSTER.format(c="sum(e) AS s0, sum(e * x) AS s1", g=" GROUP BY l_suppkey", m="m00, m01, m11"))
def ols_clustered(spark, d):
    return _estimate(spark, E.ols(read(spark, d, "lineitem"), E.Specification("q", "l_extendedprice", ("l_quantity",), cluster="l_suppkey"), "clustered"))


@query(_CLUSTER.format(c="e AS s0, e * x AS s1", g="", m="m00, m01, m11"))
def ols_compat_clustered(spark, d):
    return _estimate(spark, E.ols(read(spark, d, "lineitem"), E.Specification("q", "l_extendedprice", ("l_quantity",), cluster="l_suppkey"), "compat_clustered"))


@query(f"""WITH {_PANEL}, e AS (SELECT *, unit % 2 AS g FROM pn WHERE period <= 14), f AS (SELECT k, g, period >= k AS after, y FROM e, (SELECT unnest([6, 8, 10, 12]) AS k))
SELECT CAST(k AS INTEGER) AS placebo_period, round(avg(y) FILTER (WHERE g = 1 AND after) - avg(y) FILTER (WHERE g = 1 AND NOT after) - avg(y) FILTER (WHERE g = 0 AND after) + avg(y) FILTER (WHERE g = 0 AND NOT after), 5) + 0.0 AS effect, count(*) AS n FROM f GROUP BY k""")
def placebo_periods(spark, d):
    df = panel(spark, d).withColumn("g", (F.col("unit") % 2).cast("int"))
    return E.placebo_periods(df, "unit", "period", "y", "g", before=14).select("placebo_period", (F.round("effect", 5) + 0.0).alias("effect"), "n")


@query("WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem) SELECT count(*) FILTER (WHERE l_extendedprice BETWEEN a AND b) AS n_trimmed, round(avg(least(greatest(l_extendedprice, a), b)), 4) AS winsorised_mean FROM lineitem, e")
def trim_and_winsorise(spark, d):
    li = read(spark, d, "lineitem").select("l_extendedprice")
    n = E.trimmed(li, "l_extendedprice").agg(F.count(F.lit(1)).alias("n_trimmed"))
    return n.crossJoin(E.winsorised(li, "l_extendedprice").agg(F.round(F.avg("l_extendedprice"), 4).alias("winsorised_mean")))


@query("""WITH s AS (SELECT l_suppkey % 5 AS fold, count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy, sum(l_extendedprice * l_extendedprice) AS syy FROM lineitem GROUP BY 1),
f AS (SELECT l.l_suppkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem l),
m AS (SELECT k AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k)
SELECT fold, round(1 - sum(power(y - a - b * x, 2)) / (var_pop(y) * count(*)), 5) AS r2 FROM f JOIN m USING (fold) GROUP BY fold""")
def cross_validation(spark, d):
    li = read(spark, d, "lineitem").withColumn("fold", F.col("l_suppkey") % 5)
    return R.cross_validated_r2(li, "fold", "l_extendedprice", "l_quantity").select("fold", F.round("r2", 5).alias("r2"))


@query()
def group_folds(spark, d):
    """Without SQL: packing the largest group into the lightest fold is a loop; tested against brute force."""
    return R.group_folds(read(spark, d, "customer"), "c_nationkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("n_groups"))


@query("WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(min(n) / max(n)::DOUBLE, 6) AS ratio FROM g")
def group_balance(spark, d):
    return R.group_balance(read(spark, d, "customer"), "c_nationkey").select("min", "max", r6("mean", "mean"), r6("std", "std"), r6("ratio", "ratio"))


# ---- space: coordinates from the embeddings


def points(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 40).alias("lat"), (F.col("embedding")[1].cast("double") * 90).alias("lon"))


_POINTS = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 40 AS lat, embedding[2]::DOUBLE * 90 AS lon FROM embeddings)"
_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0)))"
_CITIES = [(1, 40.7128, -74.0060), (2, 34.0522, -118.2437), (3, 41.8781, -87.6298), (4, 37.7749, -122.4194)]
_CITY_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in _CITIES) + ") v(id, lat, lon))"


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CITIES, "id bigint, lat double, lon double")


@query(f"WITH {_POINTS}, {_CITY_SQL}, d AS (SELECT pt.id, c.id AS id2, {_HAVERSINE.format(a='pt', b='c')} AS d FROM pt, c) SELECT id, id2, round(d, 2) AS distance, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, id2) AS n FROM d) WHERE n <= 2")
def nearest_neighbours(spark, d):
    return G.nearest(points(spark, d), cities(spark), 2).select("id", "id2", F.round("distance", 2).alias("distance"), "rank")


@query(f"WITH {_POINTS}, d AS (SELECT a.id, b.id AS o FROM pt a JOIN pt b ON a.id <> b.id AND abs(a.lat - b.lat) < 1 WHERE {_HAVERSINE.format(a='a', b='b')} <= 100000) SELECT pt.id, count(o) AS n FROM pt LEFT JOIN d USING (id) GROUP BY pt.id")
def distance_band(spark, d):
    return G.within_distance(points(spark, d), 100_000.0).select("id", F.size("neighbours").cast("bigint").alias("n"))


@query(f"WITH {_POINTS}, {_CITY_SQL} SELECT pt.id, round(min({_HAVERSINE.format(a='pt', b='c')}), 2) AS distance FROM pt, c GROUP BY pt.id")
def distance_to_nearest(spark, d):
    return G.distance_pairs(points(spark, d), cities(spark)).groupBy("id").agg(F.round(F.min("distance"), 2).alias("distance"))


@query(f"WITH {_POINTS} SELECT id, least(greatest(CAST(trunc((lon + 180) / 6) AS INTEGER) + 1, 1), 60) AS zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(trunc((lon + 180) / 6) AS INTEGER) + 1, 1), 60) AS INTEGER) AS epsg, round(radians(lon) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM pt")
def projections(spark, d):
    x, y = S.mercator(F.col("lat"), F.col("lon"))
    return points(spark, d).select("id", S.utm_zone(F.col("lon")).alias("zone"), S.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"), (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query(f"WITH {_POINTS}, e AS (SELECT quantile_cont(lat, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM pt) SELECT id, CAST(least(greatest(len(list_filter(e, lambda v: v <= lat)) - 1, 0), 4) AS INTEGER) AS band FROM pt, e")
def latitude_bands(spark, d):
    return R.quantile_bands(points(spark, d), "lat", 5).select("id", "band")


@query(f"WITH {_POINTS}, m AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM pt) SELECT id, (CAST(floor((lon - c) / (e - c) * 3) AS BIGINT) * 3 + CAST(floor((lat - a) / (b - a) * 3) AS BIGINT)) % 7 AS block FROM pt, m")
def spatial_blocks(spark, d):
    return R.spatial_blocks(points(spark, d), "lon", "lat", 7).select("id", "block")


_RINGS = {1: [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)], 2: [(0.0, 0.0), (60.0, 5.0), (30.0, 40.0)]}
_EDGES = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({p}::BIGINT, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for p, r in _RINGS.items() for a, b in zip(r, r[1:] + r[:1], strict=True)) + ") v(pid, x1, y1, x2, y2))"


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, [r]) for p, r in _RINGS.items()], "pid bigint, rings array<array<struct<x: double, y: double>>>")


@query(f"WITH {_POINTS}, {_EDGES} SELECT id, pid FROM pt, e GROUP BY id, pid, lat, lon HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1")
def points_in_polygons(spark, d):
    return G.points_in_polygons(points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), polygons(spark))


@query(f"""WITH {_POINTS}, {_EDGES}, i AS (SELECT id FROM pt, e GROUP BY id, pid, lat, lon HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1),
t AS (SELECT id, lat, lon, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) AS t FROM pt, e)
SELECT id, round(CASE WHEN id IN (SELECT id FROM i) THEN 0.0 ELSE min(sqrt(power(lon - x1 - t * dx, 2) + power(lat - y1 - t * dy, 2))) END, 6) AS distance FROM t GROUP BY id""")
def distance_to_polygons(spark, d):
    out = G.distance_to_polygons(points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), polygons(spark))
    return out.select("id", r6("distance", "distance"))


@query(f"""WITH {_POINTS}, c AS (SELECT id, lon AS x, lat AS y, floor(lat / (10 * 2 / sqrt(3.0) * 0.75)) AS r FROM pt),
h AS (SELECT id, x, y, unnest([r, r + 1]) AS row FROM c),
g AS (SELECT id, row, round((x - (row - 2 * floor(row / 2)) * 5) / 10) AS col, power(x - (row - 2 * floor(row / 2)) * 5 - round((x - (row - 2 * floor(row / 2)) * 5) / 10) * 10, 2) + power(y - row * (10 * 2 / sqrt(3.0) * 0.75), 2) AS d FROM h),
k AS (SELECT id, row, col, row_number() OVER (PARTITION BY id ORDER BY d, row) AS n FROM g)
SELECT CAST(row AS BIGINT) AS hex_row, CAST(col AS BIGINT) AS hex_col, count(*) AS n FROM k WHERE n = 1 GROUP BY 1, 2""")
def hex_bins(spark, d):
    row, col = S.hex_row_column(F.col("lon"), F.col("lat"), 10.0)
    return points(spark, d).select(row.alias("hex_row"), col.alias("hex_col")).groupBy("hex_row", "hex_col").agg(F.count(F.lit(1)).alias("n"))


# ---- text


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^---.*?---', '', 's'), '```.*?```', '', 'gs'), '`[^`]+`', '', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '!\[.*?\]\(.*?\)', '', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents""")
def markdown_word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.markdown_words(F.col("text")).alias("n_words"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '@([\w-]+)', 1))) AS BIGINT) AS n_keys, text SIMILAR TO '(?is).*#+\s*Methods.*' AS has_methods,
CASE WHEN regexp_matches(lower(text), 'double[-\s](?:blind|anonym)') THEN 'double-blind' WHEN regexp_matches(lower(text), 'single[-\s](?:blind|anonym)') THEN 'single-blind' WHEN contains(lower(text), 'open peer review') THEN 'open' END AS review FROM documents""".replace("text SIMILAR TO '(?is).*#+\\s*Methods.*'", "regexp_matches(text, '(?i)#+\\s*Methods')"))
def manuscript_checks(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.citations(t).alias("n_keys"), T.has_section(t, "Methods").alias("has_methods"), T.peer_review(t).alias("review"))


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(html, '</?(article|br|div|footer|h1|h2|h3|h4|h5|h6|header|li|nav|p|section|td|th|tr)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g')) AS n_chars FROM pages""")
def html_tags_out(spark, d):
    x = F.regexp_replace(F.regexp_replace("html", "(?i)</?(" + "|".join(sorted(T.BLOCK_TAGS)) + r")\b[^>]*>", "\n"), "<[^>]*>", "")
    return read(spark, d, "pages").select("page_id", F.length(x).cast("bigint").alias("n_chars"))


@query()
def html_plain_text(spark, d):
    """Without SQL: a parser decides where text is; tested against literals."""
    return read(spark, d, "pages").select("page_id", T.plain_whitespace(T.html_to_text(F.col("html"))).alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_replace(trim(regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9]+', '_', 'g'), '_'), '^$', 'x') = 'x' THEN 'journal' ELSE lower(trim(regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9]+', '_', 'g'), '_')) END AS slug FROM documents")
def title_slugs(spark, d):
    return read(spark, d, "documents").select("doc_id", T.slug(F.substring("text", 1, 40)).alias("slug"))


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'journal' ELSE lower(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '_', 'g'), '_')) END AS slug FROM documents")
def text_slugs(spark, d):
    """The whole text, where title_slugs takes its first 40 characters for a title."""
    return read(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END || printf('%.1f', floor(c_acctbal)) AS diff, printf('%.1f', floor(c_acctbal)) || '%' AS pct FROM customer WHERE abs(c_acctbal) > 2")
def formatted_numbers(spark, d):
    v = F.floor("c_acctbal").cast("double")
    return read(spark, d, "customer").where(F.abs("c_acctbal") > 2).select("c_custkey", F.concat(F.when(F.col("c_acctbal") > 0, "+").otherwise(""), S.fixed(v, 1)).alias("diff"), S.format_percent(v).alias("pct"))


@query("SELECT user_id, ts, value, round(avg(value) OVER w, 6) AS moving, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def moving_average(spark, d):
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "ts", "value", r6(F.avg("value").over(own.rowsBetween(-2, 0)), "moving"), F.row_number().over(own).cast("bigint").alias("nth"))





# ---- fitted groups and models, without SQL: fitting is iterative; the tests hold sizes and scores


@query()
def kmeans_groups(spark, d):
    from ..operators.learning import kmeans_groups as groups

    return groups(points(spark, d), "lon", "lat", 5).select("id", "group")


@query()
def balanced_groups(spark, d):
    from ..operators.learning import balanced_groups as groups

    return groups(points(spark, d), "id", "lon", "lat", 7).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query()
def ridge_cross_validation(spark, d):
    from ..operators.learning import cross_validate

    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("fold"), "l_quantity", "l_extendedprice", "l_discount")
    return cross_validate(li, "fold", "ridge", ["l_quantity", "l_discount"], "l_extendedprice").select("fold", F.round("r2", 3).alias("r2"))
