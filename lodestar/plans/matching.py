"""Queries over candidate matching, disaggregation, metrics and resampling.

Entities are customers: key nation, zone market segment, value account balance.
Records are orders with the customer hidden: the key and zone of the customer,
and the order's price as value. Some zones are altered so that the weaker forms
of a zone are tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import candidates as C, disaggregation as D, metrics as M, resampling as R
from ..operators.candidates import Columns, Filter, Matching
from .registry import query, r6, read

COLUMNS = Columns("o_orderkey", "c_custkey", "key", "zone")

#: The tables of all queries here, in SQL.
BASE = """
ent AS (SELECT c_custkey AS entity, CAST(c_nationkey AS VARCHAR) AS k, c_acctbal AS bal, 1950 + c_custkey % 70 AS built,
        CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AE' WHEN 2 THEN 'X' ELSE c_mktsegment END AS ez FROM customer),
rec AS (SELECT o_orderkey AS record, CAST(c_nationkey AS VARCHAR) AS key, o_custkey AS hidden, o_totalprice AS price,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 40.0 END AS bfe, 1950 + o_orderkey % 70 AS yr,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'A04' WHEN 2 THEN 'AE' WHEN 3 THEN 'B' WHEN 4 THEN 'X' WHEN 5 THEN 'A' ELSE c_mktsegment END AS zone
        FROM orders JOIN customer ON o_custkey = c_custkey)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    zone = F.when(F.col("c_custkey") % 4 == 0, "A").when(F.col("c_custkey") % 4 == 1, "AE").when(F.col("c_custkey") % 4 == 2, "X").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("bal"), zone.alias("zone"), (1950 + F.col("c_custkey") % 70).alias("built"))


def records(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    k = F.col("o_orderkey") % 7
    zone = F.when(k == 1, "A04").when(k == 2, "AE").when(k == 3, "B").when(k == 4, "X").when(k == 5, "A").when(k == 6, F.col("c_mktsegment"))
    bfe = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 40.0)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("key"), zone.alias("zone"), bfe.alias("bfe"), F.col("o_totalprice").alias("price"), (1950 + F.col("o_orderkey") % 70).alias("yr"), F.col("o_custkey").alias("hidden"))


CHAIN = Matching(columns=COLUMNS)
STRICT = Matching("strict", columns=COLUMNS)
CANONICAL = Matching("canonical", columns=COLUMNS)
KEY_ONLY = Matching(use_zone=False, columns=COLUMNS)
FILTERED = Matching(filters=(Filter("bfe", "bal", "within", 500.0), Filter("price", "bal", "percent", 90.0), Filter("yr", "built", "years", 5)), columns=COLUMNS)

_TRIES = """
try AS (
  SELECT record, key, 0 AS pr, zone AS z FROM rec WHERE zone IS NOT NULL
  UNION ALL SELECT record, key, 1, regexp_replace(zone, '[0-9]+$', '') FROM rec WHERE zone LIKE 'A%' AND regexp_replace(zone, '[0-9]+$', '') <> zone
  UNION ALL SELECT record, key, 2, 'X' FROM rec WHERE zone = 'B'),
hit AS (SELECT record, pr, entity FROM try JOIN ent ON key = k AND z = ez{alone}),
cand AS (SELECT record, entity FROM (SELECT *, min(pr) OVER (PARTITION BY record) AS best FROM hit) WHERE pr = best)"""
SQL_CHAIN = f"WITH {BASE}, {_TRIES.format(alone=' UNION ALL SELECT record, 0, entity FROM rec JOIN ent ON key = k WHERE zone IS NULL')}"
SQL_STRICT = f"WITH {BASE}, {_TRIES.format(alone='')}"
SQL_CANONICAL = f"""WITH {BASE}, cand AS (SELECT record, entity FROM
  (SELECT record, key, CASE WHEN zone LIKE 'A%' THEN regexp_replace(zone, '[0-9]+$', '') WHEN zone = 'B' THEN 'X' ELSE zone END AS z FROM rec) JOIN
  (SELECT entity, k, CASE WHEN ez LIKE 'A%' THEN regexp_replace(ez, '[0-9]+$', '') WHEN ez = 'B' THEN 'X' ELSE ez END AS e FROM ent) ON key = k AND z = e)"""
SQL_KEY = f"WITH {BASE}, cand AS (SELECT record, entity FROM rec JOIN ent ON key = k)"
SQL_FILTERED = SQL_CHAIN + """,
f0 AS (SELECT record, entity, bfe, price, yr, bal, built FROM cand JOIN rec USING (record) JOIN ent USING (entity)),
f1 AS (SELECT * FROM (SELECT *, bfe IS NULL OR abs(bal - bfe) <= 500.0 AS ok, bool_or(bfe IS NULL OR abs(bal - bfe) <= 500.0) OVER (PARTITION BY record) AS any_ FROM f0) WHERE ok OR NOT any_),
f2 AS (SELECT record, entity, yr, built FROM (SELECT *, bal > 0 AND bal >= price * (1 - 0.9::DOUBLE) AND bal <= price * (1 + 0.9::DOUBLE) AS ok2, bool_or(bal > 0 AND bal >= price * (1 - 0.9::DOUBLE) AND bal <= price * (1 + 0.9::DOUBLE)) OVER (PARTITION BY record) AS any_2 FROM f1) WHERE ok2 OR NOT any_2),
f3 AS (SELECT record, entity FROM (SELECT *, abs(built - yr) <= 5 AS ok3, bool_or(abs(built - yr) <= 5) OVER (PARTITION BY record) AS any_3 FROM f2) WHERE ok3 OR NOT any_3)"""
_STATS = " SELECT record, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates, coalesce(n, 0) > 0 AS matched FROM rec LEFT JOIN (SELECT record, count(*) AS n FROM {t} GROUP BY record) USING (record)"
_EXPECT = " SELECT entity, round(sum(1.0::DOUBLE / n) / (SELECT count(DISTINCT record) FROM {t}), 6) + 0.0 AS probability FROM {t} JOIN (SELECT record, count(*) AS n FROM {t} GROUP BY record) USING (record) GROUP BY entity"


def _stats(m: Matching):
    return lambda spark, d: C.record_stats(records(spark, d), entities(spark, d), m)


@query(SQL_CHAIN + _STATS.format(t="cand"))
def candidates_chain(spark, d):
    return _stats(CHAIN)(spark, d)


@query(SQL_STRICT + _STATS.format(t="cand"))
def candidates_strict(spark, d):
    return _stats(STRICT)(spark, d)


@query(SQL_CANONICAL + _STATS.format(t="cand"))
def candidates_canonical(spark, d):
    return _stats(CANONICAL)(spark, d)


@query(SQL_KEY + _STATS.format(t="cand"))
def candidates_key_only(spark, d):
    return _stats(KEY_ONLY)(spark, d)


@query(SQL_FILTERED + _STATS.format(t="f3"))
def candidates_filtered(spark, d):
    return _stats(FILTERED)(spark, d)


@query(SQL_CHAIN + _EXPECT.format(t="cand"))
def expected_probability(spark, d):
    return D.expected_probability(records(spark, d), entities(spark, d), CHAIN).select("entity", r6("probability", "probability"))


@query(SQL_FILTERED + _EXPECT.format(t="f3"))
def expected_probability_filtered(spark, d):
    return D.expected_probability(records(spark, d), entities(spark, d), FILTERED).select("entity", r6("probability", "probability"))


_RANKED = ", rk AS (SELECT record, entity, row_number() OVER (PARTITION BY record ORDER BY entity) - 1 AS at, count(*) OVER (PARTITION BY record) AS n FROM {t})"
_DRAWS = _RANKED + """,
dr AS (SELECT record, i AS draw, CAST('0x' || substr(md5('42|' || record || '|' || i), 1, 15) AS BIGINT) AS h FROM (SELECT DISTINCT record FROM rk), range(20) t(i)),
draws AS (SELECT dr.record, draw, entity FROM dr JOIN rk ON rk.record = dr.record AND rk.at = dr.h % rk.n)"""


@query(SQL_CANONICAL + _DRAWS.format(t="cand") + " SELECT entity, count(*) AS draw_count, round(count(*) / (SELECT count(*) FROM draws)::DOUBLE, 6) + 0.0 AS probability FROM draws GROUP BY entity")
def hashed_draws(spark, d):
    return D.drawn_counts(records(spark, d), entities(spark, d), 20, 42, CANONICAL).select("entity", "draw_count", r6("probability", "probability"))


@query(SQL_CANONICAL + _DRAWS.format(t="cand") + """ SELECT record, count(*) AS n_unique_sel, round((count(*) * sum(n * n) - sum(n) * sum(n)) / (count(*) * count(*))::DOUBLE, 3) + 0.0 AS var_sel, round(max(n) / sum(n)::DOUBLE, 4) AS top_share, round(avg(n), 2) AS mean_count, round(median(n), 2) AS median_count
  FROM (SELECT record, entity, count(*) AS n FROM draws GROUP BY ALL) GROUP BY record""")
def selection_diagnostics(spark, d):
    return D.record_diagnostics(records(spark, d), entities(spark, d), 20, 42, CANONICAL)


@query(SQL_CANONICAL + _DRAWS.format(t="cand") + " SELECT s AS size, entity, count(*) AS draw_count FROM draws, (SELECT unnest([5, 10, 20]) AS s) WHERE draw < s GROUP BY ALL")
def iteration_convergence(spark, d):
    return R.nested_draw_counts(D.hashed_draws(records(spark, d), entities(spark, d), 20, 42, CANONICAL), [5, 10, 20])


@query(SQL_CANONICAL + _RANKED.format(t="cand") + """,
dr AS (SELECT record, i, CAST('0x' || substr(md5('42|' || record || '|' || i), 1, 15) AS BIGINT) AS h FROM (SELECT DISTINCT record FROM rk), range(30) t(i) WHERE i < 10 * (1 + record % 3))
SELECT entity, count(*) AS draw_count, round(count(*) / (SELECT count(*) FROM dr)::DOUBLE, 6) + 0.0 AS probability FROM dr JOIN rk ON rk.record = dr.record AND rk.at = dr.h % rk.n GROUP BY entity""")
def draws_with_multiplicity(spark, d):
    own = records(spark, d).withColumn("policies", 1 + F.col("o_orderkey") % 3)
    return D.drawn_counts(own, entities(spark, d), 10, 42, CANONICAL, "policies").select("entity", "draw_count", r6("probability", "probability"))


_WEIGHT = "exp(-power(abs(bal - price / 40.0) / 1000.0, 2) / 2)"


@query(SQL_CANONICAL + f""", w AS (SELECT record, entity, {_WEIGHT} + 0.001 AS w FROM cand JOIN rec USING (record) JOIN ent USING (entity))
SELECT entity, round(sum(w / t) / (SELECT count(DISTINCT record) FROM w), 6) + 0.0 AS probability FROM w JOIN (SELECT record, sum(w) AS t FROM w GROUP BY record) USING (record) GROUP BY entity""")
def weighted_probability(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    return D.gaussian_probability(rec, ent, F.col("price") / 40.0, F.col("bal"), 1000.0, 0.001, CANONICAL).select("entity", r6("probability", "probability"))


_SCORED = SQL_CANONICAL + """, p AS (SELECT entity, sum(1.0::DOUBLE / n) / (SELECT count(DISTINCT record) FROM cand) AS p FROM cand JOIN (SELECT record, count(*) AS n FROM cand GROUP BY record) USING (record) GROUP BY entity),
sc AS (SELECT entity, round(p, 9) AS s, CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS y FROM p JOIN ent USING (entity))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = D.expected_probability(records(spark, d), entities(spark, d), CANONICAL)
    return p.join(entities(spark, d), F.col("entity") == F.col("c_custkey")).select("entity", F.round("probability", 9).alias("s"), (F.col("bal") > 5000).cast("int").alias("y"))


@query(_SCORED + """, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM sc)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r""")
def metric_roc_auc(spark, d):
    return M.roc_auc(scored(spark, d), "s", "y").select(r6("roc_auc", "roc_auc"))


@query(_SCORED + """, g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY s),
c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY s DESC)),
q AS (SELECT s, tp / (SELECT sum(p) FROM g)::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS pre FROM c),
l AS (SELECT *, coalesce(lag(rec) OVER (ORDER BY s DESC), 0) AS r0, coalesce(lag(pre) OVER (ORDER BY s DESC), 1) AS p0 FROM q)
SELECT round(sum((rec - r0) * (pre + p0) / 2), 6) AS pr_auc FROM l""")
def metric_pr_auc(spark, d):
    return M.pr_auc(scored(spark, d), "s", "y").select(r6("pr_auc", "pr_auc"))


@query(_SCORED + """ SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(y), 6) AS prevalence, round(avg(power(s - y, 2)), 6) AS brier,
round(avg(-(y * ln(least(greatest(s, 1e-10), 1 - 1e-10)) + (1 - y) * ln(1 - least(greatest(s, 1e-10), 1 - 1e-10)))), 6) AS log_loss FROM sc""")
def metric_probability(spark, d):
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"), r6(F.avg("y"), "prevalence"), r6(M.brier(F.col("s"), F.col("y")), "brier"), r6(M.log_loss(F.col("s"), F.col("y")), "log_loss"))


@query(_SCORED + """, g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY s)
SELECT round(s, 6) + 0.0 AS threshold, round(sum(n) OVER w / (SELECT sum(n) FROM g), 6) + 0.0 AS fpr, round(sum(p) OVER w / (SELECT sum(p) FROM g), 6) + 0.0 AS tpr FROM g WINDOW w AS (ORDER BY s DESC)""")
def metric_roc_curve(spark, d):
    return M.roc_curve(scored(spark, d), "s", "y").select(r6("threshold", "threshold"), r6("fpr", "fpr"), r6("tpr", "tpr"))


@query("""WITH x AS (SELECT c_acctbal AS s, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS y FROM customer),
e AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM x)
SELECT CAST(len(list_filter(e, lambda z: z <= s)) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM x, e GROUP BY 1""")
def metric_calibration(spark, d):
    df = read(spark, d, "customer").select(F.col("c_acctbal").alias("s"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y"))
    return M.calibration(df, "s", "y").select("bin", "n", r6("mean_predicted", "mean_predicted"), r6("observed", "observed"))


@query("""WITH x AS (SELECT c_acctbal AS v, 1 AS a FROM customer UNION ALL SELECT s_acctbal, 0 FROM supplier),
g AS (SELECT v, sum(a) AS p, count(*) - sum(a) AS n FROM x GROUP BY v), t AS (SELECT sum(p)::DOUBLE AS tp, sum(n)::DOUBLE AS tn FROM g),
c AS (SELECT sum(p) OVER (ORDER BY v) AS cp, sum(n) OVER (ORDER BY v) AS cn FROM g)
SELECT round(max(abs(cp / tp - cn / tn)), 6) AS ks, CAST(max(tp) AS BIGINT) AS n1, CAST(max(tn) AS BIGINT) AS n0 FROM c, t""")
def metric_ks(spark, d):
    both = read(spark, d, "customer").select(F.col("c_acctbal").alias("v"), F.lit(1).alias("a")).unionByName(read(spark, d, "supplier").select(F.col("s_acctbal").alias("v"), F.lit(0).alias("a")))
    return M.ks_statistic(both, "v", "a").select(r6("ks", "ks"), "n1", "n0")


@query("""WITH x AS (SELECT o_totalprice AS a, o_custkey AS b FROM orders),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)
SELECT round(corr(ra, rb), 6) + 0.0 AS spearman, round(corr(a, b), 6) + 0.0 AS pearson FROM r""")
def metric_spearman(spark, d):
    return M.spearman(read(spark, d, "orders"), "o_totalprice", "o_custkey").select(r6("spearman", "spearman"), r6("pearson", "pearson"))


@query("SELECT round(1 - sum(power(l_extendedprice - (1500 * l_quantity), 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def metric_r2(spark, d):
    return read(spark, d, "lineitem").agg(r6(M.r_squared(F.col("l_extendedprice"), 1500 * F.col("l_quantity")), "r2"))


@query(SQL_CANONICAL + """, pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record), m AS (SELECT count(*) AS m FROM pn),
z AS (SELECT record, key, CASE WHEN zone LIKE 'A%' THEN zone WHEN zone = 'B' THEN zone ELSE zone END AS zone FROM rec),
sh AS (SELECT entity, sum(1.0::DOUBLE / n) AS s FROM cand JOIN pn USING (record) GROUP BY entity)
SELECT z.key, z.zone, entity, count(*) AS n_records, round(min(s) / min(m), 6) + 0.0 AS "full", round((min(s) - min(1.0::DOUBLE / n)) / (min(m) - 1), 6) + 0.0 AS without
FROM cand JOIN pn USING (record) JOIN z USING (record) JOIN sh USING (entity), m GROUP BY z.key, z.zone, entity""")
def jackknife(spark, d):
    out = R.jackknife(records(spark, d), entities(spark, d), CANONICAL)
    return out.select("profile.key", "profile.zone", "entity", "n_records", r6("full", "full"), r6("without", "without"))


@query(SQL_CANONICAL + """, pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record),
a AS (SELECT r.key AS fold, entity, 1.0::DOUBLE / n AS s FROM cand JOIN pn USING (record) JOIN rec r USING (record)),
f AS (SELECT DISTINCT fold FROM a)
SELECT f.fold, entity, round(sum(s) / min(t), 6) + 0.0 AS probability FROM f JOIN a ON a.fold <> f.fold JOIN (SELECT f.fold AS g, sum(s) AS t FROM f JOIN a ON a.fold <> f.fold GROUP BY 1) ON g = f.fold GROUP BY f.fold, entity""")
def leave_group_out(spark, d):
    sized = C.sized_candidates(records(spark, d), entities(spark, d), CANONICAL)
    shares = sized.groupBy(F.col("profile.key").alias("key"), "entity").agg(F.sum(F.col("n_records") / F.col("n")).alias("share"))
    return R.leave_group_out(shares, "key").select("fold", "entity", r6("probability", "probability"))


@query("""WITH k AS (SELECT c_custkey AS key, c_acctbal AS v, i, CAST('0x' || substr(md5('42|' || c_custkey || '|' || i), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u FROM customer, range(50) t(i)),
s AS (SELECT list(c ORDER BY j) AS steps FROM (SELECT j, sum(p) OVER (ORDER BY j) AS c FROM (SELECT j, 0.36787944117144233::DOUBLE / [1.0, 1.0, 2.0, 6.0, 24.0, 120.0, 720.0, 5040.0][j + 1]::DOUBLE AS p FROM range(8) t(j)))),
w AS (SELECT i, v, len(list_filter(steps, lambda x: u >= x)) AS w FROM k, s),
m AS (SELECT i, sum(w * v) / sum(w) AS mean FROM w GROUP BY i)
SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std FROM m""")
def bootstrap_interval(spark, d):
    reps = R.bootstrap_means(read(spark, d, "customer"), "c_custkey", "c_acctbal", 50)
    return R.percentile_interval(reps, "mean").select(r6("lo", "lo"), r6("hi", "hi"), r6("mean", "mean"), r6("std", "std"))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.5) AS a, quantile_cont(o_totalprice, 0.9) AS b FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'mid' ELSE 'high' END AS stratum, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders, e GROUP BY 1""")
def payment_strata(spark, d):
    return R.strata(read(spark, d, "orders"), "o_totalprice").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice"), "mean"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, expected probabilities, and how well they rank: one row."""
    return M.roc_auc(scored(spark, d), "s", "y")


@query(SQL_CHAIN.replace("WITH ", "WITH cfg AS (SELECT unnest([true, false]) AS zoned), ", 1) + f""",
k AS (SELECT record, entity FROM rec JOIN ent ON key = k), u AS (SELECT true AS zoned, * FROM cand UNION ALL SELECT false, * FROM k)
SELECT zoned, count(DISTINCT record) AS n_matched, count(DISTINCT entity) AS n_entities, count(*) AS n_pairs FROM u GROUP BY zoned""")
def parameter_sweep(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    out = None
    for zoned, m in ((True, CHAIN), (False, KEY_ONLY)):
        one = D.match_counts(rec, ent, m).select(F.lit(zoned).alias("zoned"), "n_matched", "n_entities", "n_pairs")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH d AS (SELECT o_orderkey AS record, i AS draw, seed, CAST('0x' || substr(md5(seed || '|' || o_orderkey || '|' || i), 1, 15) AS BIGINT) AS h FROM orders, range(5) t(i), (SELECT unnest([1, 2, 3]) AS seed) ), """
       + BASE + """, cand AS (SELECT record, entity FROM rec JOIN ent ON key = k AND coalesce(CASE WHEN zone LIKE 'A%' THEN regexp_replace(zone, '[0-9]+$', '') WHEN zone = 'B' THEN 'X' ELSE zone END, '?') = CASE WHEN ez LIKE 'A%' THEN regexp_replace(ez, '[0-9]+$', '') WHEN ez = 'B' THEN 'X' ELSE ez END),
rk AS (SELECT record, entity, row_number() OVER (PARTITION BY record ORDER BY entity) - 1 AS at, count(*) OVER (PARTITION BY record) AS n FROM cand)
SELECT seed, entity, count(*) AS draw_count FROM d JOIN rk ON rk.record = d.record AND rk.at = d.h % rk.n GROUP BY ALL""")
def seed_stability(spark, d):
    return R.seed_sweep(records(spark, d), entities(spark, d), 5, [1, 2, 3], CANONICAL).select("seed", "entity", "draw_count")


@query("""WITH t AS (SELECT unnest([NULL, 100.0, 500.0, 2000.0])::DOUBLE AS tol), """ + BASE + """,
c AS (SELECT record, entity, abs(bal - bfe) AS away FROM rec JOIN ent ON key = k),
f AS (SELECT tol, record, entity, tol IS NULL OR away IS NULL OR away <= tol AS ok FROM c, t),
g AS (SELECT *, bool_or(ok) OVER (PARTITION BY tol, record) AS any_ FROM f)
SELECT tol, count(*) AS n_pairs FROM g WHERE ok OR NOT any_ GROUP BY tol""")
def tolerance_sweep(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    out = None
    for tol in (None, 100.0, 500.0, 2000.0):
        m = Matching(use_zone=False, filters=() if tol is None else (Filter("bfe", "bal", "within", tol),), columns=COLUMNS)
        one = C.profile_sizes(rec, ent, m).agg(F.sum(F.col("n_records") * F.col("n")).alias("n_pairs")).select(F.lit(tol).cast("double").alias("tol"), "n_pairs")
        out = one if out is None else out.unionByName(one)
    return out
