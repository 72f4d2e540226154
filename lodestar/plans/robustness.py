"""Queries over sweeps, resampling and variants that end in metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import candidates as C, cleaning as K, disaggregation as D, metrics as M, resampling as R
from ..operators.candidates import Filter, Matching
from .matching import BASE, CANONICAL, COLUMNS, KEY_ONLY, SQL_CANONICAL, SQL_KEY, entities, records
from .registry import query, r6, read

#: Metrics of sc(cfg, entity, s, y) by configuration.
METRICS = """
ra_ AS (SELECT cfg, y, rank() OVER (PARTITION BY cfg ORDER BY s) + (count(*) OVER (PARTITION BY cfg, s) - 1) / 2.0::DOUBLE AS r FROM sc),
roc_ AS (SELECT cfg, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc FROM ra_ GROUP BY cfg),
gr_ AS (SELECT cfg, s, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY cfg, s),
cu_ AS (SELECT cfg, s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY cfg) AS tot FROM gr_ WINDOW w AS (PARTITION BY cfg ORDER BY s DESC)),
cv_ AS (SELECT cfg, s, tp / tot::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS pre FROM cu_),
la_ AS (SELECT *, coalesce(lag(rec) OVER v, 0) AS r0, coalesce(lag(pre) OVER v, 1) AS p0 FROM cv_ WINDOW v AS (PARTITION BY cfg ORDER BY s DESC)),
pr_ AS (SELECT cfg, sum((rec - r0) * (pre + p0) / 2) AS pr_auc FROM la_ GROUP BY cfg),
ba_ AS (SELECT cfg, count(*) AS n, avg(y) AS prevalence, avg(power(s - y, 2)) AS brier FROM sc GROUP BY cfg),
met AS (SELECT * FROM ba_ JOIN roc_ USING (cfg) JOIN pr_ USING (cfg))"""
_ROUNDED = "n, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier"
_TRUE = "CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS y"
_RANKED = ", rk AS (SELECT record, entity, row_number() OVER (PARTITION BY record ORDER BY entity) - 1 AS at, count(*) OVER (PARTITION BY record) AS n FROM cand)"


def _draws(n: int, seeds: str) -> str:
    return f"""{_RANKED},
dr AS (SELECT record, i AS draw, seed, CAST('0x' || substr(md5(seed || '|' || record || '|' || i), 1, 15) AS BIGINT) AS h FROM (SELECT DISTINCT record FROM rk), range({n}) t(i), (SELECT unnest([{seeds}]) AS seed)),
draws AS (SELECT dr.record, draw, seed, entity FROM dr JOIN rk ON rk.record = dr.record AND rk.at = dr.h % rk.n)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("bal > 5000").select(F.col("c_custkey").alias("entity"))


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[r6(c, c) for c in ("prevalence", "roc_auc", "pr_auc", "brier")])


def _nine(scores: DataFrame, *keys: str) -> DataFrame:
    """Scores in nine digits, so that ties are ties in any order of summing."""
    return scores.select(*keys, "entity", F.round("probability", 9).alias("probability"))


@query(SQL_CANONICAL + _draws(20, "42") + f""", ct AS (SELECT z AS cfg, entity, count(*) AS c FROM draws, (SELECT unnest([5, 10, 20]) AS z) WHERE draw < z GROUP BY ALL),
sc AS (SELECT cfg, entity, c / (sum(c) OVER (PARTITION BY cfg))::DOUBLE AS s, {_TRUE} FROM ct JOIN ent USING (entity)), {METRICS} SELECT cfg AS size, {_ROUNDED} FROM met""")
def convergence_metrics(spark, d):
    counts = D.drawn_counts_by_size(records(spark, d), entities(spark, d), [5, 10, 20], 42, CANONICAL)
    return rounded(R.count_metrics(counts, truth(spark, d), "size"), "size")


@query(SQL_CANONICAL + _draws(5, "1, 2, 3, 4") + f""", ct AS (SELECT seed AS cfg, entity, count(*) AS c FROM draws GROUP BY ALL),
sc AS (SELECT cfg, entity, c / (sum(c) OVER (PARTITION BY cfg))::DOUBLE AS s, {_TRUE} FROM ct JOIN ent USING (entity)), {METRICS},
lo_ AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM met UNION ALL SELECT 'pr_auc', pr_auc FROM met UNION ALL SELECT 'brier', brier FROM met)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) + 0.0 AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM lo_ GROUP BY metric""")
def seed_metrics(spark, d):
    out = R.stability(R.seed_metrics(records(spark, d), entities(spark, d), 5, [1, 2, 3, 4], truth(spark, d), CANONICAL))
    return out.select("metric", *[r6(c, c) for c in ("mean", "std", "min", "max")])


_SHARES = "sh AS (SELECT entity, sum(1.0::DOUBLE / n) AS s FROM cand JOIN (SELECT record, count(*) AS n FROM cand GROUP BY record) USING (record) GROUP BY entity)"


@query(f"""WITH t AS (SELECT unnest([-1.0, 100.0, 500.0, 2000.0])::DOUBLE AS cfg), {BASE},
c0 AS (SELECT record, entity, abs(bal - bfe) AS away FROM rec JOIN ent ON key = k),
f0 AS (SELECT cfg, record, entity, cfg < 0 OR away IS NULL OR away <= cfg AS ok FROM c0, t),
f1 AS (SELECT *, bool_or(ok) OVER (PARTITION BY cfg, record) AS any_ FROM f0), cand AS (SELECT cfg, record, entity FROM f1 WHERE ok OR NOT any_),
nn AS (SELECT cfg, record, count(*) AS n FROM cand GROUP BY ALL), m AS (SELECT cfg, count(*) AS m FROM nn GROUP BY cfg),
p0 AS (SELECT cfg, entity, sum(1.0::DOUBLE / n) AS s FROM cand JOIN nn USING (cfg, record) GROUP BY ALL),
sc AS (SELECT cfg, entity, round(s / m, 9) AS s, {_TRUE} FROM p0 JOIN m USING (cfg) JOIN ent USING (entity)), {METRICS} SELECT CAST(cfg AS INTEGER)::VARCHAR AS configuration, {_ROUNDED} FROM met""")
def tolerance_metrics(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    scores = None
    for tol in (None, 100.0, 500.0, 2000.0):
        m = KEY_ONLY if tol is None else Matching(use_zone=False, filters=(Filter("bfe", "bal", "within", tol),), columns=COLUMNS)
        one = D.expected_probability(rec, ent, m).withColumn("configuration", F.lit(str(int(-1 if tol is None else tol))))
        scores = one if scores is None else scores.unionByName(one)
    return rounded(R.score_metrics(_nine(scores, "configuration"), truth(spark, d), ("configuration",)), "configuration")


@query(SQL_CANONICAL + f""", {_SHARES}, m AS (SELECT count(DISTINCT record) AS m FROM cand), b AS (SELECT unnest([0, 500, 1000, 2500]) AS cfg),
sc AS (SELECT cfg, entity, round(s / m, 9) AS s, CASE WHEN bal > 5000 - cfg THEN 1 ELSE 0 END AS y FROM sh JOIN ent USING (entity), m, b), {METRICS} SELECT cfg AS buffer, {_ROUNDED} FROM met""")
def buffer_metrics(spark, d):
    ent = entities(spark, d)
    scores = _nine(D.expected_probability(records(spark, d), ent, CANONICAL))
    buffers = ent.withColumn("buffer", F.explode(F.array(*[F.lit(b) for b in (0, 500, 1000, 2500)])))
    truths = buffers.where(F.col("bal") > 5000 - F.col("buffer")).select("buffer", F.col("c_custkey").alias("entity"))
    return rounded(R.truth_metrics(scores, truths, "buffer"), "buffer")


_SWEEP = BASE.replace("ent AS (", "en0 AS (", 1) + """,
big AS (SELECT entity FROM (SELECT entity, row_number() OVER (PARTITION BY entity // 5 ORDER BY bal DESC, entity) AS nth FROM en0) WHERE nth = 1),
zr AS (SELECT record, key, CASE WHEN zone LIKE 'A%' THEN regexp_replace(zone, '[0-9]+$', '') WHEN zone = 'B' THEN 'X' ELSE zone END AS z FROM rec),
ze AS (SELECT entity, k, bal, CASE WHEN ez LIKE 'A%' THEN regexp_replace(ez, '[0-9]+$', '') WHEN ez = 'B' THEN 'X' ELSE ez END AS e FROM en0),
o AS (SELECT unnest(['all', 'largest']) AS which), pz AS (SELECT unnest(['key', 'zone']) AS how),
cand AS (SELECT how || '_' || which AS cfg, record, entity FROM zr JOIN ze ON key = k, o, pz WHERE (how = 'key' OR z = e) AND (which = 'all' OR entity IN (SELECT entity FROM big))),
nn AS (SELECT cfg, record, count(*) AS n FROM cand GROUP BY ALL), m AS (SELECT cfg, count(*) AS m FROM nn GROUP BY cfg),
p0 AS (SELECT cfg, entity, sum(1.0::DOUBLE / n) AS s FROM cand JOIN nn USING (cfg, record) GROUP BY ALL),
sc AS (SELECT cfg, entity, round(s / m, 9) AS s, """ + _TRUE + " FROM p0 JOIN m USING (cfg) JOIN ze USING (entity))"


@query(f"WITH {_SWEEP}, {METRICS} SELECT cfg AS configuration, {_ROUNDED} FROM met")
def sweep_metrics(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    largest = K.largest_per_group(ent.withColumn("parcel", F.expr("c_custkey div 5")), "parcel", "bal", "c_custkey").drop("parcel")
    ways = [(f"{how}_{which}", rec, e, m) for how, m in (("key", KEY_ONLY), ("zone", CANONICAL)) for which, e in (("all", ent), ("largest", largest))]
    scores = None
    for name, r, e, m in ways:
        one = D.expected_probability(r, e, m).withColumn("configuration", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    return rounded(R.score_metrics(_nine(scores, "configuration"), truth(spark, d), ("configuration",)), "configuration")


@query(SQL_CANONICAL + f""", {_SHARES}, pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record),
pf AS (SELECT key, zone, min(record) AS one, count(*) AS n_records FROM rec JOIN pn USING (record) GROUP BY ALL),
w AS (SELECT pf.key, pf.zone, sh.entity, round(sh.s - CASE WHEN c.entity IS NULL THEN 0 ELSE 1.0::DOUBLE / n END, 9) AS s FROM pf JOIN pn ON pf.one = pn.record CROSS JOIN sh LEFT JOIN cand c ON c.record = pf.one AND c.entity = sh.entity),
sc0 AS (SELECT key || '/' || zone AS cfg, entity, s, {_TRUE} FROM w JOIN ent USING (entity) WHERE s > 0),
sc AS (SELECT * FROM sc0 UNION ALL SELECT 'full', entity, round(s, 9), {_TRUE} FROM sh JOIN ent USING (entity)), {METRICS}
SELECT key, zone, n_records, round((SELECT roc_auc FROM met WHERE cfg = 'full') - roc_auc, 6) + 0.0 AS influence FROM met JOIN pf ON cfg = key || '/' || zone""")
def jackknife_influence(spark, d):
    out = R.influence(records(spark, d), entities(spark, d), truth(spark, d), CANONICAL)
    return out.select(F.get_json_object("fold", "$.key").alias("key"), F.get_json_object("fold", "$.zone").alias("zone"), "n_records", r6("influence", "influence"))


@query(SQL_CANONICAL + f""", pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record),
a AS (SELECT r.key AS fold, entity, 1.0::DOUBLE / n AS s FROM cand JOIN pn USING (record) JOIN rec r USING (record)), f AS (SELECT DISTINCT fold FROM a),
t AS (SELECT f.fold, sum(s) AS t FROM f JOIN a ON a.fold <> f.fold GROUP BY 1),
sc AS (SELECT f.fold AS cfg, entity, round(sum(s) / min(t), 9) AS s, any_value({_TRUE.removesuffix(' AS y')}) AS y FROM f JOIN a ON a.fold <> f.fold JOIN t ON t.fold = f.fold JOIN ent USING (entity) GROUP BY ALL), {METRICS} SELECT cfg AS fold, {_ROUNDED} FROM met""")
def leave_group_out_metrics(spark, d):
    sizes = C.sized_candidates(records(spark, d), entities(spark, d), CANONICAL)
    shares = sizes.groupBy(F.col("profile.key").alias("key"), "entity").agg(F.sum(F.col("n_records") / F.col("n")).alias("share"))
    return rounded(R.score_metrics(_nine(R.leave_group_out(shares, "key"), "fold"), truth(spark, d), ("fold",)), "fold")


@query(SQL_CANONICAL + f""", pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record),
a AS (SELECT r.key AS fold, entity, 1.0::DOUBLE / n AS s FROM cand JOIN pn USING (record) JOIN rec r USING (record)), f AS (SELECT DISTINCT fold FROM a),
e AS (SELECT entity, sum(s) AS s FROM a GROUP BY 1), o AS (SELECT fold, entity, sum(s) AS off FROM a GROUP BY ALL),
w AS (SELECT f.fold, e.entity, e.s - coalesce(off, 0) AS raw, round(e.s - coalesce(off, 0), 9) AS s FROM f CROSS JOIN e LEFT JOIN o ON o.fold = f.fold AND o.entity = e.entity),
b AS (SELECT fold AS cfg, sum(power(raw / t - {_TRUE.removesuffix(' AS y')}, 2)) / count(*) AS brier FROM (SELECT *, sum(raw) OVER (PARTITION BY fold) AS t FROM w WHERE s > 0) JOIN ent USING (entity) GROUP BY 1),
sc AS (SELECT fold AS cfg, entity, s, {_TRUE} FROM w JOIN ent USING (entity) WHERE s > 0 UNION ALL SELECT 'full', entity, round(s, 9), {_TRUE} FROM e JOIN ent USING (entity)), {METRICS}
SELECT cfg AS fold, n, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS without, round((SELECT roc_auc FROM met WHERE cfg = 'full') - roc_auc, 6) + 0.0 AS influence, round(b.brier, 6) AS brier FROM met JOIN b USING (cfg)""")
def leave_group_out_areas(spark, d):
    shares = C.sized_candidates(records(spark, d), entities(spark, d), CANONICAL).groupBy(F.col("profile.key").alias("key"), "entity").agg(F.sum(F.col("n_records") / F.col("n")).alias("share"))
    out = R.group_areas(shares, "key", truth(spark, d))
    return out.select("fold", "n", r6("prevalence", "prevalence"), r6("without", "without"), r6(F.col("full") - F.col("without"), "influence"), r6("brier", "brier"))


_RESAMPLED = """,
num AS (SELECT record, row_number() OVER (ORDER BY record) - 1 AS i, count(*) OVER () AS total FROM rec),
dw AS (SELECT r AS cfg, CAST('0x' || substr(md5('42|' || r || '|' || i), 1, 15) AS BIGINT) % total AS pos FROM num, range(8) t(r)),
tm AS (SELECT cfg, pos, count(*) AS times FROM dw GROUP BY ALL),
pn AS (SELECT record, count(*) AS n FROM cand GROUP BY record),
w AS (SELECT cfg, record, times, n FROM tm JOIN num ON pos = i JOIN pn USING (record)),
m AS (SELECT cfg, sum(times) AS m FROM w GROUP BY cfg),
p0 AS (SELECT cfg, entity, sum(times / n::DOUBLE) AS s FROM w JOIN cand USING (record) GROUP BY ALL)"""


@query(SQL_CANONICAL + _RESAMPLED + f""", sc AS (SELECT cfg, entity, round(s / m, 9) AS s, {_TRUE} FROM p0 JOIN m USING (cfg) JOIN ent USING (entity)), {METRICS},
lo_ AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM met UNION ALL SELECT 'pr_auc', pr_auc FROM met UNION ALL SELECT 'brier', brier FROM met)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) + 0.0 AS std FROM lo_ GROUP BY metric""")
def bootstrap_metrics(spark, d):
    out = R.intervals(R.resampled_metrics(records(spark, d), entities(spark, d), truth(spark, d), 8, 42, CANONICAL))
    return out.select("metric", *[r6(c, c) for c in ("lo", "hi", "mean", "std")])


@query("""WITH num AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS total FROM customer),
dw AS (SELECT r, CAST('0x' || substr(md5('42|' || r || '|' || i), 1, 15) AS BIGINT) % total AS pos FROM num, range(50) t(r)),
m AS (SELECT r, avg(v) AS mean FROM dw JOIN num ON pos = i GROUP BY r)
SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std FROM m""")
def resampled_interval(spark, d):
    reps = R.resampled_means(read(spark, d, "customer"), "c_custkey", "c_acctbal", 50)
    return R.percentile_interval(reps, "mean").select(r6("lo", "lo"), r6("hi", "hi"), r6("mean", "mean"), r6("std", "std"))


# ---- variants of the matching, with one filter each

#: Filters by name: a tolerance in the value, in percent, in years, a bound on the entity, one for a zone, and a strict one.
FILTERS = {
    "elevation": Filter("bfe", "bal", "within", 500.0),
    "value": Filter("bfe", "bal", "percent", 20.0),
    "year_tol_0": Filter("yr", "built", "years", 0),
    "year_tol_5": Filter("yr", "built", "years", 5),
    "slope": Filter("", "bal", "at_most", 1000.0),
    "distance_in_x": Filter("", "built", "at_most", 1960.0, zone="X"),
    "latlon_strict": Filter("yr", "built", "equal", strict=True),
}
_PASSES = {
    "elevation": ("bfe IS NULL", "abs(bal - bfe) <= 500.0", False),
    "value": ("bfe IS NULL", "bal > 0 AND bal >= bfe * (1 - 0.2::DOUBLE) AND bal <= bfe * (1 + 0.2::DOUBLE)", False),
    "year_tol_0": ("false", "built = yr", False),
    "year_tol_5": ("false", "abs(built - yr) <= 5", False),
    "slope": ("false", "bal <= 1000.0", False),
    "distance_in_x": ("coalesce(CASE WHEN zone = 'B' THEN 'X' ELSE zone END, '') <> 'X'", "built <= 1960", False),
    "latlon_strict": ("false", "built = yr", True),
}


def _variant_sql() -> str:
    parts = []
    for name, (exempt, test, strict) in _PASSES.items():
        keep = "ok" if strict else "ok OR NOT any_"
        parts.append(f"SELECT '{name}' AS variant, count(*) AS n_pairs, count(DISTINCT record) AS n_matched, count(DISTINCT entity) AS n_entities FROM (SELECT *, bool_or(ok) OVER (PARTITION BY record) AS any_ FROM (SELECT record, entity, ({exempt}) OR coalesce({test}, false) AS ok FROM cand JOIN rec USING (record) JOIN ent USING (entity))) WHERE {keep}")
    return SQL_CANONICAL + " " + " UNION ALL ".join(parts)


@query(_variant_sql())
def matching_variants(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    out = None
    for name, f in FILTERS.items():
        one = D.match_counts(rec, ent, Matching("canonical", filters=(f,), columns=COLUMNS)).select(F.lit(name).alias("variant"), "n_pairs", "n_matched", "n_entities")
        out = one if out is None else out.unionByName(one)
    return out


def _variant_metrics_sql() -> str:
    parts = ["SELECT 'baseline' AS cfg, record, entity, 1.0::DOUBLE AS w FROM cand", "SELECT 'weighted', record, entity, 1.0::DOUBLE + built % 4 FROM cand JOIN ent USING (entity)"]
    parts += ["""SELECT 'coarse_key', record, entity, 1.0::DOUBLE FROM (SELECT record, CAST(key AS INTEGER) % 5 AS ck, CASE WHEN zone LIKE 'A%' THEN regexp_replace(zone, '[0-9]+$', '') WHEN zone = 'B' THEN 'X' ELSE zone END AS z FROM rec)
JOIN (SELECT entity, CAST(k AS INTEGER) % 5 AS ek, CASE WHEN ez LIKE 'A%' THEN regexp_replace(ez, '[0-9]+$', '') WHEN ez = 'B' THEN 'X' ELSE ez END AS e FROM ent) ON ck = ek AND z = e"""]
    for name, (exempt, test, strict) in _PASSES.items():
        keep = "ok" if strict else "ok OR NOT any_"
        parts.append(f"SELECT '{name}', record, entity, 1.0::DOUBLE FROM (SELECT *, bool_or(ok) OVER (PARTITION BY record) AS any_ FROM (SELECT record, entity, ({exempt}) OR coalesce({test}, false) AS ok FROM cand JOIN rec USING (record) JOIN ent USING (entity))) WHERE {keep}")
    return SQL_CANONICAL + f""", v AS ({' UNION ALL '.join(parts)}), sw AS (SELECT cfg, record, entity, w / sum(w) OVER (PARTITION BY cfg, record) AS s FROM v), m AS (SELECT cfg, count(DISTINCT record) AS m FROM v GROUP BY cfg),
p0 AS (SELECT cfg, entity, sum(s) AS s FROM sw GROUP BY ALL), sc AS (SELECT cfg, entity, round(s / m, 9) AS s, {_TRUE} FROM p0 JOIN m USING (cfg) JOIN ent USING (entity)), {METRICS} SELECT cfg AS configuration, {_ROUNDED} FROM met"""


@query(_variant_metrics_sql())
def variant_metrics(spark, d):
    """Variants by another key, by weights and by each filter, all scored together against one truth."""
    rec, ent = records(spark, d), entities(spark, d)
    coarse = lambda df: df.withColumn("key", F.col("key").cast("int") % 5)
    ways = [("baseline", rec, ent, CANONICAL), ("coarse_key", coarse(rec), coarse(ent), CANONICAL)]
    ways += [(name, rec, ent, Matching("canonical", filters=(f,), columns=COLUMNS)) for name, f in FILTERS.items()]
    scores = None
    for name, r, e, m in ways:
        one = D.expected_probability(r, e, m).withColumn("configuration", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    weighted = D.weighted_by_values(rec, ent, 1.0 + F.col("built") % 4, (), ("built",), CANONICAL)
    scores = scores.unionByName(weighted.withColumn("configuration", F.lit("weighted")))
    return rounded(R.score_metrics(_nine(scores, "configuration"), truth(spark, d), ("configuration",)), "configuration")


def _filter_query(name: str):
    exempt, test, strict = _PASSES[name]
    keep = "ok" if strict else "ok OR NOT any_"
    sql = SQL_CANONICAL + f""", fl AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY record) AS any_ FROM (SELECT record, entity, ({exempt}) OR coalesce({test}, false) AS ok FROM cand JOIN rec USING (record) JOIN ent USING (entity))) WHERE {keep})
SELECT record, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates, coalesce(n, 0) > 0 AS matched FROM rec LEFT JOIN (SELECT record, count(*) AS n FROM fl GROUP BY record) USING (record)"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.record_stats(records(spark, d), entities(spark, d), Matching("canonical", filters=(FILTERS[name],), columns=COLUMNS))

    run.__name__ = f"candidates_{name}"
    return query(sql)(run)


for _name in FILTERS:
    _filter_query(_name)


@query(SQL_KEY + """, p AS (SELECT entity, sum(1.0::DOUBLE / n) AS s FROM cand JOIN (SELECT record, count(*) AS n FROM cand GROUP BY record) USING (record) GROUP BY entity),
a AS (SELECT entity, round(s / (SELECT count(DISTINCT record) FROM cand), 9) AS pa FROM p),
c2 AS (SELECT record, entity FROM cand JOIN rec USING (record) WHERE price > 100000),
q AS (SELECT entity, sum(1.0::DOUBLE / n) AS s FROM c2 JOIN (SELECT record, count(*) AS n FROM c2 GROUP BY record) USING (record) GROUP BY entity),
b AS (SELECT entity, round(s / (SELECT count(DISTINCT record) FROM c2), 9) AS pb FROM q),
x AS (SELECT pa AS v, 1 AS g FROM a UNION ALL SELECT pb, 0 FROM b), g AS (SELECT v, sum(g) AS p, count(*) - sum(g) AS n FROM x GROUP BY v),
c AS (SELECT sum(p) OVER (ORDER BY v) / (SELECT sum(p) FROM g)::DOUBLE AS f1, sum(n) OVER (ORDER BY v) / (SELECT sum(n) FROM g)::DOUBLE AS f0 FROM g)
SELECT round((SELECT max(abs(f1 - f0)) FROM c), 6) AS ks, round(corr(pa, pb), 4) + 0.0 AS pearson, count(*) AS n_overlap FROM a JOIN b USING (entity)""")
def claim_policy_comparison(spark, d):
    rec, ent = records(spark, d), entities(spark, d)
    one = _nine(D.expected_probability(rec, ent, KEY_ONLY))
    two = _nine(D.expected_probability(rec.where("price > 100000"), ent, KEY_ONLY))
    both = one.select(F.col("probability").alias("v"), F.lit(1).alias("g")).unionByName(two.select(F.col("probability").alias("v"), F.lit(0).alias("g")))
    overlap = one.join(two.select("entity", F.col("probability").alias("other")), "entity").agg(F.round(M.correlation("probability", "other"), 4).alias("pearson"), F.count(F.lit(1)).alias("n_overlap"))
    return M.ks_statistic(both, "v", "g").crossJoin(overlap).select(r6("ks", "ks"), (F.col("pearson") + 0.0).alias("pearson"), "n_overlap")
