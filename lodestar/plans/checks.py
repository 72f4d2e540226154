"""Queries over functions of text, formats, rules and space whose inputs are made from ids, so that SQL knows the answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S, texts as T
from ..operators import cleaning as K, disaggregation as D, estimation as E, linkage as L, moments as MO, quality as Q, resampling as R, spatial as G, summaries as A
from .registry import query, r6, read
from .tables import _EDGES, _POINTS, points, polygons


def _choice(k: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def guideline(k: Column) -> Column:
    """A guideline that states facts that follow from a number."""
    return _join(
        "Abstract: ", 100 + k % 50, " to ", 200 + k % 50, " words.\n",
        "Please give at least ", 3 + k % 3, " keywords; keywords are indexed.\n",
        "The word limit of the manuscript is no more than ", 5000 + k % 1000, " words.\n",
        "We use ", _choice(k, "double-blind", "single blind", "open peer review"), " review and ", _choice(k, "Editorial Manager", "ScholarOne", "OJS", "our own desk"), ".\n",
        "A submission fee of $", 100 + k % 900, " is due. The text is ", _choice(k, "double-spaced", "1.5 spaced", "single spaced"), " in Times New Roman, ", 10 + k % 3, " pt, with ", 1 + k % 3, " inch margins.\n",
        "References are ", _choice(k, "author-year", "numbered"), ". Send figures as EPS or TIFF; line art needs ", 600 + k % 400, " dpi.\n",
        "A statement of data availability is ", _choice(k, "required", "welcome"), ". The article processing charge is ", 1000 + k % 500, " USD.",
    )


@query("""SELECT doc_id, CAST(100 + doc_id % 50 AS VARCHAR) AS abstract_min, CAST(200 + doc_id % 50 AS VARCHAR) AS abstract_max, CAST(5000 + doc_id % 1000 AS VARCHAR) AS word_limit,
['double-blind', 'single-blind', 'open'][doc_id % 3 + 1] AS review, ['Editorial Manager', 'ScholarOne', 'OJS', NULL][doc_id % 4 + 1] AS system, CAST(100 + doc_id % 900 AS VARCHAR) AS fee,
['double', '1.5', 'single'][doc_id % 3 + 1] AS spacing, 'Times New Roman' AS font, CAST(10 + doc_id % 3 AS VARCHAR) AS size_pt, CAST(1 + doc_id % 3 AS VARCHAR) || '.0' AS margin, 'in' AS unit,
['author-year', 'numeric'][doc_id % 2 + 1] AS style, 'EPS' AS vector, 'TIFF' AS raster, CAST(600 + doc_id % 400 AS VARCHAR) AS dpi, ['true', NULL][doc_id % 2 + 1] AS data_required,
CAST(1000 + doc_id % 500 AS VARCHAR) AS apc, 'USD' AS currency FROM documents""")
def guideline_updates(spark, d):
    texts = read(spark, d, "documents").select("doc_id", guideline(F.col("doc_id")).alias("text"))  # made once, not in each expression
    docs = texts.select("doc_id", T.guideline_updates(F.col("text")).alias("m"))
    paths = {
        "abstract_min": "abstract.min_words", "abstract_max": "abstract.max_words", "word_limit": "paper_types.research_article.word_limit", "review": "submission.peer_review",
        "system": "submission.system", "fee": "submission.fee", "spacing": "text_formatting.line_spacing", "font": "text_formatting.font.family", "size_pt": "text_formatting.font.size_pt",
        "margin": "text_formatting.margins.left", "unit": "text_formatting.margins.unit", "style": "references.style", "vector": "artwork.formats.vector_preferred", "raster": "artwork.formats.raster_acceptable",
        "dpi": "artwork.resolution.line_art_dpi", "data_required": "declarations.data_availability.required", "apc": "open_access.apc.amount", "currency": "open_access.apc.currency",
    }
    return docs.select("doc_id", *[F.col("m")[path].alias(name) for name, path in paths.items()])


@query("""SELECT doc_id, ['This study', 'Here our paper'][doc_id % 2 + 1] || ' on ' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' and what else there' AS first_passage, CAST(2 AS BIGINT) AS n FROM documents""")
def self_references(spark, d):
    k = F.col("doc_id")
    text = _join(_choice(k, "This study", "Here our paper"), " on ", F.lpad((k % 1000).cast("string"), 3, "0"), "\nand what else there", " " * 80, "In the end we find it.")
    found = T.self_references(text)
    return read(spark, d, "documents").select("doc_id", F.get(found, F.lit(0)).alias("first_passage"), F.size(found).cast("bigint").alias("n"))


@query("""WITH p AS (SELECT doc_id, unnest([1, 2, 3]) AS i FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS key, ['M1', 'M2', 'm1'][i] AS id, ['major', 'major', 'minor'][i] AS section, [1, 2, 1][i]::INTEGER AS number, 'Title ' || doc_id || ' ' || i AS title,
['VALID - ACTION NEEDED', 'ALREADY ADDRESSED', 'INVALID'][i] AS status, 'Said ' || doc_id || chr(10) || 'and more' AS concern, CASE i WHEN 1 THEN 'Done.' ELSE '' END AS response, CASE i WHEN 1 THEN 'a.py,b.md' ELSE '' END AS files FROM p""".replace("'m1'", "'M1'"))
def tracker_comments(spark, d):
    k = F.col("doc_id")
    concern = _join("**Concern**:\n> Said ", k, "\n>\nand more\n")
    text = _join(
        "# Tracker\n## Overview\n### Not a comment\n## Major Comments\n### Comment 1: Title ", k, " 1\n**Status**: [VALID - ACTION NEEDED]\n", concern, "**Response**:\nDone.\n**Files Modified**:\n- `a.py`\n- b.md\n---\nnot a field\n",
        "### Title ", k, " 2\n**Status**: already addressed\n", concern, "## Minor Comments\n### Minor 1: Title ", k, " 3\n**Status**: this is INVALID\n", concern, "**Other**: x\nnothing\n",
    )
    out = T.tracker_comments(read(spark, d, "documents").select("doc_id", text.alias("t")), "doc_id", "t")
    return out.select("key", "id", "section", "number", "title", "status", "concern", "response", F.array_join("files", ",").alias("files"))


@query("""SELECT doc_id, 'a - b <= 5 EUR ' || doc_id || chr(10) || chr(10) || 'end' AS text, chr(10) || 'Line ' || doc_id || chr(10) || chr(10) || 'x < y & z' || chr(10) AS plain, '3' AS year, CAST(2 AS BIGINT) AS done, CAST(1 AS BIGINT) AS open,
make_timestamp(2024, 1, 1 + doc_id % 28, 12, 0, 0) AS stamp, doc_id % 2 = 0 AS cited, 'No more than ' || doc_id || ' words' AS abstract FROM documents""")
def text_functions(spark, d):
    k = F.col("doc_id")
    stamp = _join("qa_202401", F.lpad((1 + k % 28).cast("string"), 2, "0"), "_120000.csv")
    marks = T.checklist(F.lit("- [x] a\n- [ ] b\n- [x] c"))
    return read(spark, d, "documents").select(
        "doc_id",
        T.plain_whitespace(_join("  a – b ≤ 5€", k, "\r\r\r\r\nend \n")).alias("text"),
        T.html_to_text(_join("<p>Line ", k, "</p><b></b><div>x &lt; y &amp; z</div>")).alias("plain"),
        T.front_matter(_join("---\ntitle: 'A ", k, "'\nyear: 3\n---\nx"))["year"].alias("year"),
        marks[0].alias("done"), marks[1].alias("open"), T.stamp_of_name(stamp).alias("stamp"),
        T.bibliography(F.when(k % 2 == 0, "bibliography: x.bib @a").otherwise("@b"))["passed"].alias("cited"),
        T.abstract(_join("# A\n## Abstract\nNo more than ", k, " words\n## Next\nx")).alias("abstract"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 1000 < 1 THEN '<0.001' ELSE printf('%.3f', ((c_custkey % 1000) / 1000.0)::DOUBLE) END AS p,
CASE WHEN c_custkey % 1000 < 1 THEN '***' WHEN c_custkey % 1000 < 10 THEN '**' WHEN c_custkey % 1000 < 50 THEN '*' ELSE '' END AS stars,
'[' || printf('%.2f', (-(c_custkey % 100))::DOUBLE) || ', ' || printf('%.2f', (c_custkey % 100)::DOUBLE) || ']' AS interval, 'N = ' || CASE WHEN c_custkey >= 1000 THEN (c_custkey // 1000) || ',' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS count,
CASE WHEN c_custkey % 3 = 0 THEN printf('%.1f', ((c_custkey % 2) * 100.0)::DOUBLE) ELSE printf('%.1f', (2.0 + c_custkey % 50)::DOUBLE) END || '%' AS percent, CASE WHEN c_custkey % 5 > 2 THEN '+' ELSE '' END || printf('%.3f', (c_custkey % 5 - 2.0)::DOUBLE) AS difference,
'F(' || c_custkey % 4 || ', ' || c_custkey % 90 || ') = ' || printf('%.2f', ((c_custkey % 7) / 4.0)::DOUBLE) AS f FROM customer""")
def formats(spark, d):
    k = F.col("c_custkey")
    x = F.when(k % 3 == 0, (k % 2).cast("double")).otherwise(2.0 + k % 50)
    p = (k % 1000) / 1000.0
    return read(spark, d, "customer").select(
        "c_custkey", S.format_p(p).alias("p"), S.significance_stars(p).alias("stars"), S.format_interval(-(k % 100), k % 100, 2).alias("interval"), S.format_count(k).alias("count"),
        S.format_percent(x).alias("percent"), S.format_difference((k % 5) - 2.0).alias("difference"), S.format_f((k % 7) / 4.0, k % 4, k % 90).alias("f"),
    )


# ---- rules, metrics and reports

_FULL = "li AS (SELECT * REPLACE (CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)"


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax"))).unionByName(li.where("l_orderkey % 50 = 0"))


@query(f"WITH {_FULL}, m AS (SELECT count(*) AS n, count(*) - count(l_tax) AS missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li)) AS dup FROM li) SELECT n AS n_rows, CAST(11 AS BIGINT) AS n_columns, missing AS missing_cells, round(100.0::DOUBLE * missing / (n * 11), 6) AS missing_pct, dup AS duplicate_rows, round(100.0::DOUBLE * dup / n, 6) AS duplicate_pct FROM m")
def whole_table_metrics(spark, d):
    return Q.table_metrics(_repeated(spark, d)).select("n_rows", "n_columns", "missing_cells", r6("missing_pct", "missing_pct"), "duplicate_rows", r6("duplicate_pct", "duplicate_pct"))


@query(f"WITH {_FULL}, m AS (SELECT count(*) AS n, 100.0::DOUBLE * (count(*) - count(l_tax)) / (count(*) * 11) AS missing, 100.0::DOUBLE * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li))) / count(*) AS dup FROM li) SELECT 's01' AS stage, metric, round(v, 4) AS number, w AS warning FROM m, LATERAL (VALUES ('missing_pct', missing, missing > 1.0), ('duplicate_pct', dup, dup > 1.0), ('n_rows', n, n < 10)) x(metric, v, w)")
def report_warnings(spark, d):
    metrics = Q.table_metrics(_repeated(spark, d)).select("missing_pct", "duplicate_pct", "n_rows")
    history = Q.metric_rows(metrics, "s01", "20240102_000000").unionByName(Q.metric_rows(metrics.selectExpr("0.0 AS missing_pct", "0.0 AS duplicate_pct", "1 AS n_rows"), "s01", "20240101_000000"))
    return Q.report_warnings(Q.latest_metrics(history), missing=1.0).select("stage", "metric", F.round("number", 4).alias("number"), "warning")


@query("""WITH a AS (SELECT n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE md5(n_name) END AS hash, n_regionkey AS size FROM nation WHERE n_nationkey < 20),
b AS (SELECT n_name AS path, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 5 = 0 THEN 'x' ELSE md5(n_name) END AS hash, n_regionkey + (n_nationkey % 2) AS size FROM nation WHERE n_nationkey > 4)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'left_only' WHEN a.path IS NULL THEN 'right_only' WHEN a.hash IS NOT NULL AND b.hash IS NOT NULL THEN CASE WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END WHEN a.size = b.size THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.path = b.path""")
def manifest_hashes(spark, d):
    n, k, name = read(spark, d, "nation"), F.col("n_nationkey"), F.col("n_name")
    md5 = F.md5(name.cast("binary"))
    a = n.where(k < 20).select(name.alias("path"), F.when(k % 3 != 0, md5).alias("hash"), F.col("n_regionkey").alias("size"), F.lit(1).alias("mtime"))
    b = n.where(k > 4).select(name.alias("path"), F.when(k % 4 == 0, None).when(k % 5 == 0, "x").otherwise(md5).alias("hash"), (F.col("n_regionkey") + k % 2).alias("size"), F.lit(1).alias("mtime"))
    return Q.manifest_diff(a, b)


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_nationkey AS k FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT k, sum(v) AS n FROM (SELECT k, -1 AS v FROM a UNION ALL SELECT k, 1 FROM b) GROUP BY k)
SELECT CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS side, CAST(abs(n) AS BIGINT) AS n, k FROM s WHERE n <> 0""")
def row_differences(spark, d):
    c = read(spark, d, "customer")
    return Q.row_diff(c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("k")), c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k")))


@query("""SELECT 'row_count' AS rule, 'error' AS severity, count(*) AS n_failures, count(*) >= 10 AS passed FROM orders UNION ALL SELECT 'no_missing_values', 'error', count(*) - count(nullif(o_custkey % 10, 0)), count(*) = count(nullif(o_custkey % 10, 0)) FROM orders
UNION ALL SELECT 'no_duplicate_rows', 'error', count(*) - count(DISTINCT (coalesce(nullif(o_custkey % 10, 0), -1), o_orderstatus)), count(*) = count(DISTINCT (coalesce(nullif(o_custkey % 10, 0), -1), o_orderstatus)) FROM orders
UNION ALL SELECT 'broken', 'warning', NULL, false""")
def panel_rules(spark, d):
    o = read(spark, d, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 10).alias("unit"), F.col("o_orderstatus").alias("period"))
    return Q.validate(o, [*Q.panel_rules(o, "unit", "period"), Q.Rule("broken", F.count_if(F.col("not_there") > 0), "warning")])


# ---- cleaning and linkage

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END AS yr, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 / 10.0::DOUBLE ELSE (o_orderkey % 100) / 10.0::DOUBLE END + 0.0 AS rounded,
CASE WHEN o_orderkey % 5 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE / (o_orderkey % 5) END AS filled, o_orderkey % 7 AS number, 'x' || o_orderkey AS word FROM orders WHERE o_orderkey % 11 <> 0""")
def cleaning_rules(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(
        "o_orderkey",
        S.year_of(F.when(k % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("yr"),
        S.round_half_even((k % 100) / 10.0, 1).alias("rounded"),
        F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(1.0 / F.nullif(k % 5, F.lit(0))).alias("filled"),
        (k % 7).cast("string").alias("number"), F.concat(F.lit("x"), k).alias("word"), F.when(k % 11 != 0, k).alias("there"),
    )
    empty = o.where("o_orderkey % 100 = 0").select(*[F.lit(None).cast(t).alias(c) for c, t in o.dtypes])
    rows = K.complete_cases(K.drop_empty_rows(o.unionByName(empty)), ["there"]).drop("there")
    filled = K.infinities_to_null(rows.select("filled", "o_orderkey"), None).select("o_orderkey", F.coalesce("filled", F.lit(-1.0)).alias("filled"))
    rows = rows.drop("filled").join(filled, "o_orderkey")
    return K.cast_or_keep(rows, {"number": "bigint", "word": "bigint"})


@query("""WITH t AS (SELECT o_orderkey, o_orderdate AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 200 DAY END AS b FROM orders)
SELECT o_orderkey FROM t WHERE a <= TIMESTAMP '1996-12-31' AND (b IS NULL OR b >= TIMESTAMP '1996-01-01')""")
def in_force_terms(spark, d):
    o = read(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS"))
    return o.where(K.in_force(F.col("o_orderdate"), end, F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))).select("o_orderkey")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_pairs(spark, d):
    return K.drop_duplicate_rows(read(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query("SELECT DISTINCT o_custkey % 40 AS k FROM orders WHERE o_custkey % 40 NOT IN (SELECT s_suppkey % 30 FROM supplier)")
def missing_categories(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k")).distinct()
    return o.join(read(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("s")).distinct(), F.col("k") == F.col("s"), "left_anti")


@query("SELECT c_custkey AS key, c_acctbal AS value, s_acctbal AS value_right, CASE WHEN s_suppkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def linkage_suffixes(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return L.exact_match(a, read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value")), ["key"])


_TYPOS = "ty AS (SELECT DISTINCT substr(p_name, 1, CAST(p_partkey % 6 AS INTEGER)) || 'q' || substr(p_name, CAST(p_partkey % 6 AS INTEGER) + 2) AS l FROM part), na AS (SELECT p_name AS r, min(p_partkey) AS o FROM part GROUP BY 1)"


def _typos(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    at = (F.col("p_partkey") % 6).cast("int")
    return p.select(F.concat(F.substring("p_name", F.lit(1), at), F.lit("q"), F.substring(F.col("p_name"), at + 2, F.lit(1000))).alias("typed"))


@query(f"""WITH {_TYPOS}, sc AS (SELECT l, r, o, 1 - levenshtein(lower(l), lower(r)) / greatest(length(l), length(r))::DOUBLE AS s FROM ty, na WHERE abs(length(l) - length(r)) <= 4),
b AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, o, r) AS nth FROM sc WHERE s >= 0.85) SELECT l AS left_value, r AS right_value, round(s, 6) AS score FROM b WHERE nth = 1""")
def fuzzy_part_names(spark, d):
    out = L.fuzzy_match(_typos(spark, d), read(spark, d, "part"), "typed", "p_name", 0.85, order=F.col("p_partkey"))
    return out.select("left_value", "right_value", r6("score", "score"))


@query()
def fuzzy_jaro_part_names(spark, d):
    """Without SQL: DuckDB rounds half of the letters out of order down, this rule does not; tested by brute force."""
    out = L.fuzzy_match(_typos(spark, d), read(spark, d, "part"), "typed", "p_name", 0.9, "jaro_winkler", order=F.col("p_partkey"))
    return out.select("left_value", "right_value", r6("score", "score"))


_PARTS_OF = "ty AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE substr(p_name, CAST(p_partkey % 5 AS INTEGER) + 1, CAST(p_partkey % 7 AS INTEGER) + 1) END AS l FROM part), na AS (SELECT p_name AS r, min(p_partkey) AS o FROM part GROUP BY 1)"


@query(f"""WITH {_PARTS_OF}, b AS (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY o, r) AS nth FROM ty JOIN na ON contains(lower(r), lower(l))) SELECT l AS left_value, r AS right_value, 1.0::DOUBLE AS score FROM b WHERE nth = 1""")
def fuzzy_contained_names(spark, d):
    k = F.col("p_partkey")
    asked = read(spark, d, "part").select(F.when(k % 3 == 0, F.col("p_name")).otherwise(F.substring(F.col("p_name"), (k % 5).cast("int") + 1, (k % 7).cast("int") + 1)).alias("asked"))
    return L.fuzzy_match(asked, read(spark, d, "part"), "asked", "p_name", 0.5, "contains", order=k)


@query("""WITH w AS (SELECT n_nationkey AS record, s_suppkey AS entity, 1.0::DOUBLE + s_suppkey % 4 AS w FROM nation JOIN supplier ON n_nationkey = s_nationkey),
c AS (SELECT *, sum(w) OVER p AS upto, sum(w) OVER (PARTITION BY record) AS total FROM w WINDOW p AS (PARTITION BY record ORDER BY entity)),
d AS (SELECT record, i AS draw, CAST('0x' || substr(md5('42|' || record || '|' || i), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u FROM (SELECT DISTINCT record FROM w), range(30) t(i))
SELECT record, draw, min(entity) AS entity FROM d JOIN c USING (record) WHERE upto / total > u GROUP BY ALL""")
def weighted_draws(spark, d):
    pairs = read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").alias("record"), F.col("s_suppkey").alias("entity"))
    return D.weighted_draws(pairs, 1.0 + F.col("entity") % 4, 30)


@query("""WITH g AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT fold, sum(n)::BIGINT AS n, count(*) AS n_groups FROM (SELECT k, n, CASE WHEN ((row_number() OVER (ORDER BY n DESC, k) - 1) // 5) % 2 = 0 THEN (row_number() OVER (ORDER BY n DESC, k) - 1) % 5 ELSE 4 - (row_number() OVER (ORDER BY n DESC, k) - 1) % 5 END::INTEGER AS fold FROM g) GROUP BY fold""")
def group_folds_dealt(spark, d):
    return R.dealt_folds(read(spark, d, "customer"), "c_nationkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("n_groups"))


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) AS ssr, count(*) AS n FROM lineitem),
e AS (SELECT b, sqrt(ssr / (n - 2) / sxx) AS se, n FROM s) SELECT round(b / se, 3) AS t, round(b - 1.959963984540054 * se, 3) AS lo, round(b + 1.959963984540054 * se, 3) AS hi, n FROM e""")
def ols_inference(spark, d):
    e = E.ols(read(spark, d, "lineitem"), E.Specification("q", "l_extendedprice", ("l_quantity",)))
    return spark.createDataFrame([(round(e.t, 3), round(e.ci[0], 3), round(e.ci[1], 3), e.n_obs)], "t double, lo double, hi double, n bigint")


_FOLDS = "f AS (SELECT l_suppkey % 5 AS fold, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice / 1000) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice / 1000) AS sxy, sum(power(l_extendedprice / 1000, 2)) AS syy FROM lineitem GROUP BY 1), p AS (SELECT unnest([0.0, 1000.0, 20000.0])::DOUBLE AS p)"
#: Sums of the training folds (n, x, y, xx, xy) and of the fold that is scored (m, u, v, uu, uv, vv).
_RIDGE = "1 - (vv - 2 * a * v - 2 * b * uv + m * a * a + 2 * a * b * u + b * b * uu) / (vv - v * v / m)"
_LINE = "(xy - x * y / n) * n / (xx - x * x / n) / (n + p) AS b"


def _ridge_sql(pairs: str) -> str:
    """o and i: the outer fold and the fold that is scored by all but these two; equal for the outer score itself."""
    return f"""t AS (SELECT o, i, p, n, x, y, xx, xy, n2 AS m, u, v, uu, uv, vv, {_LINE} FROM (SELECT a.fold AS o, b.fold AS i, p, sum(c.n) AS n, sum(c.sx) AS x, sum(c.sy) AS y, sum(c.sxx) AS xx, sum(c.sxy) AS xy,
any_value(b.n) AS n2, any_value(b.sx) AS u, any_value(b.sy) AS v, any_value(b.sxx) AS uu, any_value(b.sxy) AS uv, any_value(b.syy) AS vv FROM f a, f b, f c, p WHERE {pairs} AND c.fold <> a.fold AND c.fold <> b.fold GROUP BY ALL)),
r AS (SELECT o, i, p, {_RIDGE} AS r2 FROM (SELECT *, (y - b * x) / n AS a FROM t))"""


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("fold"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(f"WITH {_FOLDS}, {_ridge_sql('a.fold = b.fold')} SELECT p AS penalty, o AS fold, round(r2, 5) + 0.0 AS r2 FROM r")
def ridge_penalties(spark, d):
    return MO.ridge_scores(_folds(spark, d), "fold", ["x"], "y", [0.0, 1000.0, 20000.0]).select("penalty", "fold", (F.round("r2", 5) + 0.0).alias("r2"))


@query(f"""WITH {_FOLDS}, {_ridge_sql('true')}, q AS (SELECT o, p, avg(r2) AS inner_r2, row_number() OVER (PARTITION BY o ORDER BY avg(r2) DESC, p) AS nth FROM r WHERE o <> i GROUP BY o, p)
SELECT q.o AS fold, q.p AS penalty, round(inner_r2, 5) + 0.0 AS inner_r2, round(r2, 5) + 0.0 AS r2 FROM q JOIN r ON q.o = r.o AND r.i = r.o AND q.p = r.p WHERE nth = 1""")
def nested_ridge(spark, d):
    out = MO.nested_ridge(_folds(spark, d), "fold", ["x"], "y", [0.0, 1000.0, 20000.0])
    return out.select("fold", "penalty", *[(F.round(c, 5) + 0.0).alias(c) for c in ("inner_r2", "r2")])


@query("SELECT i::INTEGER AS \"group\", (SELECT count(*) FROM embeddings) // 7 + CASE WHEN i < (SELECT count(*) FROM embeddings) % 7 THEN 1 ELSE 0 END AS n FROM range(7) t(i)")
def balanced_sizes(spark, d):
    """The sizes that centres have room for; which rows they are is beyond SQL, and tested."""
    from ..operators.learning import balanced_groups

    return balanced_groups(points(spark, d), "id", "lon", "lat", 7).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query()
def contiguity_groups(spark, d):
    """Without SQL: merging is a loop; tested against one merge at a time. The cells that hold points, in six groups of neighbours."""
    from ..operators.learning import contiguity_groups as groups

    squares = _squares(spark, d)
    units = G.centroid(squares).select(F.col("pid").alias("id"), "x", "y")
    return groups(units, G.contiguity(squares, "rook").withColumnRenamed("pid", "id"), 6)


# ---- space

@query(f"WITH {_POINTS}, {_EDGES}, i AS (SELECT id FROM pt, e GROUP BY id, pid, lat, lon HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1), "
       "m AS (SELECT id, min(sqrt(power(lon - x1 - t * (x2 - x1), 2) + power(lat - y1 - t * (y2 - y1), 2))) AS d FROM (SELECT *, least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) AS t FROM pt, e) GROUP BY id) SELECT id FROM m WHERE d < 5 OR id IN (SELECT id FROM i)")
def points_in_buffer(spark, d):
    return G.within_buffer(points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), polygons(spark), 5.0)


@query(f"WITH {_POINTS} SELECT id, round(lat, 7) + 0.0 AS lat, round(lon, 7) + 0.0 AS lon, true AS in_zone FROM pt")
def utm_round_trip(spark, d):
    """To UTM and back; the easting is that of a point in its zone."""
    p = points(spark, d).withColumn("zone", S.utm_zone(F.col("lon")))
    east, north = S.to_utm(F.col("lat"), F.col("lon"))
    p = p.select("id", "lat", "zone", east.alias("east"), north.alias("north"))
    lat, lon = S.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return p.select("id", (F.round(lat, 7) + 0.0).alias("lat"), (F.round(lon, 7) + 0.0).alias("lon"), F.col("east").between(166_000, 834_000).alias("in_zone"))


@query("SELECT DISTINCT label::BIGINT AS pid, true AS inside FROM embeddings")
def interior_points(spark, d):
    stars = _stars(spark, d)
    p = G.representative_point(stars)
    found = G.points_in_polygons(p.select(F.col("pid").alias("id"), "x", "y"), stars, 2.0).where("id = pid").select("pid", F.lit(True).alias("hit"))
    return p.select("pid").join(found, "pid", "left").select("pid", F.coalesce("hit", F.lit(False)).alias("inside"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """The cells of five degrees that hold points, as squares; a number for each place."""
    r, c = F.floor(F.col("lat") / 5), F.floor(F.col("lon") / 5)
    cells = points(spark, d).select(r.alias("r"), c.alias("c")).distinct()
    corner = lambda i, j: F.struct(((F.col("c") + i) * 5.0).alias("x"), ((F.col("r") + j) * 5.0).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return cells.select((F.col("r") * 1000 + F.col("c")).alias("pid"), F.array(ring).alias("rings"))


@query(f"""WITH {_POINTS}, c AS (SELECT DISTINCT CAST(floor(lat / 5) AS BIGINT) AS r, CAST(floor(lon / 5) AS BIGINT) AS c FROM pt) SELECT k AS kind, 1000 * a.r + a.c AS pid, 1000 * b.r + b.c AS neighbour FROM c a, c b, (SELECT unnest(['queen', 'rook']) AS k)
WHERE (a.r, a.c) <> (b.r, b.c) AND CASE WHEN k = 'queen' THEN abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 ELSE abs(a.r - b.r) + abs(a.c - b.c) = 1 END""")
def contiguity(spark, d):
    kinds = [G.contiguity(_squares(spark, d), k).withColumn("kind", F.lit(k)) for k in ("queen", "rook")]
    return kinds[0].unionByName(kinds[1])


@query(f"WITH {_POINTS} SELECT id, CASE WHEN lon >= -50 AND lon < 50 AND lat >= -20 AND lat < 20 THEN CASE WHEN lon < 0 THEN 1000 + 10 * floor((lat + 20) / 5) + floor((lon + 50) / 5) ELSE 2000 + 10 * floor((lat + 20) / 5) + floor(lon / 5) END END::DOUBLE AS elev FROM pt")
def raster_samples(spark, d):
    cells = [(t, x0, -20.0, r, c, t * 1000.0 + 10 * r + c) for t, x0 in ((1, -50.0), (2, 0.0)) for r in range(8) for c in range(10)]
    raster = spark.createDataFrame(cells, "tile bigint, x0 double, y0 double, row bigint, col bigint, elev double")
    return G.sample_raster(points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), raster, 5.0)


_GRID = "g AS (SELECT l_returnflag AS t, l_linenumber AS r, CAST(l_quantity AS BIGINT) AS c, count(*)::DOUBLE AS e FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_GRID}, n AS (SELECT *, lag(e) OVER a AS w, lead(e) OVER a AS o, lag(e) OVER u AS s, lead(e) OVER u AS n FROM g WINDOW a AS (PARTITION BY t, r ORDER BY c), u AS (PARTITION BY t, c ORDER BY r)),
k AS (SELECT t, r, c, CASE WHEN w IS NULL THEN o - e WHEN o IS NULL THEN e - w ELSE (o - w) / 2 END / (0.001 * 111320.0 * cos(radians(40.0 + r))) AS dx, CASE WHEN s IS NULL THEN n - e WHEN n IS NULL THEN e - s ELSE (n - s) / 2 END / (0.001 * 111320.0) AS dy FROM n)
SELECT t AS tile, r AS "row", c AS col, round(degrees(atan(sqrt(power(dx, 2) + power(dy, 2)))), 6) AS slope FROM k""")
def slopes(spark, d):
    """A raster of counts: a tile a flag, a row a line number, a column a quantity."""
    grid = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tile"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("bigint").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("elev"))
    return G.slope_degrees(grid.withColumn("lat", 40.0 + F.col("row")), 0.001).select("tile", "row", "col", r6("slope", "slope"))


_STARS = f"""{_POINTS}, v AS (SELECT label AS pid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, 8 + abs(embedding[3]::DOUBLE) * 40 AS rad FROM embeddings),
w AS (SELECT pid, k, n, (pid - 5) * 8 + rad * cos(2 * pi() * k / n) AS x, (pid - 5) * 4 + rad * sin(2 * pi() * k / n) AS y FROM v),
e AS (SELECT a.pid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM w a JOIN w b ON a.pid = b.pid AND b.k = (a.k + 1) % a.n)"""


def _stars(spark: SparkSession, d: str) -> DataFrame:
    """A polygon for each label, with a vertex for each of its vectors, in turn around a centre."""
    e = read(spark, d, "embeddings").select(F.col("label").alias("pid"), "vec_id", (8 + F.abs(F.col("embedding")[2].cast("double")) * 40).alias("rad"))
    turn = F.array_sort(F.collect_list(F.struct("vec_id", "rad")))  # a ring is one value of its polygon
    angle = lambda i: 2 * math.pi * i / F.size("turn")
    ring = F.transform("turn", lambda v, i: F.struct(((F.col("pid") - 5) * 8 + v["rad"] * F.cos(angle(i))).alias("x"), ((F.col("pid") - 5) * 4 + v["rad"] * F.sin(angle(i))).alias("y")))
    return e.groupBy("pid").agg(turn.alias("turn")).select(F.col("pid").cast("bigint").alias("pid"), F.array(ring).alias("rings"))


@query(f"""WITH {_STARS} SELECT id, pid::BIGINT AS pid FROM pt, e GROUP BY id, pid, lat, lon HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1""")
def points_in_stars(spark, d):
    return G.points_in_polygons(points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), _stars(spark, d))


@query(f"WITH {_POINTS}, d AS (SELECT a.id, b.id AS id2, 2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) AS d FROM pt a, pt b WHERE a.id % 10 = 0) SELECT id, id2, round(d, 1) AS distance, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, id2) AS n FROM d) WHERE n <= 3")
def nearest_by_reach(spark, d):
    p = points(spark, d)
    return G.nearest(p.where("id % 10 = 0"), p, 3, most_stated=0).select("id", "id2", F.round("distance", 1).alias("distance"), "rank")




# ---- summaries

@query("""SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 2) AS total, count(*) AS count, round(count(*) FILTER (WHERE c_acctbal > 0) / count(*)::DOUBLE, 3) AS match_rate FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1""")
def group_rates(spark, d):
    keyed = read(spark, d, "customer").withColumn("k", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")))
    out = A.group_rates(keyed, "k", "c_acctbal", F.col("c_acctbal") > 0)
    return out.select("k", F.round("c_acctbal_mean", 4).alias("mean"), F.round("c_acctbal_sum", 2).alias("total"), "count", "match_rate")


@query("""WITH b AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS z FROM customer), c AS (SELECT least(floor((c_acctbal - a) / ((z - a) / 20)), 19)::INTEGER AS bin, count(*) AS n FROM customer, b WHERE c_acctbal < 2000 OR c_acctbal = z GROUP BY 1)
SELECT i::INTEGER AS bin, round(a + (z - a) / 20 * i, 4) AS lo, round(a + (z - a) / 20 * (i + 1), 4) AS hi, coalesce(n, 0) AS n FROM range(20) t(i), b LEFT JOIN c ON i = bin""")
def histogram_with_gaps(spark, d):
    c = read(spark, d, "customer")
    top = c.agg(F.max("c_acctbal").alias("top"))
    some = c.crossJoin(top).where((F.col("c_acctbal") < 2000) | (F.col("c_acctbal") == F.col("top")))
    return A.histogram(some, "c_acctbal", 20).select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


@query("""SELECT column_name, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max
FROM (SELECT 'p_size' AS column_name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY 1""")
def described_columns(spark, d):
    out = A.describe(read(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.select("column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query(f"WITH {_POINTS}, g AS (SELECT r, c FROM range(-4, 4) a(r), range(-9, 9) b(c)), s AS (SELECT floor(lat / 10) AS r, floor(lon / 10) AS c, sum(id) AS v FROM pt GROUP BY ALL) SELECT g.r::BIGINT AS r, g.c::BIGINT AS c, coalesce(v, 0)::BIGINT AS v FROM g LEFT JOIN s ON g.r = s.r AND g.c = s.c")
def cell_sums(spark, d):
    cells = points(spark, d).select(F.floor(F.col("lat") / 10).alias("r"), F.floor(F.col("lon") / 10).alias("c"), F.col("id").alias("v"))
    grid = spark.range(-4, 4).withColumnRenamed("id", "r").crossJoin(spark.range(-9, 9).withColumnRenamed("id", "c"))
    return A.cell_sums(cells, grid, ["r", "c"], "v")


@query("SELECT r_name, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, r_name) AS place FROM region")
def registry_order(spark, d):
    return K.surrogate_key(read(spark, d, "region").select("r_name"), "place", A.registry_place("r_name", ["EUROPE", "ASIA"]))
