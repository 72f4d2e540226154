"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_folder, table


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_weights

    docs = table(spark, sf_dir, "documents")
    return mix_to_weights(docs, carry=False).select("doc_id", "size", "source_size", "target", "taken")


SQL_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * total / w AS ratio,
         coalesce(sum(2.0::DOUBLE * total) OVER p, 0) AS filled, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER p, 0) AS rest,
         (SELECT CAST(1.5 AS DOUBLE) * sum(total) FROM s) AS budget
  FROM s WINDOW p AS (ORDER BY 2.0::DOUBLE * total / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (budget - filled) / rest AS level FROM f WHERE (budget - filled) / rest <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, total, CASE WHEN level > ratio THEN 2.0::DOUBLE * total ELSE level * w END AS target FROM f, l),
q AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, q.total, q.target, q.whole, q.target - q.whole * q.total AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN budget > 0 AND 2 * upto - tied <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")


SQL_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, (SELECT unnest([5, 10, 61]) AS k) WHERE len(w) >= k),
h AS (SELECT doc_id, k, s, md5(array_to_string(w[s:s + k - 1], ' ')) AS h FROM v),
c AS (SELECT doc_id, k, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS n FROM h) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, k, s + i AS pos FROM c, range(61) t(i) WHERE i < k),
r AS (SELECT doc_id, count(*) FILTER (WHERE k = 5) AS five, count(*) FILTER (WHERE k = 10) AS ten, count(*) FILTER (WHERE k = 61) AS long FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(five, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(ten, 0) AS BIGINT) AS repeat_words, coalesce(long, 0) AS long
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * repeat_words <= 15 * n_words AND long = 0 AS kept
FROM m
"""


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"))


SQL_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM v),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM h),
g AS (SELECT DISTINCT doc_id, s + k AS pos FROM r, (SELECT unnest(range(0, 20)) AS k) WHERE nth > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = x.doc_id AND g.pos = x.pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotraining import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85).drop("n_links")


SQL_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s, w FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 2], ' ')) AS g FROM v),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = c.doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


SQL_OP2 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
m AS (
  SELECT doc_id, pos, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l WHERE trim(line, ' ') <> ''),
t AS (
  SELECT *, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n,
         array_to_string(string_split(masked, ' ')[1:3], ' ') AS head FROM m),
f AS (SELECT * FROM t JOIN (SELECT n, head FROM t GROUP BY n, head HAVING count(DISTINCT doc_id) >= 10) USING (n, head)),
e AS (SELECT n, masked FROM f GROUP BY n, masked HAVING count(DISTINCT doc_id) >= 10),
same AS (SELECT doc_id, pos, 'e ' || masked AS template FROM f JOIN e USING (n, masked)),
o AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.n = f.n AND e.masked = f.masked)),
p AS (SELECT doc_id, pos, n, head, unnest(tokens) AS token, unnest(range(0, n)) AS i FROM o),
c AS (SELECT n, head, i, token, count(*) AS k FROM p GROUP BY ALL),
g AS (SELECT n, head, count(*) AS total FROM o GROUP BY ALL),
k AS (SELECT n, head, i, token FROM c JOIN g USING (n, head) WHERE 2 * k > total),
a AS (
  SELECT p.doc_id, p.pos, p.n, p.head FROM p JOIN k ON p.n = k.n AND p.head = k.head AND p.i = k.i AND p.token = k.token
  GROUP BY ALL HAVING count(*) >= 0.7 * p.n),
r AS (SELECT n, head FROM a GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
h AS (SELECT * FROM same UNION ALL SELECT doc_id, pos, 'l ' || n || ' ' || head FROM a JOIN r USING (n, head)),
x AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS nth FROM h) WHERE nth > 1),
w AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS left_
  FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND x.pos = l.pos) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(left_, 0) AS BIGINT) AS n_dropped, coalesce(w.text, '') AS text
FROM d LEFT JOIN w USING (doc_id)
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import match_items

    return match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_string_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_strings

    return remove_repeated_strings(table(spark, sf_dir, "documents"))


SQL_OP5 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
n AS (SELECT doc_id, hx, CAST(len(hx) // 2 AS BIGINT) AS n FROM d),
v AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, hx FROM n WHERE n >= 100),
h AS (SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 200)) AS h FROM v),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM h),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE nth > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
j AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM j),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(n.hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM e JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
"""


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import backoff_scores

    out = backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_full", F.round("score", 5).alias("score"), F.round("mean_score", 6).alias("mean_score"))


SQL_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS w0 FROM d),
l AS (SELECT *, lag(w0) OVER p AS w1, lag(w0, 2) OVER p AS w2 FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w0) - count(*) OVER (PARTITION BY doc_id, w0) AS c1,
         CASE WHEN w1 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w1, w0) - count(*) OVER (PARTITION BY doc_id, w1, w0) END AS c2,
         CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2, w1, w0) - count(*) OVER (PARTITION BY doc_id, w2, w1, w0) END AS c3,
         greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS n, least(pos, 3) AS k
  FROM l),
b AS (SELECT *, lag(c1) OVER p AS b1, lag(c2) OVER p AS b2 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
s AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS found, k,
         CASE WHEN c3 > 0 THEN ln(c3) - ln(b2) WHEN c2 > 0 THEN (k - 2) * ln(0.4) + ln(c2) - ln(b1)
              WHEN c1 > 0 THEN (k - 1) * ln(0.4) + ln(c1) - ln(n) ELSE k * ln(0.4) - ln(n) END AS v
  FROM b),
t AS (SELECT doc_id, sum(v) AS score, count(*) FILTER (WHERE found = k) AS n_full FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_full, 0) AS BIGINT) AS n_full, round(coalesce(score, 0), 5) AS score,
       round(coalesce(score, 0) / greatest(len(w), 1), 6) AS mean_score
FROM d LEFT JOIN t USING (doc_id)
"""


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    out = archived(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP11 = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       translate(array_to_string(list_transform(range(0, 8), lambda i: to_base(CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT), 32, 4)), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resample

    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL_OP12 = r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS t),
w AS (
  SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
x AS (SELECT kind, doc_id, unnest(ws) AS word FROM w),
u AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM x)),
c AS (
  SELECT word, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                               lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM u, tab),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 's') AS s, count(*) FILTER (WHERE kind = 't') AS t FROM x JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM n),
v AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN c USING (word) JOIN g USING (bucket) WHERE kind = 's' GROUP BY doc_id),
r AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN v USING (doc_id) WHERE kind = 's'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM z LEFT JOIN k USING (doc_id)
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings"))


#: An assignment takes the least of distance * 64 + entry, which settles ties.
_NEAREST = "SELECT v.vec_id, v.p, any_value(v.x) AS x, min(64 * list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) + c.e) AS m FROM v JOIN {c} c ON v.p = c.p GROUP BY v.vec_id, v.p"
_MEANS = "SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM {c} c LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS x FROM (SELECT p, m % 64 AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS y FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM {a}) GROUP BY ALL) GROUP BY p, e) n USING (p, e)"
SQL_OP13 = rf"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, nth, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM k, (SELECT unnest(range(0, 16)) AS p)),
c0 AS MATERIALIZED (SELECT p, nth AS e, x FROM v WHERE nth < 64),
a0 AS MATERIALIZED ({_NEAREST.format(c="c0")}),
c1 AS MATERIALIZED ({_MEANS.format(c="c0", a="a0")}),
a1 AS MATERIALIZED ({_NEAREST.format(c="c1")}),
c2 AS MATERIALIZED ({_MEANS.format(c="c1", a="a1")}),
a2 AS MATERIALIZED ({_NEAREST.format(c="c2")}),
e AS (SELECT vec_id, string_agg(lpad(lower(to_base(CAST(m % 64 AS BIGINT), 16)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_string_dedup": op5_string_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_near_dedup": op7_near_dedup,
    "op8_window_dedup": op8_window_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_main_text": op10_main_text,
    "op11_warc_revisits": op11_warc_revisits,
    "op12_importance_resample": op12_importance_resample,
    "op13_vector_codes": op13_vector_codes,
}
SQL: dict[str, str] = {"op1_lm_score": SQL_OP1, "op2_line_dedup": SQL_OP2, "op5_string_dedup": SQL_OP5, "op6_source_mix": SQL_OP6, "op7_near_dedup": SQL_OP7, "op8_window_dedup": SQL_OP8, "op9_quality_rules": SQL_OP9, "op11_warc_revisits": SQL_OP11, "op12_importance_resample": SQL_OP12, "op13_vector_codes": SQL_OP13}
