from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from lodestar.functions import texts as T
from lodestar.operators import linkage as L, quality as Q
from lodestar.sources import io, synthetic


def test_hashes_find_changes(spark, tmp_path):
    for side, more in (("a", "x"), ("b", "y")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "same.txt").write_text("1")
        (tmp_path / side / "other.txt").write_text(more)
    (tmp_path / "b" / "new.txt").write_text("n")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    a, b = (io.file_hashes(spark, f"{tmp_path}/{s}").withColumn("path", name) for s in "ab")
    assert {r.path: r.status for r in Q.manifest_diff(a, b).collect()} == {"same.txt": "same", "other.txt": "changed", "new.txt": "right_only"}
    assert io.file_table(spark, str(tmp_path)).count() == 5


def test_diagnostics_round_trip(spark, tmp_path):
    io.save_diagnostic(spark.createDataFrame([(1, "a")], "n int, v string"), str(tmp_path), "run", "sub")
    assert [tuple(r) for r in io.load_diagnostic(spark, str(tmp_path), "run", "sub").collect()] == [(1, "a")]


def test_docx_comments(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/comments.xml", f'<w:comments {ns}><w:comment w:author="Ann"><w:p><w:r><w:t>Why?</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("word/document.xml", f'<w:document {ns}><w:del w:author="Bo"><w:r><w:delText>old</w:delText></w:r></w:del></w:document>')
    got = io.load_docx_comments(spark, str(tmp_path)).collect()
    assert {(r.kind, r.author, r.text) for r in got} == {("comment", "Ann", "Why?"), ("deletion", "Bo", "old")}


def test_trackers_and_diffs(spark):
    major = "### Comment 1: One\n**Status**: [VALID - ACTION NEEDED]\n**Concern**:\n> first\n\nmore\n**Response**:\ndone\n**Files Modified**:\n- `a.py`\n---\nno field\n### Two\n**Status**: invalid\n- [x] a\n- [ ] b\n"
    text = f"# T\n## Overview\n### None\n## Major Comments\n{major}## Minor Comments\n### Minor 1: Three\n**Reviewer's Concern**:\nx"
    got = T.tracker_comments(spark.createDataFrame([("k", text), ("n", None)], "k string, t string"), "k", "t").collect()
    want = [("M1", "major", 1, "One", "VALID - ACTION NEEDED", "first\nmore", "done", ["a.py"]), ("M2", "major", 2, "Two", "INVALID", "", "", []), ("M1", "minor", 1, "Three", "PENDING", "x", "", [])]
    assert [(r.id, r.section, r.number, r.title, r.status, r.concern, r.response, r.files) for r in got] == want
    assert [(r.line_start, r.line_end) for r in got] == [(5, 14), (17, None), (22, 24)]
    row = spark.createDataFrame([(text, "---\ntitle: 'A b'\nyear: 3\nyear: 4\n---\nx")], "t string, y string").select(T.checklist(F.col("t"))[0].alias("done"), T.checklist(F.col("t"))[1].alias("open"), T.front_matter(F.col("y")).alias("m"), T.unified_diff(F.lit("a\nb"), F.lit("a\nc")).alias("d")).first()
    assert (row.done, row.open, row.m) == (1, 1, {"title": "A b", "year": "4"}) and "-b\n+c" in row.d


def test_updates_and_patterns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    out = L.update_members(df, "id", "v", spark.createDataFrame([(2, None), (3, "z")], "id int, n string"), "n")
    assert {r.id: r.v for r in out.collect()} == {1: "a", 2: None, 3: "z"}
    assert L.pattern_filter(df, "v", "^b|c").count() == 1
    assert synthetic.event_study(spark).where("event_time = 5").count() == 25


def test_manuscript_diff_and_paths(spark):
    files = spark.createDataFrame([("a.qmd", "x\ny", "x\nz"), ("b.qmd", None, "n" * 600), ("c.qmd", "old", ""), ("d.qmd", "same", "same")], "name string, old string, new string")
    report = T.markdown_diff(files, "name", "old", "new").first().report
    assert report.startswith("# Manuscript Changes\n\n## a.qmd\n```diff\n") and "-y\n+z" in report and "## b.qmd (NEW FILE)" in report and "... (truncated)" in report and "## c.qmd (DELETED)" in report and "d.qmd" not in report
    assert T.markdown_diff(files.where("name = 'd.qmd'"), "name", "old", "new").first().report == "# Manuscript Changes\n\nNo changes detected.\n"
    row = spark.range(1).select(T.set_paths(F.create_map(F.lit("a.b"), F.lit("1"), F.lit("c"), F.lit("2")), F.create_map(F.lit("a.b"), F.lit("3"), F.lit("c"), F.lit(""), F.lit("d"), F.lit("4"))).alias("m")).first()
    assert row.m == {"a.b": "3", "c": "2", "d": "4"}
    figures = spark.createDataFrame([("f/a.PNG",), ("f/b.gif",)], "path string")
    assert {r.path: r.passed for r in T.figure_formats(figures, "path", ["png", "pdf"]).collect()} == {"f/a.PNG": True, "f/b.gif": False}
    texts = spark.createDataFrame([("bibliography: x @a @b",), ("bibliography: x",), ("see @a",), ("",)], "t string").select(T.bibliography(F.col("t")).alias("b")).select("b.*").collect()
    assert [r.passed for r in texts] == [True, True, False, False] and texts[0].message.endswith("2 citations found")


def test_quality_reports(spark, tmp_path):
    from lodestar.operators import quality as Q

    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id int, v string")
    results = Q.validate(df, [*Q.input_rules(df), Q.no_duplicates(df), Q.Rule("odd", F.sum("v") + F.col("nope"), "warning")]).collect()
    assert [(r.rule, r.n_failures, r.passed) for r in results] == [("row_count", 3, True), ("no_missing_values", 1, False), ("no_duplicate_rows", 1, False), ("odd", None, False)]
    assert {k: v for k, v in Q.as_dict(results).items() if k != "results"} == {"passed": False, "n_errors": 2, "n_warnings": 1}
    path = Q.save_report(Q.table_metrics(df), str(tmp_path), "s00_ingest", "20240131_120000")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["metric", "value", "stage", "timestamp"] and {r.metric: r.value for r in back.collect()}["duplicate_rows"] == "1"
    empty = Q.table_metrics(df.limit(0)).first()
    assert (empty.n_rows, empty.missing_pct, empty.duplicate_rows) == (0, 0.0, 0)


def test_trackers_are_dealt_out_once(spark):
    """One exchange, by a given number of tasks, which are not joined by the packed size of what they read."""
    rows = [(str(i), f"## Major Comments\n### T {i}\n**Concern**: x\nsaid\n") for i in range(5)] * 2
    df = T.tracker_comments(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted(r["title"] for r in df.collect()) == sorted(f"T {i}" for i in range(5) for _ in range(2))
