"""Line dedup with a log-template tree, in DataFrame functions only.

Lines are parsed to a fixed depth: by their number of tokens, then by their
leading tokens, where a token with a digit counts as a variable field. Leaves
that few documents reach need no further work. In the others a line belongs to
the first of these templates that ``min_docs`` documents share:

1. the line itself, once its variable fields are masked;
2. the template of its leaf's majority: a position is constant if one token
   holds more than half of the leaf's lines, and a line must agree with
   ``similarity`` of all positions;
3. its frequent tokens: a token stays if ``min_docs`` documents hold it at this
   place of the leaf, else it is a field of any value. A field may have frequent
   values too, so the same is done with twice, four times ... that number, as
   long as ``constant`` of the positions stay, and the template with the most
   constants wins. So a leaf may hold many templates, found in one pass.

The first line of a template (by id, then by place) stays, its other lines are
dropped.

No text is shuffled but once by document; leaves and templates travel as
hashes and are counted with partial aggregation, so a line that a third of all
documents hold is one row a task; what is joined to lines is written before, so
that Spark can split the lines of a hot template over tasks. Work is linear in
the lines of a document.

Defined cases: a null text stays null and has no lines; blank lines are never
dropped; tokens are parted by single spaces; rows with equal id and text are
one document for the counts and are treated alike; null ids come first; an
empty table gives an empty result; very long texts are read whole; columns of
any other name are carried along, and a clashing name (``n_lines``,
``n_dropped``) is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

FIELD = "<*>"


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _masked_line(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)


def _leaf(line: Column, depth: int) -> Column:
    tokens = F.split(line, " ")
    head = [_masked(F.get(tokens, F.lit(i))) for i in range(depth)]
    return F.xxhash64(F.size(tokens), *head)


def _marks(at: Column) -> Column:
    """Sorted places as an array that is true at each of them, as long as it needs to be."""
    before = F.slice(F.concat(F.array(F.lit(-1)), at), F.lit(1), F.size(at))
    return F.flatten(F.zip_with(at, before, lambda x, p: F.concat(F.array_repeat(F.lit(False), x - p - 1), F.array(F.lit(True)))))


def _picked(lines: Column, at: Column, chosen: bool) -> Column:
    """The lines at the places, or the others."""
    pairs = F.zip_with(lines, _marks(at), lambda line, mark: F.struct(line.alias("line"), F.coalesce(mark, F.lit(False)).alias("mark")))
    return F.transform(F.filter(pairs, lambda x: x["mark"] if chosen else ~x["mark"]), lambda x: x["line"])


def _recurring(rows: DataFrame, name: str, min_docs: int) -> DataFrame:
    """The values of a column that ``min_docs`` documents have."""
    return stored(rows.select(name, "key").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs), "recurring").select(name)


def _majority(lines: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """Lines (key, id, at, template) that agree with the template of their leaf's majority."""
    total = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("total"))
    token = lines.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n"))
    common = token.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("top")).join(total, "leaf")
    constant = F.when(2 * F.col("top.n") > F.col("total"), F.col("top.token"))
    # a template has as many positions as each of its lines
    template = stored(common.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("pos", constant.alias("token")))).alias("t")).select("leaf", F.col("t.token").alias("t")), "templates")
    agree = F.size(F.filter(F.zip_with("tokens", "t", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    alike = stored(lines.join(template, "leaf").where(agree >= similarity * F.size("tokens")).select("key", "id", "at", F.col("leaf").alias("template")), "alike")
    return alike.join(_recurring(alike, "template", min_docs), "template")


def _frequent(lines: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """Lines (key, id, at, template) of the templates that frequent tokens make."""
    tokens = lines.select("key", "id", "at", "leaf", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    docs = tokens.select("leaf", "pos", "token", "key").distinct().groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    own = tokens.join(stored(docs, "tokens"), ["leaf", "pos", "token"]).groupBy("key", "id", "at", "leaf", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "docs"))).alias("own"))
    own = own.where(F.size("own") >= constant * F.col("size"))
    doublings = F.floor(F.log2(F.array_max("own.docs") / min_docs)).cast("int")
    level = F.explode(F.transform(F.sequence(F.lit(0), doublings), lambda k: F.filter("own", lambda x: x["docs"] >= F.lit(min_docs) * F.pow(F.lit(2.0), k)))).alias("stay")
    left = own.select("key", "id", "at", "leaf", "size", level).where(F.size("stay") >= constant * F.col("size"))
    found = stored(left.select("key", "id", "at", F.size("stay").alias("constants"), F.xxhash64("leaf", "stay.pos", "stay.token").alias("template")).distinct(), "found")
    best = found.join(_recurring(found, "template", min_docs), "template").groupBy("key", "id", "at").agg(F.max(F.struct("constants", "template")).alias("b"))
    return best.select("key", "id", "at", "b.template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents with the lines of recurring templates dropped from the text, and n_lines and n_dropped."""
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = _decided(docs, id_col, text_col, **params)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in rest], "n_lines", "n_dropped")


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = None, **params) -> DataFrame:
    """The same with the columns of the input and no others; ``n_chars``: a column with the length of the text, to keep true."""
    out = _decided(docs, id_col, text_col, **params)
    new = {text_col: F.col("text")}
    if n_chars in docs.columns:
        length = F.when(F.col("n_dropped") == 0, F.col(f"row.`{n_chars}`")).otherwise(F.length("text"))
        new[n_chars] = length.cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _decided(docs: DataFrame, id_col: str, text_col: str, min_docs: int = 10, depth: int = 3, similarity: float = 0.7, constant: float = 0.6) -> DataFrame:
    """row (a struct of all columns), text, n_lines and n_dropped of every document."""
    keyed = docs.select(F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    slim = keyed.select("key", "id", "text")
    leaves = slim.select("key", F.posexplode(lines).alias("at", "line")).where(F.trim("line") != "").select("key", "at", _leaf(F.col("line"), depth).alias("leaf"))
    often = _recurring(leaves, "leaf", min_docs)
    wanted = leaves.join(often, "leaf").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "leaf"))).alias("wanted"))  # at most the lines of a document

    # the lines of these leaves, with their masked text
    rows = slim.dropDuplicates(["key"]).join(wanted, "key")
    rows = rows.select("key", "id", F.explode(F.arrays_zip(F.col("wanted").alias("w"), _picked(lines, F.col("wanted.at"), True).alias("line"))).alias("x"))
    found = stored(rows.select("key", "id", F.col("x.w.at").alias("at"), F.col("x.w.leaf").alias("leaf"), _masked_line(F.col("x.line")).alias("masked")).withColumn("whole", F.xxhash64("leaf", "masked")), "lines")

    exact = _recurring(found, "whole", min_docs)
    same = found.join(exact, "whole").select("key", "id", "at", F.col("whole").alias("template"))
    other = stored(found.join(exact, "whole", "left_anti").select("key", "id", "at", "leaf", F.split("masked", " ").alias("tokens")), "others")
    main = stored(_majority(other, min_docs, similarity).select("key", "id", "at", "template"), "main")
    more = _frequent(other.join(main.select("key", "at"), ["key", "at"], "left_anti"), min_docs, constant)
    hits = stored(same.unionByName(main).unionByName(more), "hits")
    first = stored(hits.groupBy("template").agg(F.min(F.struct("id", "key", "at")).alias("first")), "first")
    gone = hits.join(first, "template").where(~F.struct("id", "key", "at").eqNullSafe(F.col("first"))).groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("gone"))

    out = keyed.drop("id").join(gone, "key", "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_picked(F.split("text", "\n", -1), F.col("gone"), False), "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    return out.select("row", text.alias("text"), count.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
