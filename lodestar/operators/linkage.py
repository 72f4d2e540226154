"""Exact and fuzzy record linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import similarity


def exact_match(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "left", suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Joins on keys where null equals null; other columns of both sides get suffixes where names clash.

    The keys appear once under the left names; ``_merge`` says where a row came from: both, left_only, right_only.
    """
    right_on = right_on or left_on
    lo, ro = [c for c in left.columns if c not in left_on], [c for c in right.columns if c not in right_on]
    clash = set(lo) & set(ro)
    a = left.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left_on)], *[F.col(c).alias(c + suffixes[0] * (c in clash)) for c in lo], F.lit(True).alias("_in_left"))
    b = right.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(right_on)], *[F.col(c).alias(c + suffixes[1] * (c in clash)) for c in ro], F.lit(True).alias("_in_right"))
    on = F.lit(True)
    for i in range(len(left_on)):
        on = on & F.col(f"l{i}").eqNullSafe(F.col(f"r{i}"))
    out = a.join(b, on, "full" if how == "outer" else how)
    merge = F.when(F.col("_in_left") & F.col("_in_right"), "both").when(F.col("_in_left"), "left_only").otherwise("right_only")
    values = [F.when(F.col("_in_left"), F.col(f"l{i}")).otherwise(F.col(f"r{i}")).alias(c) for i, c in enumerate(left_on)]
    return out.select(*values, *[c + suffixes[0] * (c in clash) for c in lo], *[c + suffixes[1] * (c in clash) for c in ro], merge.alias("_merge"))


def match_statistics(matched: DataFrame, left_keys: list[str] | None = None, how: str = "left", n_left: int | None = None) -> DataFrame:
    """Row counts after fan-out, and with keys the number of distinct left keys that matched.

    With an inner or outer join and the number of left rows given, every output row counts as matched and what is
    missing to the left rows as unmatched, which a fan-out can make negative.
    """
    both = F.col("_merge") == "both"
    more = [F.countDistinct(F.when(both, F.struct(*left_keys))).alias("matched_keys")] if left_keys else []
    rows = F.count(F.lit(1))
    if how in ("inner", "outer") and n_left is not None:
        hits, misses = rows, F.lit(n_left) - rows
    else:
        hits, misses = F.count_if(both), F.count_if(F.col("_merge") == "left_only")
    return matched.agg(rows.alias("n_rows"), hits.alias("n_matched"), misses.alias("n_unmatched"), F.try_divide(hits, rows).alias("match_rate"), *more)


def _pieces(x: Column, budget: Column) -> Column:
    """A string cut into one piece more than the budget of edits: (piece number, begin, piece), of equal lengths but one."""
    n = F.length(x)
    cut = lambda i: F.floor(n * i / (budget + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), budget), lambda i: F.struct(i.alias("i"), cut(i).alias("a"), F.substring(x, cut(i) + 1, cut(i + 1) - cut(i)).alias("p")))


def _levenshtein_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs of values that can reach the threshold, without meeting all others.

    Within a budget of e edits one of e + 1 pieces of the left value stays as it is in the right one, moved by e places
    at most (pigeonhole). The budget follows from the longest right value that can be meant, so nothing is lost.
    """
    low = lambda c: F.lower(F.col(c))
    size = F.length("left_value")
    longest = F.floor(size / F.lit(max(threshold, 1e-9)) + 1e-9)
    edits = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    left = a.withColumn("e", edits).withColumn("x", low("left_value"))
    few = left.where(size > F.col("e"))  # each piece has a letter
    pieces = few.select("left_value", "e", F.explode(_pieces(F.col("x"), F.col("e"))).alias("c")).select("left_value", "e", "c.a", "c.p", F.length("c.p").alias("n"))
    lengths = pieces.select("n", "e").distinct().groupBy("n").agg(F.max("e").alias("most"))
    y = b.withColumn("y", low("right_value"))
    grams = y.crossJoin(F.broadcast(lengths))  # a row for each length of piece, at most as many as letters
    grams = grams.where(F.length("y") >= F.col("n")).select("right_value", "ordinal", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("y") - F.col("n") + 1), lambda i: F.substring(F.col("y"), i, F.col("n")))).alias("at", "q"))
    near = pieces.join(grams, (F.col("p") == F.col("q")) & (pieces["n"] == grams["n"]) & (F.abs(F.col("a") - F.col("at")) <= F.col("e")))
    found = near.select("left_value", "right_value", "ordinal").distinct()
    # values so short that a piece may be empty meet the short right values only
    rest = left.where(size <= F.col("e")).select("left_value")
    short = b.where(F.length("right_value") <= F.lit(int(2 / max(threshold, 1e-9)) + 2)) if threshold > 0.5 else b
    rest = rest.join(short, F.length("right_value") <= F.floor(F.length("left_value") / F.lit(max(threshold, 1e-9)) + 1e-9))
    return found.unionByName(rest.select("left_value", "right_value", "ordinal"))


#: Letters of the pieces by which values that contain others are found; shorter values are looked for as they are.
GRAM = 4
#: A side of at most so many rows goes to all tasks.
MOST_STATED = 10_000


def _contains_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of which the right value holds all pieces that count of the left one: its rarest piece among the right values.

    An index of the right values by pieces of the lengths that are asked for; a value with a piece that no right value
    has is dropped before it meets any.
    """
    cut = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))
    left = a.select("left_value", F.lower("left_value").alias("x")).where("x != ''").withColumn("n", F.least(F.length("x"), F.lit(GRAM)))
    pieces = left.select("left_value", "n", F.explode(F.array_distinct(cut("x", F.col("n")))).alias("p"))
    sizes = F.array(*[F.lit(i) for i in range(1, GRAM + 1)])
    right = b.withColumn("y", F.lower("right_value")).withColumn("m", F.explode(sizes)).where(F.length("y") >= F.col("m"))
    index = right.select("right_value", "ordinal", F.explode(F.array_distinct(cut("y", F.col("m")))).alias("p"))
    index = index.join(pieces.select("p").distinct(), "p", "left_semi")
    often = index.groupBy("p").agg(F.count(F.lit(1)).alias("often"))
    rarest = pieces.join(often, "p", "left").groupBy("left_value").agg(F.min_by("p", F.struct(F.coalesce("often", F.lit(0)), "p")).alias("p"))
    found = rarest.join(index, "p").select("left_value", "right_value", "ordinal")
    # the empty value is in all: the first of them is the best
    first = b.orderBy("ordinal", "right_value").limit(1)
    return found.unionByName(a.where("left_value = ''").select("left_value").crossJoin(F.broadcast(first)).select("left_value", "right_value", "ordinal"))


def _jaro_winkler_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs of values that can reach the threshold.

    With p letters alike at the beginning the similarity without them must be (t - p / 10) / (1 - p / 10). That needs
    enough common letters: of two sets of letters, numbered by occurrence and ordered from the rarest, the first so many
    must share one. So pairs meet by the first p letters, both lengths and one rare letter.
    """

    def letters(df: DataFrame, c: str) -> DataFrame:
        x = F.lower(F.col(c))
        each = F.transform(F.split(x, ""), lambda v: v)
        low = df.select(c, *[k for k in df.columns if k != c], x.alias("x"), F.length(x).alias("n"), F.filter(each, lambda v: v != "").alias("cs"))
        nth = lambda v, i: F.size(F.filter(F.slice("cs", F.lit(1), i + 1), lambda w: w == v))
        return low.where("n > 0").withColumn("tokens", F.transform("cs", lambda v, i: F.concat(v, nth(v, i).cast("string"))))

    left, right = letters(a.select("left_value"), "left_value"), letters(b, "right_value")
    both = left.select("tokens").unionByName(right.select("tokens"))
    ranks = F.broadcast(both.select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("often")))  # letters by occurrence

    def ordered(df: DataFrame, c: str, rest: list[str]) -> DataFrame:
        each = df.select(c, *rest, "x", "n", F.explode("tokens").alias("k")).join(ranks, "k")
        return each.groupBy(c, *rest, "x", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "k"))), lambda v: v["k"]).alias("ks"))  # the letters of one value

    def keyed(df: DataFrame, c: str, rest: list[str], own: str, other: str, lengths: DataFrame) -> DataFrame:
        """A row for each class of common beginnings, length of the other value and rare letter."""
        out = ordered(df, c, rest).withColumn("p", F.explode(F.array(*[F.lit(p) for p in range(5)]))).where(F.col("n") >= F.col("p"))
        jaro = (F.lit(threshold) - F.col("p") / 10.0) / (1 - F.col("p") / 10.0)
        met = out.join(F.broadcast(lengths), F.col("m") >= F.col("p"))  # as many rows as there are lengths
        need = F.greatest(F.lit(1), F.ceil((3 * jaro - 1) / (1 / F.col("n") + 1 / F.col("m")) - 1e-9))
        met = met.withColumn("need", need).where(F.col("need") <= F.least("n", "m"))
        first = F.slice("ks", F.lit(1), (F.col("n") - F.col("need") + 1).cast("int"))
        return met.select(c, *rest, "p", F.substring("x", F.lit(1), F.col("p")).alias("head"), F.col("n").alias(own), F.col("m").alias(other), F.explode(first).alias("k"))

    ln, rn = left.select(F.col("n").alias("m")).distinct(), right.select(F.col("n").alias("m")).distinct()
    near = keyed(left, "left_value", [], "ln", "rn", rn).join(keyed(right, "right_value", ["ordinal"], "rn", "ln", ln), ["p", "head", "ln", "rn", "k"])
    found = near.select("left_value", "right_value", "ordinal").distinct()
    empty = a.where("left_value = ''").select("left_value").join(b.where("right_value = ''"), F.lit(True))  # a value each at most
    return found.unionByName(empty.select("left_value", "right_value", "ordinal"))


def _stated_pairs(a: DataFrame, b: DataFrame, most_stated: int) -> DataFrame:
    """All pairs with a short list, which goes to all tasks."""
    if b.limit(most_stated + 1).count() > most_stated:
        raise ValueError(f"no way to find these pairs without meeting all: name a block, or state at most {most_stated} right values")
    return a.crossJoin(F.broadcast(b))


def fuzzy_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float = 0.8, method: str = "levenshtein", order: Column | None = None, block: tuple[Column, Column] | None = None, most_stated: int = MOST_STATED) -> DataFrame:
    """left_value, right_value, score: for each distinct left value the best right value at the threshold or above.

    Of equals the first in ``order`` wins, a column of the right side that says what came first; without one the
    smallest value does, as tables have no order. Levenshtein's similarity from a half on meets only values that share a
    piece, Jaro-Winkler's those that share a beginning, their lengths and a rare letter, containment those that hold the
    rarest piece, equality (any other method) equal ones. With a lower threshold every left value is held against a list
    of at most ``most_stated`` right values; with more, ``block`` must give a key for each side that both share, which
    changes the result.
    """
    a = left.where(F.col(left_on).isNotNull()).select(F.col(left_on).alias("left_value"), *([block[0].alias("bl")] if block else [])).distinct()
    b = right.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("right_value"), *([block[1].alias("br")] if block else [])).agg(F.min(order if order is not None else F.col(right_on)).alias("ordinal"))
    if block:
        pairs = a.join(b, F.col("bl") == F.col("br"))
    elif method == "levenshtein" and threshold >= 0.5:
        pairs = _levenshtein_pairs(a, b, threshold)
    elif method == "jaro_winkler" and threshold > 0:
        pairs = _jaro_winkler_pairs(a, b, threshold)
    elif method == "contains" and threshold > 0:
        pairs = _contains_pairs(a, b)
    elif method not in ("levenshtein", "jaro_winkler", "contains") and threshold > 0:
        pairs = a.join(b, F.col("left_value") == F.col("right_value"))
    else:
        pairs = _stated_pairs(a, b, most_stated)
    if method == "levenshtein":
        # a length difference alone can rule a pair out, before any distance is computed
        longest = F.greatest(F.length("left_value"), F.length("right_value"))
        pairs = pairs.where(longest - F.least(F.length("left_value"), F.length("right_value")) <= (1 - threshold) * longest + 1e-9)
    scored = pairs.withColumn("score", similarity(F.col("left_value"), F.col("right_value"), method)).where(F.col("score") >= threshold)
    top = W.partitionBy("left_value").orderBy(F.col("score").desc(), "ordinal", "right_value")
    return scored.withColumn("_n", F.row_number().over(top)).where("_n = 1").select("left_value", "right_value", "score")


def fuzzy_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, **params) -> DataFrame:
    """The left rows with the right rows of their best value; equal right values fan out."""
    best = fuzzy_match(left, right, left_on, right_on, **params).select(F.col("left_value"), F.col("right_value"))
    return left.join(best, left[left_on] == best["left_value"], "left").drop("left_value").join(right.withColumnRenamed(right_on, "_r"), F.col("right_value") == F.col("_r"), "left").drop("_r")


def linkage_summary(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row of statistics for each named source."""
    out = None
    for name, matched in steps:
        row = match_statistics(matched).select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no source")
    return out


def update_members(df: DataFrame, key: str, column: str, updates: DataFrame, value: str) -> DataFrame:
    """The column replaced by the value of the update with the same key, where there is one."""
    new = updates.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_hit")).dropDuplicates(["_k"])
    return df.join(new, df[key] == new["_k"], "left").withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).drop("_k", "_v", "_hit")


def pattern_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has the pattern; null has none."""
    return df.where(F.coalesce(F.col(column).rlike(pattern), F.lit(False)))
