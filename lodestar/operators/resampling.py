"""Sweeps, jackknife, leave-group-out, bootstrap intervals, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import stored
from .candidates import Matching, filtered, profiles, sized_candidates
from .cleaning import surrogate_key
from .disaggregation import drawn_counts_by_seed, expected_probability, hash60, shares
from .metrics import all_metrics, prefix_sums
from .quantiles import quantiles


def nested_draw_counts(draws: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """size, entity, draw_count: the counts of the first so many draws of each record, all sizes from one set of draws."""
    sized = draws.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)]))).where(F.col("draw") < F.col("size"))
    return sized.groupBy("size", "entity").agg(F.count(F.lit(1)).alias("draw_count"))


def seed_sweep(records: DataFrame, entities: DataFrame, draws: int, seeds: Sequence[int], m: Matching = Matching()) -> DataFrame:
    """seed, entity, draw_count, of all seeds by one plan."""
    if not seeds:
        raise ValueError("no seed")
    return drawn_counts_by_seed(records, entities, draws, seeds, m)


METRICS = ("roc_auc", "pr_auc", "brier")


def score_metrics(scores: DataFrame, truth: DataFrame, keys: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, prevalence, roc_auc, pr_auc, brier of scores(keys, entity, probability) against truth(entity).

    ``by``: keys that the truth has too, where it differs between them. All configurations are scored by one job.
    """
    known = truth.select(*by, "entity", F.lit(1).alias("y")).distinct()
    marked = scores.join(known, ["entity", *by], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return all_metrics(marked, "probability", "y", keys)


def stability(metrics: DataFrame) -> DataFrame:
    """metric, mean, std (sample), min, max over the rows of a table of metrics."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def intervals(metrics: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """metric, lo, hi, mean, std: percentile intervals over replicates."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(lo)).alias("lo"), F.percentile("value", F.lit(hi)).alias("hi"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def size_metrics(draws: DataFrame, sizes: Sequence[int], truth: DataFrame) -> DataFrame:
    """size and its metrics: the draws of a size are the first so many of each record."""
    return count_metrics(nested_draw_counts(draws, sizes), truth, "size")


def count_metrics(counts: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key and its metrics from (key, entity, draw_count): an entity scores its share of the key's draws."""
    counts = stored(counts, "counts")  # read for the totals and for the shares
    totals = counts.groupBy(key).agg(F.sum("draw_count").alias("total"))
    scores = counts.join(F.broadcast(totals), key).select(key, "entity", (F.col("draw_count") / F.col("total")).alias("probability"))  # a row a key
    return score_metrics(scores, truth, (key,))


def seed_metrics(records: DataFrame, entities: DataFrame, draws: int, seeds: Sequence[int], truth: DataFrame, m: Matching = Matching()) -> DataFrame:
    """seed and its metrics."""
    return count_metrics(seed_sweep(records, entities, draws, seeds, m), truth, "seed")


def sweep_metrics(configurations: Sequence[tuple[str, DataFrame, DataFrame, Matching]], truth: DataFrame) -> DataFrame:
    """configuration and its metrics: each name has its records, entities and matching; all are scored together."""
    scores = None
    for name, records, entities, m in configurations:
        one = expected_probability(records, entities, m).select(F.lit(name).alias("configuration"), "entity", "probability")
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        raise ValueError("no configuration")
    return score_metrics(scores, truth, ("configuration",))


def truth_metrics(scores: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """key and its metrics: one set of scores against each of several truths (key, entity), such as buffers."""
    every = truths.select(key).distinct().crossJoin(scores)  # a few truths, and each is held against all scores
    return score_metrics(every, truths, (key,), (key,))


def areas_without(scores: DataFrame, moves: DataFrame, truth: DataFrame) -> DataFrame:
    """fold, n, prevalence, full, without, brier: the ROC area over all scores and with each fold's moves applied.

    ``scores``: entity, share. ``moves``: fold, entity, off (what the fold takes off the share), one row a fold and
    entity. Shares count in nine digits; an entity without any left is not scored. ``brier`` is that of the fold's
    shares over their sum. An index of the shares (how many true and other entities lie below each value) gives the
    pairs that every moved entity wins before and after; pairs of two moved entities are counted within the fold. So the
    rows are those of ``moves`` and of ``scores``, never a fold times all entities.
    """
    known = truth.select("entity", F.lit(1).alias("y")).distinct()
    shares = scores.select("entity", "share", F.round("share", 9).alias("old")).where("old > 0")
    every = stored(shares.join(known, "entity", "left").withColumn("y", F.coalesce("y", F.lit(0))), "shares")
    new = F.round(F.col("share") - F.col("off"), 9)
    moved = moves.join(every, "entity").withColumn("new", F.when(new > 0, new))
    p, n = F.col("y"), 1 - F.col("y")
    kept, x = F.col("new").isNotNull(), F.coalesce("new", F.lit(0.0))
    groups = moved.groupBy("fold", "y", "old", "new").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("share") * F.col("share")).alias("was2"), F.sum("share").alias("was1"), F.sum("off").alias("off"), F.sum(F.when(kept, F.pow(F.col("share") - F.col("off"), 2))).alias("is2"), F.sum(F.when(kept, F.col("share") - F.col("off"))).alias("is1"))
    groups = stored(groups, "moves")
    # the index: counts below each value that an entity has or comes to
    own = every.groupBy(F.col("old").alias("s")).agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    asked = groups.where(kept).select(F.col("new").alias("s"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")).distinct()
    index = prefix_sums(own.unionByName(asked).groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ("p", "n"))
    wins = F.col("below_n") + F.col("n") / 2.0  # of a true entity with this value over others
    losses = F.col("all_p") - F.col("below_p") - F.col("p") / 2.0  # of another to true ones
    index = stored(index.select("s", "p", wins.alias("wins"), losses.alias("losses"), "all_p", "all_n"), "index")
    total = index.agg(F.sum(F.col("p") * F.col("wins")).alias("u"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    sums = every.agg(F.sum("share").alias("t1"), F.sum(F.col("share") * F.col("share")).alias("t2"), F.sum(p * F.col("share")).alias("ty"))
    sides = F.explode(F.filter(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("s"))), lambda z: z["s"].isNotNull()))
    turned = groups.select("fold", "y", "k", sides.alias("z")).select("fold", "y", "k", "z.sign", "z.s")
    change = turned.join(index.select("s", "wins", "losses"), "s").groupBy("fold").agg(F.sum(F.col("sign") * F.col("k") * F.when(p == 1, F.col("wins")).otherwise(F.col("losses"))).alias("du"))
    # pairs within a fold: true at old or new values against others at old or new values
    at = lambda side, c: F.sum(F.when(F.col("sign") == side, F.col("k") * c).otherwise(0)).alias
    cells = turned.groupBy("fold", "s").agg(at(-1, p)("po"), at(1, p)("pn"), at(-1, n)("no"), at(1, n)("nn"))
    cells = prefix_sums(cells, ("no", "nn"), ("fold",))
    over = lambda c: F.col(f"below_{c}") + F.col(c) / 2.0
    pairs = cells.groupBy("fold").agg(F.sum((F.col("po") - F.col("pn")) * over("no") + (F.col("pn") - F.col("po")) * over("nn")).alias("pairs"))
    gone = groups.groupBy("fold").agg(
        F.sum(F.when(~kept, F.col("k") * p).otherwise(0)).alias("gone_p"),
        F.sum(F.when(~kept, F.col("k") * n).otherwise(0)).alias("gone_n"),
        F.sum(F.coalesce("is2", F.lit(0.0)) - F.col("was2")).alias("d2"),
        F.sum(F.coalesce("is1", F.lit(0.0)) - F.col("was1")).alias("d1"),
        F.sum(p * (F.coalesce("is1", F.lit(0.0)) - F.col("was1"))).alias("dy"),
    )
    out = gone.join(change, "fold").join(pairs, "fold").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(sums))  # one row each
    left_p, left_n = F.col("all_p") - F.col("gone_p"), F.col("all_n") - F.col("gone_n")
    area = lambda u, a, b: u / F.nullif((a * b).cast("double"), F.lit(0.0))
    t = F.col("t1") + F.col("d1")
    brier = ((F.col("t2") + F.col("d2")) / (t * t) - 2 * (F.col("ty") + F.col("dy")) / t + left_p) / (left_p + left_n)
    return out.select("fold", (left_p + left_n).alias("n"), (left_p / (left_p + left_n)).alias("prevalence"), area(F.col("u"), F.col("all_p"), F.col("all_n")).alias("full"), area(F.col("u") + F.col("du") + F.col("pairs"), left_p, left_n).alias("without"), brier.alias("brier"))


def influence(records: DataFrame, entities: DataFrame, truth: DataFrame, m: Matching = Matching()) -> DataFrame:
    """fold, n_records, full, without, influence: what leaving one record of the profile out does to the ROC area.

    Records of one profile have one influence, so there are as many folds as profiles, not as records. A fold's moves
    are the record's share off its candidates; the scale changes no order.
    """
    found = stored(sized_candidates(records, entities, m).select(F.to_json("profile").alias("fold"), "n_records", "entity", (1.0 / F.col("n")).alias("off")), "moves")
    out = areas_without(shares(records, entities, m), found.select("fold", "entity", "off"), truth)
    out = out.join(found.select("fold", "n_records").distinct(), "fold")
    return out.select("fold", "n_records", "full", "without", (F.col("full") - F.col("without")).alias("influence"))


def group_areas(group_shares: DataFrame, group: str, truth: DataFrame) -> DataFrame:
    """fold, n, prevalence, full, without, brier from (group, entity, share): what all records outside the group score."""
    each = stored(group_shares.groupBy(F.col(group).alias("fold"), "entity").agg(F.sum("share").alias("off")), "folds")
    every = each.groupBy("entity").agg(F.sum("off").alias("share"))
    return areas_without(every, each, truth)


def resample_draws(rows: DataFrame, order: str, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, row (from 0 in the order given): one row for each of n draws of n rows with replacement, for each replicate.

    Draw i of a replicate is row hash(seed, replicate, i) mod n, so any partitioning draws the same.
    """
    numbered = surrogate_key(rows.select(order), "i", [F.col(order)]).select((F.col("i") - 1).alias("i"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = numbered.repartition(n, "i")  # a number and its draws take few bytes until it is unfolded, so the default is one task for all
    drawn = numbered.crossJoin(total).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return drawn.select("replicate", F.pmod(hash60(F.lit(seed), F.col("replicate"), F.col("i")), "n").alias("row"))


def resample_counts(rows: DataFrame, order: str, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, row, times: how often each row is drawn, of those that are, as of ``resample_draws``."""
    return resample_draws(rows, order, replicates, seed).groupBy("replicate", "row").agg(F.count(F.lit(1)).alias("times"))


def _drawn(draws: DataFrame, numbered: DataFrame) -> DataFrame:
    """The draws with their rows. Nearly all draws of a task differ, so they are neither counted nor sorted first: they
    stream past a hash table of the numbered rows of their partition, and a task's memory is that of those rows."""
    return draws.join(numbered.hint("shuffle_hash"), "row")


def resampled_means(df: DataFrame, key: str, value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """replicate, mean of n draws of n rows with replacement; draws without a value are left out."""
    numbered = surrogate_key(df.select(key, value), "i", [F.col(key)]).select((F.col("i") - 1).alias("row"), value)
    return _drawn(resample_draws(df, key, replicates, seed), numbered).groupBy("replicate").agg(F.avg(value).alias("mean"))


def resampled_metrics(records: DataFrame, entities: DataFrame, truth: DataFrame, replicates: int = 100, seed: int = 42, m: Matching = Matching()) -> DataFrame:
    """replicate and its metrics: records drawn n of n with replacement, spread over their candidates, scored."""
    if m.filters:
        raise ValueError("resampling needs candidates by group, without filters")
    rows, members = filtered(records, entities, m)
    mine = profiles(records, m).select("record", "profile").join(rows.select("profile", "key", "g", "n_group"), "profile", "left")
    numbered = surrogate_key(mine.select("record", "key", "g", "n_group"), "i", [F.col("record")]).withColumn("row", F.col("i") - 1)
    draws = resample_draws(records.select(F.col(m.columns.record).alias("record")), "record", replicates, seed)
    grouped = _drawn(draws, numbered.where(F.col("g").isNotNull()).select("row", "key", "g", "n_group")).groupBy("replicate", "key", "g", "n_group").agg(F.count(F.lit(1)).alias("times"))
    spread = grouped.join(members, (F.col("key") == F.col("k")) & (grouped["g"] == members["g"]))
    scores = spread.groupBy("replicate", "entity").agg(F.sum(F.col("times") / F.col("n_group")).alias("share"))
    total = grouped.groupBy("replicate").agg(F.sum("times").alias("total"))
    scores = scores.join(total, "replicate").select("replicate", "entity", F.round(F.col("share") / F.col("total"), 9).alias("probability"))
    return score_metrics(scores, truth, ("replicate",))


def jackknife(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """profile, entity, full, without: the expected probability with all records and without one record of the profile.

    In closed form: the record's own share comes off its candidates, the number of matched records falls by one; all
    other entities are scaled. One row for each profile and candidate, whatever the number of records.
    """
    share = sized_candidates(records, entities, m).withColumn("own", 1.0 / F.col("n"))
    total = shares(records, entities, m).select("entity", F.col("share").alias("sum"))
    matched = total.agg(F.round(F.sum("sum")).alias("matched"))  # a record's shares add up to one
    out = share.join(total, "entity").crossJoin(matched)
    return out.select("profile", "n_records", "entity", (F.col("sum") / F.col("matched")).alias("full"), F.try_divide(F.col("sum") - F.col("own"), F.col("matched") - 1).alias("without"))


def leave_group_out(shares: DataFrame, group: str) -> DataFrame:
    """fold, entity, probability from (group, entity, share): all records outside the fold, by subtraction. The table
    itself has a row for each fold and entity; ``group_areas`` scores the folds without it."""
    each = stored(shares.groupBy(F.col(group).alias("fold"), "entity").agg(F.sum("share").alias("fs")), "folds")
    every = each.groupBy("entity").agg(F.sum("fs").alias("s"))
    total = each.agg(F.sum("fs").alias("t"))
    size = each.groupBy("fold").agg(F.sum("fs").alias("ft"))
    grid = size.crossJoin(every).join(each, ["fold", "entity"], "left").crossJoin(total)
    left = F.col("s") - F.coalesce("fs", F.lit(0.0))
    return grid.select("fold", "entity", F.try_divide(left, F.col("t") - F.col("ft")).alias("probability")).where(left > 1e-12)


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """replicate, mean: a Poisson bootstrap, which approximates ``resampled_means``; the number of draws varies.

    A row's number of draws in a replicate follows Poisson(1) by its hash (at most 8), and the mean is weighted: no row
    is sent anywhere, every replicate comes from one pass.
    """
    u = hash60(F.lit(seed), F.col(key), F.col("replicate")) / F.lit(float(1 << 60))
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):  # the distribution function of Poisson(1)
        total += p
        steps.append(total)
        p /= k + 1
    weight = F.lit(0)
    for s in steps:
        weight = weight + (u >= s).cast("int")
    drawn = df.select(key, value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    return drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def percentile_interval(replicates: DataFrame, value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return replicates.agg(F.percentile(value, F.lit(lo)).alias("lo"), F.percentile(value, F.lit(hi)).alias("hi"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def strata(df: DataFrame, value: str, cuts: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """stratum: low, mid or high by exact percentiles, upper bounds included; null values are in none."""
    out = df.crossJoin(quantiles(df, value, cuts))
    low, mid = F.col("_e")[0], F.col("_e")[1]
    return out.withColumn("stratum", F.when(F.col(value) <= low, "low").when(F.col(value) <= mid, "mid").when(F.col(value) > mid, "high")).drop("_e")


def quantile_bands(df: DataFrame, value: str, n: int) -> DataFrame:
    """band: edges at exact quantiles; the number of edges at or below, less one, within 0 .. n - 1."""
    count = F.size(F.filter("_e", lambda x: x <= F.col(value))) - 1
    return df.crossJoin(quantiles(df, value, [i / n for i in range(n + 1)])).withColumn("band", F.least(F.greatest(count, F.lit(0)), F.lit(n - 1))).drop("_e")


def spatial_blocks(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """block: cells of a square grid of side ceil(sqrt(n)), the largest coordinate in a cell of its own, modulo n."""
    side = int(-(-(n**0.5) // 1))
    ends = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda v, a, b: F.floor(F.coalesce(F.try_divide(F.col(v) - F.col(a), F.col(b) - F.col(a)), F.lit(0.0)) * side).cast("bigint")
    return df.crossJoin(ends).withColumn("block", (cell(x, "_x0", "_x1") * side + cell(y, "_y0", "_y1")) % n).drop("_x0", "_x1", "_y0", "_y1")


def _shared_out(size: int, count: int, load: list[int], first: int) -> tuple[list[int], list[list[int]]]:
    """Deals so many groups of one size, each to the lightest fold (of equals the lower), and adds them to the load.

    The folds that take part in turn change only where the load of one more is reached: from which group on (counted
    from ``first``) which folds take one each, in which order.
    """
    level = [x // size for x in load]
    order = sorted(range(len(load)), key=lambda f: (load[f] % size, f))
    points, at, left = sorted(set(level)), first, count
    starts, turns = [], []
    for i, p in enumerate(points):
        turn = [f for f in order if level[f] <= p]
        span = len(turn) * (points[i + 1] - p) if i + 1 < len(points) else left
        given = min(span, left)
        if not given:
            break
        starts.append(at)
        turns.append(turn)
        for k, f in enumerate(turn):
            load[f] += size * (given // len(turn) + (k < given % len(turn)))
        at, left = at + given, left - given
    return starts, turns


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """fold: groups, largest first (of equals the smaller key), each to the lightest fold (of equals the lower).

    Groups are numbered by range. The rule is worked out for all groups of one size at once, so the driver sees a row
    for each distinct size (fewer than the root of twice the rows), whatever the number of groups.
    """
    counts = stored(df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")), "groups")
    load, first, plan = [0] * folds, 0, []
    for r in counts.groupBy("_n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("_n").desc()).toLocalIterator():
        plan.append((r["_n"], *_shared_out(r["_n"], r["k"], load, first)))
        first += r["k"]
    turns = df.sparkSession.createDataFrame(plan, "_n bigint, _starts array<bigint>, _turns array<array<int>>")
    ranked = surrogate_key(counts, "_i", [F.col("_n").desc(), F.col("_g")]).withColumn("_i", F.col("_i") - 1)
    met = ranked.join(F.broadcast(turns) if len(plan) <= 100_000 else turns, "_n")
    part = F.size(F.filter("_starts", lambda x: x <= F.col("_i"))) - 1
    turn = F.get("_turns", part)
    dealt = met.select("_g", F.get(turn, F.pmod(F.col("_i") - F.get("_starts", part), F.size(turn)).cast("int")).alias("fold"))
    return df.join(dealt, df[group].eqNullSafe(dealt["_g"])).drop("_g")


def dealt_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """fold: groups, largest first, to the folds in turn, forth and back."""
    counts = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    ranked = surrogate_key(counts, "_i", [F.col("n").desc(), F.col("_g")])
    turn, back = F.pmod(F.col("_i") - 1, F.lit(folds)), F.pmod(F.floor((F.col("_i") - 1) / folds), F.lit(2)) == 1
    plan = ranked.select("_g", F.when(back, folds - 1 - turn).otherwise(turn).cast("int").alias("fold"))
    return df.join(plan, df[group].eqNullSafe(plan["_g"])).drop("_g")


def group_balance(df: DataFrame, group: str) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), (F.min("n") / F.max("n")).alias("ratio"))


def cross_validated_r2(df: DataFrame, fold: str, y: str, x: str) -> DataFrame:
    """fold, r2: a line fitted to the other folds, scored on each; the fit needs the sums of each fold only."""
    s = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    t = s.agg(*[F.sum(c).alias(f"t{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    j = s.crossJoin(t)
    n, sx, sy, sxx, sxy = (F.col(f"t{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    k = j.withColumn("b", slope).withColumn("a", (sy - F.col("b") * sx) / n)
    a, b = F.col("a"), F.col("b")
    sse = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + a * a * F.col("n") + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    return k.select(fold, (1 - sse / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"))
