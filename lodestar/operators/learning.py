"""Models and groups that need fitting: a registry of regressors, k-means groups, cross-validation and leakage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import stored
from .cleaning import surrogate_key
from .extra_trees import ExtraTreesRegressor
from .metrics import r_squared

#: Regressors by name; add to it to use a model of your own.
MODELS: dict[str, Callable[[], object]] = {
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "extra_trees": lambda: ExtraTreesRegressor(trees=50, seed=42),
    "random_forest": lambda: RandomForestRegressor(numTrees=50, seed=42),
    "gradient_boosting": lambda: GBTRegressor(maxIter=30, seed=42),
}


def model(name: str, features: Sequence[str], label: str) -> Pipeline:
    """Assembles features and fits; scaling is ``scaled``'s."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), MODELS[name]().setLabelCol(label)])


def scaled(df: DataFrame, by: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features less their means, over their population deviations in ``by`` (1 where they do not vary)."""
    row = by.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - (row[f"m{i}"] or 0.0)) / (row[f"s{i}"] or 1.0) for i, c in enumerate(features)})


def cross_validate(df: DataFrame, fold: str, name: str, features: Sequence[str], label: str, scale: bool = True) -> DataFrame:
    """fold, r2: each fold scored by a model of the others, scaled by the others if asked."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # a value a fold
    out = None
    for k in folds:
        others, own = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if scale:
            others, own = scaled(others, others, features), scaled(own, others, features)
        fitted = model(name, features, label).fit(others)
        one = fitted.transform(own).agg(r_squared(F.col(label), F.col("prediction")).alias("r2")).select(F.lit(k).alias("fold"), "r2")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rows")
    return out


def contiguous_folds(df: DataFrame, order: str, folds: int, out: str = "fold") -> DataFrame:
    """Rows in runs of the given order, the first folds one row longer where sizes do not divide."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    small, extra = F.floor(F.col("_all") / folds), F.pmod(F.col("_all"), F.lit(folds))
    at, edge = F.col("_at") - 1, (F.floor(F.col("_all") / folds) + 1) * F.pmod(F.col("_all"), F.lit(folds))
    fold = F.when(at < edge, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return surrogate_key(df, "_at", [F.col(order)]).crossJoin(total).withColumn(out, fold.cast("int")).drop("_at", "_all")


def spatial_leakage(df: DataFrame, fold: str, order: str, name: str, features: Sequence[str], label: str) -> DataFrame:
    """leakage, leakage_pct: what as many contiguous folds, over features scaled before the split, promise beyond the spatial ones."""
    n = df.select(fold).distinct().count()
    plain = contiguous_folds(scaled(df, df, features), order, n, "_random")
    return leakage(cross_validate(plain, "_random", name, features, label, scale=False), cross_validate(df, fold, name, features, label))


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"))


def leakage(random: DataFrame, spatial: DataFrame) -> DataFrame:
    """What random folds promise beyond spatial ones, and in percent of these (infinite at 0)."""
    a, b = summary(random).select(F.col("mean").alias("r")), summary(spatial).select(F.col("mean").alias("s"))
    gap = F.col("r") - F.col("s")
    return a.crossJoin(b).select(gap.alias("leakage"), F.when(F.col("s") == 0, float("inf")).otherwise(100 * gap / F.col("s")).alias("leakage_pct"))


def kmeans_groups(df: DataFrame, x: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """group: k-means on two coordinates, best of several starts is left to its parallel initialisation."""
    steps = [VectorAssembler(inputCols=[x, y], outputCol="features"), KMeans(k=k, seed=seed, predictionCol="group")]
    return Pipeline(stages=steps).fit(df).transform(df).drop("features")


def kmeans_centres(df: DataFrame, x: str, y: str, k: int, seed: int = 42, starts: int = 4) -> list[tuple[float, float]]:
    """Centres in order, of the best of several starts; as many as there are distinct places, if these are fewer."""
    rows = VectorAssembler(inputCols=[x, y], outputCol="_features").transform(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_features").fit(rows) for i in range(starts)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return sorted(tuple(map(float, c)) for c in best.clusterCenters())


def balanced_groups(df: DataFrame, key: str, x: str, y: str, k: int, seed: int = 42, rounds: int = 40) -> DataFrame:
    """group: k-means centres with room for as many rows each, one more in the first ones where they do not divide.

    An auction: every row goes to the centre with the least distance and price, and a centre that has more rows than room
    raises its price by the margin at which the excess would rather leave (by a sketch). What is then still too much moves
    where it costs least, first those that lose least. A round is one aggregation; the driver holds k prices.
    """
    rows = stored(df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}), "rows")
    centres = kmeans_centres(rows, "_x", "_y", k, seed)
    centres += [centres[-1]] * (k - len(centres))  # of few distinct places
    n = rows.count()
    room = [n // k + (i < n % k) for i in range(k)]
    away = [F.sqrt(F.pow(F.col("_x") - a, 2) + F.pow(F.col("_y") - b, 2)) for a, b in centres]
    prices = [0.0] * k

    def placed() -> DataFrame:
        offers = F.array_sort(F.array(*[F.struct((F.coalesce(d, F.lit(0.0)) + p).alias("cost"), F.lit(i).alias("at")) for i, (d, p) in enumerate(zip(away, prices, strict=True))]))
        best = rows.withColumn("_o", offers)
        margin = F.get("_o", F.lit(1))["cost"] - F.col("_o")[0]["cost"] if k > 1 else F.lit(0.0)
        return best.withColumn("group", F.col("_o")[0]["at"]).withColumn("_margin", margin).drop("_o")

    shares = [i / 100 for i in range(101)]
    for step in range(rounds):
        counts = {r["group"]: r for r in placed().groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_margin", shares, 1000).alias("m")).collect()}  # k rows
        over = {g: r["n"] - room[g] for g, r in counts.items() if r["n"] > room[g]}
        if sum(over.values()) <= n // 1000 + k:
            break
        for g, excess in over.items():
            at = min(100, -(-100 * excess // counts[g]["n"]))
            prices[g] += counts[g]["m"][at] * (1.0 if step < rounds // 2 else 0.5) + 1e-12
    now = stored(placed().select(*[c for c in rows.columns], "group"), "placed")
    while True:
        have = {r["group"]: r["n"] for r in now.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
        over = {g: c - room[g] for g, c in have.items() if c > room[g]}
        if not over:
            return now.drop("_x", "_y")
        free = {g: room[g] - have.get(g, 0) for g in range(k) if room[g] > have.get(g, 0)}
        own = F.element_at(F.array(*away), F.col("group") + 1)
        move = F.array_min(F.array(*[F.struct((F.coalesce(away[g] - own, F.lit(0.0))).alias("cost"), F.lit(g).alias("to")) for g in free]))
        some = now.where(F.col("group").isin(list(over))).withColumn("_m", move)
        cheapest = W.partitionBy("group").orderBy("_m.cost", key)
        leave = some.withColumn("_i", F.row_number().over(cheapest)).where(F.col("_i") <= max(over.values()))
        leave = leave.where(F.col("_i") <= F.element_at(F.create_map(*[F.lit(v) for kv in over.items() for v in kv]), F.col("group")))
        enter = leave.withColumn("_j", F.row_number().over(W.partitionBy("_m.to").orderBy("_m.cost", key))).where(F.col("_j") <= max(free.values()))
        enter = enter.where(F.col("_j") <= F.element_at(F.create_map(*[F.lit(v) for kv in free.items() for v in kv]), F.col("_m.to")))
        moved = stored(enter.select(F.col(key).alias("_key"), F.col("group").alias("_from"), F.col("_m.to").alias("_to")), "moved")
        now = stored(now.join(moved, (now[key] == moved["_key"]) & (now["group"] == moved["_from"]), "left").withColumn("group", F.coalesce("_to", "group")).drop("_key", "_from", "_to"), "placed", now)


def contiguity_groups(units: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """id, group: k groups of neighbours by Ward's rule, from units (id, x, y) and links (id, neighbour).

    In every round each cluster finds the neighbour that it is cheapest to join, and pairs that choose each other merge:
    sums by cluster and the links between clusters are the tables, so a round is a few joins. All merges are kept with
    their heights (never below those of their parts), and the lowest ones make k groups. Parts of the map that do not
    touch are never joined, so there may be more groups. Of equal costs the smaller ids go first. Groups are numbered by
    their smallest id.
    """
    state = stored(units.select(F.col("id").alias("c"), F.lit(1.0).alias("n"), F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"), F.lit(0.0).alias("top")), "clusters")
    pairs = stored(links.where("id != neighbour").select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct(), "links")
    merges, step = None, 0
    while not pairs.isEmpty():
        step += 1
        side = lambda s: state.select(*[F.col(c).alias(f"{s}_{c}") for c in state.columns])
        met = pairs.join(side("a"), F.col("a") == F.col("a_c")).join(side("b"), F.col("b") == F.col("b_c"))
        gap = F.pow(F.col("a_sx") / F.col("a_n") - F.col("b_sx") / F.col("b_n"), 2) + F.pow(F.col("a_sy") / F.col("a_n") - F.col("b_sy") / F.col("b_n"), 2)
        cost = F.col("a_n") * F.col("b_n") / (F.col("a_n") + F.col("b_n")) * gap
        priced = met.select("a", "b", F.struct(F.round(cost, 9).alias("cost"), "a", "b").alias("e"), F.greatest(cost, "a_top", "b_top").alias("height"))
        best = priced.select(F.explode(F.array("a", "b")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))
        chosen = best.groupBy("e").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
        joined = stored(priced.join(chosen, "e", "left_semi").select("a", "b", "height", F.lit(step).alias("step")), "merges")
        merges = joined if merges is None else merges.unionByName(joined)
        to = joined.select(F.col("b").alias("old"), F.col("a").alias("new"), "height")
        now = state.join(to, state["c"] == to["old"], "left").withColumn("c", F.coalesce("new", "c"))
        tops = joined.select(F.col("a").alias("c"), F.col("height").alias("h"))
        state_was, pairs_were = state, pairs
        state = stored(now.groupBy("c").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.max("top").alias("t0")).join(tops, "c", "left").select("c", "n", "sx", "sy", F.coalesce("h", "t0").alias("top")), "clusters", state_was)
        names = to.select("old", "new")
        moved = pairs.join(names.toDF("oa", "na"), F.col("a") == F.col("oa"), "left").join(names.toDF("ob", "nb"), F.col("b") == F.col("ob"), "left").select(F.coalesce("na", "a").alias("u"), F.coalesce("nb", "b").alias("v"))
        pairs = stored(moved.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links", pairs_were)
    roots = units.select("id", F.col("id").alias("root"))
    if merges is not None:
        wanted = max(0, units.count() - k)
        lowest = surrogate_key(merges, "nth", [F.col("height"), F.col("step"), F.col("a"), F.col("b")]).where(F.col("nth") <= wanted)
        up = stored(lowest.select(F.col("b").alias("at"), F.col("a").alias("next")), "parents")
        roots = stored(roots, "roots")
        while True:  # a unit's smallest id, by twice as long steps each time
            ahead = roots.select("id", "root").join(up, F.col("root") == F.col("at"), "left")
            roots = stored(ahead.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", roots)
            if roots.where("moved").isEmpty():
                break
            further = up.toDF("at", "mid").join(up.toDF("at2", "next"), F.col("mid") == F.col("at2"), "left")
            up = stored(further.select("at", F.coalesce("next", "mid").alias("next")), "parents", up)
    numbers = surrogate_key(roots.select("root").distinct(), "g", [F.col("root")])
    return roots.join(numbers, "root").select("id", (F.col("g") - 1).cast("int").alias("group"))
