"""Neighbours, polygons and grids, with cells as join keys instead of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import RADIUS_M, haversine
from ..storage import stored

METRES_PER_DEGREE = math.pi * RADIUS_M / 180


def _near_pairs(a: DataFrame, b: DataFrame, most: float) -> DataFrame:
    """Pairs of points (id, lat, lon) up to ``most`` metres apart: cells of that size meet their neighbours only.

    Longitude cells widen towards the poles by latitude band; a band's cells are computed with the widest of its
    neighbours, and wrap at 180 degrees.
    """
    step = max(most / METRES_PER_DEGREE * 1.0001, 1e-7)
    bands = int(math.ceil(180 / step))

    def width(band: Column) -> Column:
        """Cells around the globe in a band: none narrower than the distance at its edge nearest to a pole."""
        edge = F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90))
        return F.greatest(F.floor(360 * F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.0)) / step), F.lit(1))

    band = F.least(F.floor((F.col("lat") + 90) / step), F.lit(bands - 1)).cast("bigint")
    unit = F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360
    left = a.withColumn("band", band).withColumn("u", unit).withColumn("row", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    w = width(F.col("row"))
    left = left.withColumn("w", w).withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.floor(F.col("u") * F.col("w")) + d, F.col("w")).cast("bigint")))))
    right = b.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).withColumn("row2", F.least(F.floor((F.col("lat2") + 90) / step), F.lit(bands - 1)).cast("bigint"))
    right = right.withColumn("cell2", F.least(F.floor(F.pmod(F.col("lon2") + 180, F.lit(360.0)) / 360 * width(F.col("row2"))), width(F.col("row2")) - 1).cast("bigint"))
    met = left.join(right, (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")))
    return met.withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("distance") <= most).select("id", "id2", "distance")


def distance_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of two stated sets, as rows."""
    right = b.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.crossJoin(right).select("id", "id2", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("distance"))


#: A side of at most so many rows goes to all tasks; with more, points meet by cells.
MOST_STATED = 10_000


def nearest(a: DataFrame, b: DataFrame, k: int, most: float | None = None, most_stated: int = MOST_STATED) -> DataFrame:
    """id, id2, distance, rank: the k nearest of b for each point of a, within ``most`` metres if given.

    Without a limit a short list is held against all points; of more, points look through cubes of the sphere that are
    as small as the points in them are dense.
    """
    top = W.partitionBy("id").orderBy("distance", "id2")
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    if most is not None:
        return ranked(_near_pairs(a, b, most))
    n = b.count()
    if n <= most_stated:
        return ranked(distance_pairs(a, F.broadcast(b)))
    return ranked(_near_leaves(a, b, min(k, n)))


#: Cubes of the unit sphere are halved so often at most, STEP times at once; LEAF points need no further halving.
DEEPEST, STEP, LEAF = 32, 2, 64
#: Cells of the first levels go to all tasks (at most 6 * 4**level of them); of deeper ones each meets its visitors in parts.
SENT_LEVEL, PARTS = 8, 8
CELL = ("ix", "iy", "iz")


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    la, lo = F.radians(lat), F.radians(lon)
    return df.withColumns({"X": F.cos(la) * F.cos(lo), "Y": F.cos(la) * F.sin(lo), "Z": F.sin(la)})


def _cube(level: Column) -> list[Column]:
    """The cube of a level that holds a point."""
    n = F.pow(F.lit(2.0), level)
    return [F.least(F.floor((F.col(c) + 1) / 2 * n), n - 1).cast("bigint").alias(name) for c, name in zip("XYZ", CELL, strict=True)]


def _pyramid(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of points by cube (level, ix, iy, iz, n), as deep as cubes hold more than LEAF; and each point with its
    leaf, the first cube that holds no more."""
    rest, top = b, -STEP
    nodes, leaves = None, None
    while True:
        levels = [level for level in range(top + STEP, top + 4 * STEP + 1, STEP) if level <= DEEPEST]
        each = rest.withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels]))).select("*", *_cube(F.col("level")))
        counts = stored(each.groupBy("level", *CELL).agg(F.count(F.lit(1)).alias("n")), "cubes")
        small = (F.col("n") <= LEAF) | (F.col("level") == DEEPEST)
        found = each.join(counts.where(small), ["level", *CELL]).groupBy("row").agg(F.min("level").alias("level"))
        done = rest.join(found, "row").select("id2", "lat2", "lon2", "level", *_cube(F.col("level")))
        nodes = counts if nodes is None else nodes.unionByName(counts)
        leaves = done if leaves is None else leaves.unionByName(done)
        top = levels[-1]
        if top == DEEPEST or counts.where(f"level = {top} AND n > {LEAF}").isEmpty():
            return nodes, leaves
        rest = stored(rest.join(found, "row", "left_anti"), "rest")  # the rows before are still those of the leaves


def _near_leaves(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """id, id2, distance: for each point the points of all leaves that may hold one of its k nearest.

    Cubes are visited from the largest down. A point keeps those that reach nearer than the k-th point can be by the
    farthest corners of the cubes it has, and asks for the parts of those with many points. So dense places have small
    cubes, sparse ones large, and no cube is opened that cannot hold a neighbour.
    """
    # of points in one place the k smallest ids can be among the k nearest
    same = W.partitionBy("lat2", "lon2").orderBy("id2")
    places = b.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).where("lat2 IS NOT NULL AND lon2 IS NOT NULL")
    places = places.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k).drop("nth")
    nodes, leaves = _pyramid(stored(_on_sphere(places, "lat2", "lon2").withColumn("row", F.monotonically_increasing_id()), "places"))
    nodes, leaves = stored(nodes, "cubes"), stored(leaves, "leaves")
    asking = stored(_on_sphere(a.select("id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL"), "lat", "lon"), "asking")
    own = ["id", "lat", "lon", "X", "Y", "Z"]
    seen = asking.crossJoin(F.broadcast(nodes.where("level = 0").select("level", *CELL, "n")))  # one row
    level, kept = 0, None
    while True:
        size = F.pow(F.lit(2.0), 1 - F.col("level"))
        low = [F.col(c) * size - 1 for c in CELL]
        gap = [F.greatest(x - F.col(v), F.col(v) - x - size, F.lit(0.0)) for x, v in zip(low, "XYZ", strict=True)]
        reach = [F.greatest(F.abs(F.col(v) - x), F.abs(F.col(v) - x - size)) for x, v in zip(low, "XYZ", strict=True)]
        norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        near = seen.withColumn("least", norm(gap)).withColumn("most", norm(reach))
        upto = W.partitionBy("id", "lat", "lon").orderBy("most", "level", *CELL)
        near = near.withColumn("sum", F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("sum") >= k, F.col("most"))).over(W.partitionBy("id", "lat", "lon"))
        kept = stored(near.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound") * (1 + 1e-9) + 1e-12)).select(*own, "level", *CELL, "n"), "near", kept)
        open_ = (F.col("n") > LEAF) & (F.col("level") == level) & F.lit(level < DEEPEST)
        if kept.where(open_).isEmpty():
            break
        below = nodes.where(F.col("level") == level + STEP).select(*[F.shiftright(c, STEP).alias(f"p{c}") for c in CELL], "level", *CELL, "n")
        parents = kept.where(open_).select(*own, *[F.col(c).alias(f"q{c}") for c in CELL])
        on = (F.col("pix") == F.col("qix")) & (F.col("piy") == F.col("qiy")) & (F.col("piz") == F.col("qiz"))
        if level + STEP <= SENT_LEVEL:
            parts = parents.join(F.broadcast(below), on)
        else:
            parts = parents.withColumn("qs", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(below.withColumn("ps", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), on & (F.col("ps") == F.col("qs")))
        seen = kept.where(~open_).unionByName(parts.select(*own, "level", *CELL, "n"))
        level += STEP
    met = kept.select("id", "lat", "lon", "level", *CELL).join(leaves, ["level", *CELL])
    return met.select("id", "id2", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("distance"))


def within_distance(points: DataFrame, most: float, include_self: bool = False) -> DataFrame:
    """id, neighbours (sorted ids): a point without any keeps an empty list."""
    pairs = _near_pairs(points, points, most)
    if not include_self:
        pairs = pairs.where(F.col("id") != F.col("id2"))
    lists = pairs.groupBy("id").agg(F.sort_array(F.collect_list("id2")).alias("neighbours"))
    return points.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def edges(polygons: DataFrame) -> DataFrame:
    """pid, x1, y1, x2, y2 from polygons (pid, rings: arrays of points, closed or not)."""
    ring = polygons.select("pid", F.explode("rings").alias("r"))
    point = ring.select("pid", "r", F.posexplode("r").alias("i", "p"))
    following = F.get("r", F.pmod(F.col("i") + 1, F.size("r")).cast("int"))
    out = point.select("pid", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), following["x"].alias("x2"), following["y"].alias("y2"))
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _side(boxes: DataFrame, n_edges: int) -> float:
    """A side of cells at which the boxes of all polygons have about four cells an edge."""
    row = boxes.agg(F.sum((F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay"))).alias("area"), F.max(F.greatest(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("span")).first()
    return max(math.sqrt((row["area"] or 0.0) / max(4 * n_edges, 256)), (row["span"] or 0.0) / max(4 * n_edges, 256), 1e-12)


#: Outlines of at most so many edges in all go to all tasks.
FEW_EDGES = 256


def _in_few(points: DataFrame, lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """The even-odd rule over outlines that every task holds; points are not shuffled."""
    outlines = F.broadcast(lines.groupBy("pid").agg(F.collect_list("edge").alias("edges")).join(boxes, "pid"))
    x, y = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])

    def on(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (turn == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    met = points.join(outlines, x.between(F.col("ax"), F.col("bx")) & y.between(F.col("ay"), F.col("by")))
    return met.where((F.size(F.filter("edges", crosses)) % 2 == 1) & ~F.exists("edges", on)).select("id", "pid")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """id, pid: points (id, x, y) inside polygons by the even-odd rule; a point on an edge is not inside.

    Cells of side ``cell`` (by the number of edges if not given) hold the edges that pass through them, and how often
    the line through the middle of their row crosses the outline further to the right. A point goes straight to that
    line and along it to the right, so it meets the edges of its own cell only, and none inside the polygon. A few
    edges (``FEW_EDGES`` in all) are held against all points instead, if no cell is given.
    """
    lines = edges(polygons).withColumn("edge", F.struct("x1", "y1", "x2", "y2"))
    boxes = lines.groupBy("pid").agg(F.min("x1").alias("ax"), F.max("x1").alias("bx"), F.min("y1").alias("ay"), F.max("y1").alias("by"))
    n = lines.count()
    if n <= FEW_EDGES and not cell:
        return _in_few(points, lines, boxes)
    c = float(cell) if cell else _side(boxes, n)
    at = lambda v: F.floor(v / F.lit(c)).cast("bigint")
    x, y, x1, y1, x2, y2 = (F.col(k) for k in ("x", "y", "x1", "y1", "x2", "y2"))
    # edges by row: where they cross the row's middle, and the cells that they pass through, a little more on both sides
    rows = lines.withColumn("cy", F.explode(F.sequence(at(F.least(y1, y2)), at(F.greatest(y1, y2)))))
    middle = (F.col("cy") + 0.5) * F.lit(c)
    crosses = (y1 > middle) != (y2 > middle)
    along = lambda v: F.when(y1 == y2, x1).otherwise(x1 + (x2 - x1) * (F.least(F.greatest(v, F.least(y1, y2)), F.greatest(y1, y2)) - y1) / (y2 - y1))
    low, high = along(F.col("cy") * F.lit(c)), along((F.col("cy") + 1) * F.lit(c))
    ends = (F.when(y1 == y2, F.least(x1, x2)).otherwise(F.least(low, high)), F.when(y1 == y2, F.greatest(x1, x2)).otherwise(F.greatest(low, high)))
    rows = rows.withColumn("xc", F.when(crosses, at(along(middle))))
    passed = F.sequence(at(ends[0] - c * 1e-6), at(ends[1] + c * 1e-6))
    by_cell = rows.select("pid", "cy", "xc", "edge", F.explode(F.when(F.col("xc").isNull(), passed).otherwise(F.array_union(passed, F.array("xc")))).alias("cx"))
    # all cells of the boxes, with the crossings further right; those without any and without edges are outside
    crossed = rows.where("xc IS NOT NULL").groupBy("pid", "cy", F.col("xc").alias("cx")).agg(F.count(F.lit(1)).alias("here"))
    held = by_cell.select("pid", "cy", "cx").distinct().withColumn("held", F.lit(True))
    grid = boxes.select("pid", F.explode(F.sequence(at(F.col("ay")), at(F.col("by")))).alias("cy"), F.sequence(at(F.col("ax")), at(F.col("bx"))).alias("cxs")).select("pid", "cy", F.explode("cxs").alias("cx"))
    further = W.partitionBy("pid", "cy").orderBy(F.col("cx").desc()).rowsBetween(W.unboundedPreceding, -1)
    cells = grid.join(crossed, ["pid", "cy", "cx"], "left").withColumn("beyond", F.coalesce(F.sum("here").over(further), F.lit(0))).drop("here").join(held, ["pid", "cy", "cx"], "left")
    cells = cells.where(F.col("held") | (F.col("beyond") % 2 == 1))
    placed = points.select("id", "x", "y", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy")).join(cells, ["cx", "cy"])
    within = placed.where(F.col("held").isNull()).select("id", "pid")
    # in a cell with edges: which side of each edge the point and the corner of its way lie on
    met = placed.where("held").drop("held").join(by_cell, ["pid", "cx", "cy"]).select("id", "pid", "x", "y", "cx", "cy", "beyond", "xc", "edge.*")
    side = lambda v: F.signum((x2 - x1) * (v - y1) - (y2 - y1) * (x - x1))
    turn, corner = side(y), side(middle)
    right, up = F.signum(x2 - x1), F.signum(y2 - y1)
    # a corner on an edge counts as a little to the right, and less above; so it is above what does not cross its line
    above = F.when(corner != 0, corner * right > 0).otherwise(~crosses | (right * up < 0))
    straight = ((x1 > x) != (x2 > x)) & ((turn * right > 0) != above)
    out_right = (F.col("xc") == F.col("cx")) & (corner * up > 0)
    on_edge = (turn == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    tested = met.groupBy("id", "pid", "beyond").agg(F.sum(straight.cast("int") + F.coalesce(out_right, F.lit(False)).cast("int")).alias("n"), F.bool_or(on_edge).alias("on_edge"))
    return within.unionByName(tested.where(((F.col("n") + F.col("beyond")) % 2 == 1) & ~F.col("on_edge")).select("id", "pid"))


def _nearest_edges(points: DataFrame, lines: DataFrame, away: Column, most_stated: int) -> DataFrame:
    """id, d: the distance to the nearest edge; a short list of edges is held against all points, else by growing cells."""
    n = lines.count()
    if n <= most_stated:
        return points.crossJoin(F.broadcast(lines)).groupBy("id").agg(F.min(away).alias("d"))
    box = lines.agg(F.min(F.least("x1", "x2")).alias("x"), F.max(F.greatest("x1", "x2")).alias("X"), F.min(F.least("y1", "y2")).alias("y"), F.max(F.greatest("y1", "y2")).alias("Y")).first()
    span = max(box["X"] - box["x"], box["Y"] - box["y"], 1e-9)
    reach, left, out = span / math.sqrt(n), points, None
    while True:
        at = lambda c: F.floor(c / F.lit(reach)).cast("bigint")
        placed = lines.withColumn("cx", F.explode(F.sequence(at(F.least("x1", "x2")) - 1, at(F.greatest("x1", "x2")) + 1))).withColumn("cy", F.explode(F.sequence(at(F.least("y1", "y2")) - 1, at(F.greatest("y1", "y2")) + 1)))
        met = left.withColumn("cx", at(F.col("x"))).withColumn("cy", at(F.col("y"))).join(placed, ["cx", "cy"])
        found = stored(met.groupBy("id").agg(F.min(away).alias("d")).where(F.col("d") <= reach), "near")
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found.select("id"), "id", "left_anti"), "left")
        if left.isEmpty():
            return out
        if reach > 4 * span:  # what is left lies far off, where the whole outline is one cell or two
            lo = F.greatest(F.lit(box["x"]) - F.col("x"), F.col("x") - F.lit(box["X"]), F.lit(box["y"]) - F.col("y"), F.col("y") - F.lit(box["Y"]))
            reach = max(2 * reach, float(left.agg(F.max(lo)).first()[0] or 0) + 2 * span)
        else:
            reach *= 2


def distance_to_polygons(points: DataFrame, polygons: DataFrame, most_stated: int = MOST_STATED) -> DataFrame:
    """id, distance: to the union of the polygons in the units of the coordinates, 0 inside or on an edge."""
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    away = F.sqrt(F.pow(x - x1 - t * dx, 2) + F.pow(y - y1 - t * dy, 2))
    least = _nearest_edges(points, edges(polygons), away, most_stated)
    inside = points_in_polygons(points, polygons).select("id").distinct().withColumn("in_", F.lit(True))
    return points.select("id").join(least, "id", "left").join(inside, "id", "left").select("id", F.when(F.col("in_"), 0.0).otherwise(F.col("d")).alias("distance"))


def within_buffer(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    """Points inside a polygon or nearer than the reach."""
    return distance_to_polygons(points, polygons).where((F.col("distance") == 0) | (F.col("distance") < reach)).select("id")


def contiguity(polygons: DataFrame, kind: str = "queen") -> DataFrame:
    """pid, neighbour: queen shares a vertex, rook an edge (for polygons whose shared borders have equal vertices)."""
    e = edges(polygons)
    if kind == "queen":
        keys = e.select("pid", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("k")).distinct()
    else:
        a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
        keys = e.select("pid", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("k")).distinct()
    other = keys.select(F.col("pid").alias("neighbour"), F.col("k").alias("k2"))
    return keys.join(other, F.col("k") == F.col("k2")).where(F.col("pid") != F.col("neighbour")).select("pid", "neighbour").distinct()


def centroid(polygons: DataFrame) -> DataFrame:
    """pid, x, y, area: by the shoelace formula over all rings (holes turn the other way)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    s = edges(polygons).groupBy("pid").agg(F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("cx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("cy"))
    return s.select("pid", (F.col("cx") / (3 * F.col("a"))).alias("x"), (F.col("cy") / (3 * F.col("a"))).alias("y"), F.abs(F.col("a") / 2).alias("area"))


def representative_point(polygons: DataFrame) -> DataFrame:
    """pid, x, y: a point inside each polygon, however its outline turns and whatever holes it has.

    A line at a height between the vertices nearest to the middle crosses the outline; the middle of its widest run
    inside is taken. Polygons without area have none.
    """
    lines = edges(polygons)
    heights = lines.groupBy("pid").agg(((F.min("y1") + F.max("y1")) / 2).alias("mid"))
    ends = lines.join(heights, "pid").groupBy("pid").agg(F.max(F.when(F.col("y1") <= F.col("mid"), F.col("y1"))).alias("below"), F.min(F.when(F.col("y1") > F.col("mid"), F.col("y1"))).alias("above"))
    at = ends.where("above IS NOT NULL").select("pid", ((F.col("below") + F.col("above")) / 2).alias("y"))
    y = F.col("y")
    crossed = lines.join(at, "pid").where((F.col("y1") > y) != (F.col("y2") > y))
    crossed = crossed.select("pid", "y", (F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    along = W.partitionBy("pid").orderBy("x")
    runs = crossed.withColumn("n", F.row_number().over(along)).withColumn("to", F.lead("x").over(along)).where("n % 2 = 1 AND to > x")
    widest = runs.groupBy("pid").agg(F.max_by(F.struct(((F.col("x") + F.col("to")) / 2).alias("x"), "y"), F.struct(F.col("to") - F.col("x"), -F.col("x"))).alias("p"))
    return polygons.select("pid").join(widest, "pid", "left").select("pid", "p.x", "p.y")


def slope_degrees(raster: DataFrame, cell_degrees: float) -> DataFrame:
    """(tile, row, col, lat, elev) with slope: central differences, one-sided at the edges, metres by latitude."""
    along, across = W.partitionBy("tile", "row").orderBy("col"), W.partitionBy("tile", "col").orderBy("row")

    def gradient(w: W, unit: Column) -> Column:
        before, after, e = F.lag("elev").over(w), F.lead("elev").over(w), F.col("elev")
        return F.when(before.isNull(), after - e).when(after.isNull(), e - before).otherwise((after - before) / 2) / unit

    dx = gradient(along, F.lit(cell_degrees * 111_320.0) * F.cos(F.radians("lat")))
    dy = gradient(across, F.lit(cell_degrees * 111_320.0))
    return raster.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def sample_raster(points: DataFrame, raster: DataFrame, cell: float) -> DataFrame:
    """id, elev: the value of the cell that holds the point; of several tiles the first with a value. Tiles have a
    place, an origin (x0, y0) and rows and columns of the cell size."""
    tiles = raster.groupBy("tile", "x0", "y0").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    size = tiles.agg((F.max(F.greatest("rows", "cols") + 1) * cell).alias("size"))  # of the largest tile: the side of the cells that points and tiles meet by
    at = lambda c: F.floor(c / F.col("size")).cast("bigint")
    span = tiles.crossJoin(size).withColumn("cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x0") + (F.col("cols") + 1) * cell)))).withColumn("cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y0") + (F.col("rows") + 1) * cell))))
    asked = points.crossJoin(size).select("id", "x", "y", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy"))
    at = asked.join(span.select("cx", "cy", "tile", "x0", "y0"), ["cx", "cy"]).select("id", "tile", F.floor((F.col("y") - F.col("y0")) / cell).cast("bigint").alias("row"), F.floor((F.col("x") - F.col("x0")) / cell).cast("bigint").alias("col"))
    hit = at.join(raster.where(F.col("elev").isNotNull()).select("tile", "row", "col", "elev"), ["tile", "row", "col"])
    return points.select("id").join(hit.groupBy("id").agg(F.min_by("elev", "tile").alias("elev")), "id", "left")
