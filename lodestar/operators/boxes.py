"""Counts of points in boxes, and sums over the boxes that hold a point, without a row for a pair of them.

Points and boxes belong to groups. Both are dealt once into tiles: small groups share one, a large one is dealt over
several, of at most ``TILE`` of its boxes and ``TILE`` of its points each, so a tile is bounded and counts and sums add
up over tiles. A tile works on places among its sorted values. Along the dimension with the most values both are
prefix sums; in every other one a place is cut by halves: a point lies in one node of each level, a box is made up of at
most two nodes of each. Nodes exist only within a tile, a few arrays at a time; no row is shuffled or written for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..storage import stored

#: At most so many boxes and so many points of a group in a tile; groups of up to ``SMALL`` rows in all share tiles.
TILE, SMALL = 1 << 19, 1 << 16
_AT = ["tile", "part", "lot"]


def numbered(groups: DataFrame, n_rows: int) -> tuple[DataFrame, int, bool]:
    """Groups (..., n_group, n_rows) with a number, their tile and over how many parts of points and lots of boxes they
    are dealt; the number of tiles that small groups share, which rows without a group share too; is any group in parts?"""
    groups = stored(groups.withColumn("grp", F.monotonically_increasing_id()), "groups")
    found = groups.agg(F.coalesce(F.sum("n_group"), F.lit(0)).alias("n"), F.coalesce(F.max("n_group"), F.lit(0)).alias("most")).first()
    shared = max(1, -(-(found["n"] + n_rows) // SMALL))
    over = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    tile = F.when(F.col("n_group") + F.col("n_rows") > SMALL, F.col("grp")).otherwise(_shared(F.col("grp"), shared))
    return groups.withColumns({"tile": tile, "parts": over("n_group"), "lots": over("n_rows")}), shared, found["most"] > TILE


def _shared(x: Column, shared: int) -> Column:
    return -1 - F.pmod(F.xxhash64(x), F.lit(shared))


def dealt_points(points: DataFrame, by: str) -> DataFrame:
    """Each in one part of its group's points, for each lot of its boxes."""
    return points.withColumns({"part": F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), "lot": F.explode(F.sequence(F.lit(0), F.col("lots") - 1))}).drop("parts", "lots")


def dealt_boxes(boxes: DataFrame, by: str, shared: int) -> DataFrame:
    """Each in one lot of its group's boxes; those without a group lie in any tile. ``parted`` deals them to all parts."""
    lot = F.coalesce(F.pmod(F.xxhash64(by), F.col("lots")).cast("int"), F.lit(0))
    out = boxes.withColumns({"lot": lot, "tile": F.coalesce("tile", _shared(F.col(by), shared)), "grp": F.coalesce("grp", F.lit(-1).cast("bigint")), "parts": F.coalesce("parts", F.lit(1))})
    return out.drop("lots")


def parted(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _array(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, and which are known."""
    x = table.column(name).combine_chunks()
    known = np.asarray(x.is_valid())
    return x.fill_null(0).to_numpy(zero_copy_only=False), known


def _places(points: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values of a coordinate, and each point's place among them: behind all if it is null or not a number."""
    c, known = _array(points, f"c{d}")
    known = known & (c == c)
    values = np.unique(c[known])
    return values, np.where(known, np.searchsorted(values, c), len(values))


class _Index:
    """Points by code and places, the first dimension sorted and the others cut by halves, to be asked for boxes."""

    def __init__(self, codes: np.ndarray, places: Sequence[np.ndarray], sizes: Sequence[int]):
        self.known = np.unique(codes)
        self.width = sizes[-1] + 2
        own = np.searchsorted(self.known, codes)
        if len(places) == 1:
            keys = own * self.width + places[0]
            self.order = np.argsort(keys, kind="stable")
            self.keys = keys[self.order]
        else:
            self.levels = [_Index(own * self.width + (places[-1] >> level), places[:-1], sizes[:-1]) for level in range(int(sizes[-1]).bit_length() + 1)]

    def runs(self, codes: np.ndarray, lo: Sequence[np.ndarray], hi: Sequence[np.ndarray], boxes: np.ndarray) -> Iterator[tuple[np.ndarray, _Index, np.ndarray, np.ndarray]]:
        """The boxes [lo, hi) as runs of the sorted points: box, the index, first, past the last."""
        if not len(self.known):
            return
        own = np.searchsorted(self.known, codes)
        own[own == len(self.known)] = 0
        some = self.known[own] == codes
        for a, b in zip(lo, hi, strict=True):
            some &= a < b
        own, boxes, lo, hi = own[some], boxes[some], [x[some] for x in lo], [x[some] for x in hi]
        if not len(boxes):
            return
        if len(lo) == 1:
            yield boxes, self, np.searchsorted(self.keys, own * self.width + lo[0]), np.searchsorted(self.keys, own * self.width + hi[0])
            return
        for level, below in enumerate(self.levels):
            x, y = (lo[-1] + (1 << level) - 1) >> level, hi[-1] >> level
            for node, taken in ((x, (x & 1 == 1) & (x < y)), (y - 1, (y & 1 == 1) & (x + (x & 1) < y))):
                if taken.any():
                    yield from below.runs((own * self.width + node)[taken], [a[taken] for a in lo[:-1]], [b[taken] for b in hi[:-1]], boxes[taken])


def _ordered(places: dict[int, tuple[np.ndarray, np.ndarray]], dims: Sequence[int]) -> list[int]:
    return sorted(dims, key=lambda d: -len(places[d][0]))


def _built(points: pa.Table, places: dict[int, tuple[np.ndarray, np.ndarray]], dims: Sequence[int]) -> _Index:
    return _Index(_array(points, "grp")[0], [places[d][1] for d in dims], [len(places[d][0]) for d in dims])


def _counter(dim_of: Sequence[int], kept: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def count(rows: pa.Table, points: pa.Table) -> pa.Table:
        places = {d: _places(points, d) for d in set(dim_of)}
        codes, n = _array(rows, "grp")[0], rows.num_rows
        bounds = []
        for f, d in enumerate(dim_of):
            (lo, asked), (hi, _) = _array(rows, f"lo{f}"), _array(rows, f"hi{f}")
            bounds.append((asked, np.searchsorted(places[d][0], lo), np.where(hi == hi, np.searchsorted(places[d][0], hi, "right"), 0)))
        built, out = {}, {name: rows.column(name) for name in kept}
        for mask in range(1, 1 << len(dim_of)):
            of = [f for f in range(len(dim_of)) if mask >> f & 1]
            dims = _ordered(places, sorted({dim_of[f] for f in of}))
            asked = np.nonzero(np.logical_and.reduce([bounds[f][0] for f in of]))[0]
            lo = [np.maximum.reduce([bounds[f][1][asked] for f in of if dim_of[f] == d]) for d in dims]
            hi = [np.minimum.reduce([bounds[f][2][asked] for f in of if dim_of[f] == d]) for d in dims]
            if tuple(dims) not in built:
                built[tuple(dims)] = _built(points, places, dims)
            sums = np.zeros(n, np.int64)
            for boxes, _, first, past in built[tuple(dims)].runs(codes[asked], lo, hi, asked):
                sums += np.bincount(boxes, past - first, n).astype(np.int64)
            out[f"n{mask}"] = pa.array(sums)
        return pa.table(out)

    return count


def counts_by_subset(rows: DataFrame, points: DataFrame, dim_of: Sequence[int], kept: Sequence[str], in_parts: bool) -> DataFrame:
    """kept and n1, n2, ...: for every set of filters (bit f: filter f) the points that pass them all, 0 unless all concern the row.

    Rows (tile, lot, parts, grp, lo0, hi0, lo1, hi1, ...): an interval for each filter, both ends included, null where it does
    not concern the row; filter f cuts dimension dim_of[f]. Points: tile, part, lot, grp, c0, c1, ...
    """
    asked = parted(rows) if in_parts else rows.withColumn("part", F.lit(0))
    sets = [f"n{mask}" for mask in range(1, 1 << len(dim_of))]
    out = StructType([*asked.select(*kept).schema, *[StructField(c, LongType()) for c in sets]])
    found = asked.groupBy(*_AT).cogroup(points.groupBy(*_AT)).applyInArrow(_counter(dim_of, kept), out)
    return found.groupBy(*kept).agg(*[F.sum(c).alias(c) for c in sets]) if in_parts else found


def _summer(dims: Sequence[int], columns: Sequence[str], kept: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def add_up(rows: pa.Table, points: pa.Table) -> pa.Table:
        places = {d: _places(points, d) for d in dims}
        n, ordered, lo, hi = points.num_rows, _ordered(places, dims), [], []
        for d in ordered:
            (a, below), (b, above) = _array(rows, f"lo{d}"), _array(rows, f"hi{d}")
            lo.append(np.where(below, np.searchsorted(places[d][0], a), 0))
            hi.append(np.where(above, np.searchsorted(places[d][0], b, "right"), len(places[d][0]) + 1))
        weights = {c: _array(rows, c)[0].astype(float) for c in columns}
        sums = {c: np.zeros(n) for c in columns}
        for boxes, index, first, past in _built(points, places, ordered).runs(_array(rows, "grp")[0], lo, hi, np.arange(rows.num_rows)):
            for c in columns:
                w = weights[c][boxes]
                opened = np.bincount(first, w, n + 1).astype(np.longdouble) - np.bincount(past, w, n + 1)
                sums[c][index.order] += np.cumsum(opened)[:n].astype(float)
        return pa.table({name: points.column(name) for name in kept} | {c: pa.array(sums[c]) for c in columns})

    return add_up


def box_sums(rows: DataFrame, points: DataFrame, dims: Sequence[int], columns: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """kept and, for each column of the boxes, its sum over those of a tile that hold the point: one row a point and lot.

    Rows (tile, lot, parts, grp, the columns, lo0, hi0, ...): bounds by dimension, both included, null without a bound. Sums
    of doubles are differences of prefix sums, of more bits than a double where the machine has them, so a sum of no box
    may be off 0 by rounding; one of whole numbers is not.
    """
    out = StructType([*points.select(*kept).schema, *[StructField(c, DoubleType()) for c in columns]])
    return parted(rows).groupBy(*_AT).cogroup(points.groupBy(*_AT)).applyInArrow(_summer(dims, columns, kept), out)
