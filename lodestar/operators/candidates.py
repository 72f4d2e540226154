"""Hierarchical candidate matching.

Records know a coarse key, perhaps a zone, and perhaps values; entities have the
same attributes. Candidates of a record are the entities with its key and zone;
if a zone has none, weaker forms of the zone are tried in order, and the first
that has any counts. Then attribute filters apply, each only where it leaves the
record a candidate. Null keys never match.

Records that agree in all of that share their candidates, so the plan works on
distinct profiles with a multiplicity. Which zone counts is settled on distinct
(key, zone) pairs and the sizes of the entities' groups, before any candidate is
made. A profile stays a pointer to its group until a filter bites: filters over
a range join on buckets of the value, so only candidates that pass are made, and
a profile without a filter that bites is one row for its whole group.

Where numbers of candidates will do, none is made: every filter keeps an interval
of the entity's value, so a record's candidates are a box in its group, and boxes
are counted by ``boxes``, for all filters at once. Numbers count as doubles there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType

from ..functions.scalars import canonical_zone, stripped_zone
from ..storage import stored
from .boxes import counts_by_subset, dealt_boxes, dealt_points, numbered


@dataclass(frozen=True)
class Columns:
    """Names of the columns on both sides; values are optional."""

    record: str = "record_id"
    entity: str = "entity_id"
    key: str = "key"
    zone: str = "zone"


@dataclass(frozen=True)
class Filter:
    """An attribute filter: a test over the record's and the entity's column; skipped where the record's value is null.

    ``zone``: the filter only concerns records of that normalised zone. ``strict``: it applies even where it leaves a
    record no candidate, and a record without the value has none.
    """

    record: str
    entity: str
    kind: str  # within, percent, years, equal, at_most
    tolerance: float = 0.0
    zone: str | None = None
    strict: bool = False

    def test(self, entity: str = "e_") -> Column:
        """Over r_ and e_ columns; ``entity``: what stands before the entity's name."""
        r, e = F.col(f"r_{self.record}") if self.kind != "at_most" else None, F.col(f"{entity}{self.entity}")
        if self.kind == "within":
            ok = F.abs(e - r) <= self.tolerance
        elif self.kind == "percent":
            t = self.tolerance / 100.0
            ok = (e > 0) & (e >= r * (1 - t)) & (e <= r * (1 + t))
        elif self.kind == "years":
            ok = F.abs(e.cast("int") - r.cast("int")) <= int(self.tolerance)
        elif self.kind == "equal":
            ok = e == r
        elif self.kind == "at_most":
            ok = e <= self.tolerance
        else:
            raise ValueError(f"unknown filter {self.kind}")
        return F.coalesce(ok, F.lit(False))

    def applies(self) -> Column:
        """Does the filter concern the record?"""
        known = F.lit(True) if self.kind == "at_most" or self.strict else F.col(f"r_{self.record}").isNotNull()
        return known if self.zone is None else known & F.coalesce(canonical_zone(F.col("zone")) == self.zone, F.lit(False))

    def dimension(self) -> tuple[str, str]:
        """The entity's column, and as what it counts."""
        return self.entity, {"years": "year", "equal": "same"}.get(self.kind, "number")

    def interval(self, record: DataType | None, entity: DataType) -> tuple[Column, Column]:
        """The least and the largest coordinate that passes, over r_ columns; none passes if the first is above the second."""
        empty = lambda ok, lo, hi: (F.when(ok, lo).otherwise(F.lit(1.0)), F.when(ok, hi).otherwise(F.lit(0.0)))
        t = self.tolerance
        if self.kind == "at_most":
            return F.lit(float("-inf")), F.lit(float(t))
        r = F.col(f"r_{self.record}")
        if self.kind == "within":
            r, t = r.cast("double"), float(t)
            return empty((F.abs(r) < float("inf")) & F.lit(t >= 0), least_within(r, max(t, 0.0)), -least_within(-r, max(t, 0.0)))
        if self.kind == "percent":
            r, t = r.cast("double"), t / 100.0
            least = F.greatest(r * (1 - t), F.lit(5e-324))  # above 0
            return empty(r.isNotNull() & ~F.isnan(r * (1 - t)) & ~F.isnan(r * (1 + t)), least, r * (1 + t))
        if self.kind == "years":
            at = r.cast("int").cast("double")
            return empty(at.isNotNull(), at - int(t), at + int(t))
        at = _coordinate(r, "same", record, entity)
        if _coordinate_type("same", record, entity) == "double":
            return empty(at.isNotNull() & ~F.isnan(at), at, at)
        return F.coalesce(at, F.lit(1)), F.coalesce(at, F.lit(0))

    def buckets(self) -> tuple[Column, Column]:
        """The record's bucket, and those of which an entity that passes has one, as an array."""
        if self.kind == "at_most":
            return F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"))
        r, e = F.col(f"r_{self.record}"), F.col(f"e_{self.entity}")
        if self.kind == "percent" and self.tolerance < 100:
            t = self.tolerance / 100.0  # what passes lies within this factor, so in the logarithm's bucket or one beside it
            width = math.log((1 + t) / (1 - t)) or 1e-6
            r, e = F.when(r > 0, F.ln(r)), F.when(e > 0, F.ln(e))
        elif self.kind in ("within", "years") and self.tolerance > 0:
            width = float(self.tolerance)
            if self.kind == "years":
                r, e = r.cast("int"), e.cast("int")
        elif self.kind == "equal":
            return F.xxhash64(r), F.array(F.xxhash64(e))
        else:
            return F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"))
        at = F.floor(e / F.lit(width)).cast("bigint")
        return F.floor(r / F.lit(width)).cast("bigint"), F.when(at.isNotNull(), F.array(at - 1, at, at + 1))


def least_within(r: Column, t: float) -> Column:
    """The least double e with abs(e - r) <= t, as doubles are subtracted; the greatest is that of -r, negated.

    A difference rounds to t up to half a step beyond it. That bound is kept with its rounding error, exactly.
    """
    half = (math.nextafter(t, math.inf) - t) / 2
    odd = bool(int(math.ldexp(math.frexp(t)[0], 53)) % 2)  # a difference halfway to the next double is rounded away

    def added(a: Column, b: Column) -> tuple[Column, Column]:
        x = a + b
        return x, (a - (x - (x - a))) + (b - (x - a))

    near, off = added(r, F.lit(-t))
    y, left = added(near, off - half)
    after = F.when(y == 0, F.lit(5e-324)).otherwise(y + F.abs(y) * (2.0**-53 * (1 + 2.0**-10)))
    return F.when(left >= 0 if odd else left > 0, after).otherwise(y)


def _coordinate_type(kind: str, record: DataType | None, entity: DataType) -> str:
    if kind != "same" or isinstance(entity, NumericType) and isinstance(record, NumericType) and not (isinstance(entity, IntegralType) and isinstance(record, IntegralType)):
        return "double"
    return "bigint"


def _coordinate(x: Column, kind: str, record: DataType | None, entity: DataType) -> Column:
    """What a value counts as: a double, a year, an integer, or 64 bits that stand for anything else that can only be equal."""
    if kind == "year":
        return x.cast("int").cast("double")
    if _coordinate_type(kind, record, entity) == "double":
        return x.cast("double")
    return x.cast("bigint") if isinstance(entity, IntegralType) and isinstance(record, IntegralType) else F.when(x.isNotNull(), F.xxhash64(x.cast("string")))


@dataclass(frozen=True)
class Matching:
    """variant: chain (weaker zones, key alone without a zone), strict (chain, but a zone is needed), canonical (normalised zones)."""

    variant: str = "chain"
    use_zone: bool = True
    filters: tuple[Filter, ...] = ()
    columns: Columns = field(default_factory=Columns)


def _attempts(m: Matching) -> Column:
    """The zones to try, in order of priority; a null zone stands for the key alone."""
    zone = F.upper(F.col("zone"))
    alone = F.array(F.struct(F.lit(0).alias("priority"), F.lit(None).cast("string").alias("z")))
    none = F.slice(alone, 1, 0)
    if not m.use_zone:
        return alone
    if m.variant == "canonical":
        return F.when(F.col("zone").isNull(), none).otherwise(F.array(F.struct(F.lit(0).alias("priority"), canonical_zone(F.col("zone")).alias("z"))))
    weaker = F.array(F.struct(F.lit(0).alias("priority"), zone.alias("z")), F.struct(F.lit(1).alias("priority"), F.when(stripped_zone(zone) != zone, stripped_zone(zone)).alias("z")), F.struct(F.lit(2).alias("priority"), F.when(zone == "B", F.lit("X")).alias("z")))
    return F.when(F.col("zone").isNull(), alone if m.variant == "chain" else none).otherwise(F.filter(weaker, lambda x: x["z"].isNotNull()))


def profiles(records: DataFrame, m: Matching, also: Sequence[str] = ()) -> DataFrame:
    """Distinct (key, zone, filter values) of each record as a struct; also: further columns to keep."""
    c = m.columns
    names = list(dict.fromkeys(f.record for f in m.filters if f.kind != "at_most"))
    zoned = m.use_zone or any(f.zone for f in m.filters)
    keyed = records.select(F.col(c.record).alias("record"), F.col(c.key).cast("string").alias("key"), (F.col(c.zone).cast("string") if zoned else F.lit(None).cast("string")).alias("zone"), *[F.col(x).alias(f"r_{x}") for x in names], *also)
    parts = ["key", "zone", *[f"r_{x}" for x in names]]
    return keyed.withColumn("profile", F.struct(*parts))


#: Stands for a key's entities of all zones; zones themselves begin with another letter.
ALL = "*"


def _members(entities: DataFrame, m: Matching, also: Sequence[str] = ()) -> DataFrame:
    """k, g, entity and the filters' values: each entity in the groups of its key that records can point to; also: further columns to keep."""
    c = m.columns
    used = list(dict.fromkeys(f.entity for f in m.filters))
    zone = canonical_zone(F.col(c.zone)) if m.variant == "canonical" else F.upper(F.col(c.zone))
    own = F.concat(F.lit("="), zone)
    groups = F.array(F.lit(ALL)) if not m.use_zone else F.array(own, F.lit(ALL)) if m.variant == "chain" else F.array(own)
    theirs = entities.where(F.col(c.key).isNotNull()).select(F.col(c.entity).alias("entity"), F.col(c.key).cast("string").alias("k"), F.explode(groups).alias("g"), *[F.col(x).alias(f"e_{x}") for x in used], *also)
    return theirs.where(F.col("g").isNotNull())


def _settled(records: DataFrame, members: DataFrame, m: Matching) -> DataFrame:
    """profile, its parts, n_records, g and n_group: the group that each distinct profile points to, if it has members."""
    mine = profiles(records, m).where(F.col("key").isNotNull()).groupBy("profile").agg(F.count(F.lit(1)).alias("n_records")).select("profile", "n_records", "profile.*")
    best = _best(mine.select("key", "zone").distinct(), members, m).select(F.col("key").alias("bk"), F.col("zone").alias("bz"), "g", "n_group")
    return mine.join(best, (F.col("key") == F.col("bk")) & F.col("zone").eqNullSafe(F.col("bz"))).drop("bk", "bz")


def _best(zones: DataFrame, members: DataFrame, m: Matching) -> DataFrame:
    """key, zone, g and n_group of the distinct pairs (key, zone) that find members: the group of the first attempt that does."""
    tried = zones.select("key", "zone", F.explode(_attempts(m)).alias("a"))
    tried = tried.select("key", "zone", "a.priority", F.coalesce(F.concat(F.lit("="), F.col("a.z")), F.lit(ALL)).alias("z"))
    sizes = members.groupBy("k", "g").agg(F.count(F.lit(1)).alias("n_group"))
    there = tried.join(sizes, (F.col("key") == F.col("k")) & (F.col("z") == F.col("g")))
    return there.groupBy("key", "zone").agg(F.min_by(F.struct("g", "n_group"), "priority").alias("b")).select("key", "zone", "b.g", "b.n_group")


def grouped(records: DataFrame, entities: DataFrame, of_record: Column, of_entity: Column, m: Matching = Matching()) -> tuple[DataFrame, DataFrame]:
    """record, key, g, x of the records that have candidates, and entity, key, g, x of the entities in the groups; without
    filters a record's candidates are the entities with its key and g. x: a value of each."""
    if m.filters:
        raise ValueError("candidates by group are without filters")
    theirs = _members(entities.withColumn("_x", of_entity), m, ("_x",))
    to = _settled(records, theirs, m).select("profile", "g")
    mine = profiles(records.withColumn("_x", of_record), m, ("_x",)).join(to, "profile").select("record", "key", "g", F.col("_x").alias("x"))
    return mine, theirs.select("entity", F.col("k").alias("key"), "g", F.col("_x").alias("x"))


def filtered(records: DataFrame, entities: DataFrame, m: Matching) -> tuple[DataFrame, DataFrame]:
    """Rows (profile, n_records, key, g, n_group, entity): a null entity stands for all members of the group; and the members (k, g, entity).

    Filters apply in order. One join each: rows that are still a whole group meet the members that pass, rows that are
    candidates already pass by.
    """
    theirs = _members(entities, m)
    rows = _settled(records, theirs, m).withColumn("entity", F.lit(None).cast(theirs.schema["entity"].dataType))
    used = [c for c in theirs.columns if c.startswith("e_")]
    rows = rows.withColumns({c: F.lit(None).cast(theirs.schema[c].dataType) for c in used})
    own = W.partitionBy("profile")
    for i, f in enumerate(m.filters):
        whole = F.col("entity").isNull()
        if i:  # candidates made by the filters before
            ok = whole | ~f.applies() | f.test()
            rows = rows.withColumn("ok", ok)
            rows = rows.where("ok") if f.strict else rows.withColumn("any_ok", F.max("ok").over(own)).where(F.col("ok") | ~F.col("any_ok")).drop("any_ok")
            rows = rows.drop("ok")
        at, passing = f.buckets()
        some = theirs.select(F.col("k").alias("_k"), F.col("g").alias("_g"), F.col("entity").alias("_entity"), *[F.col(c).alias(f"_{c}") for c in used], F.explode(passing).alias("_at"))
        asked = rows.withColumn("at", F.when(whole & f.applies(), at))
        test = f.test("_e_")
        joined = asked.join(some, (F.col("key") == F.col("_k")) & (F.col("g") == F.col("_g")) & (F.col("at") == F.col("_at")) & test, "left")
        if f.strict:
            joined = joined.where(~(whole & f.applies()) | F.col("_entity").isNotNull())
        rows = joined.select(*[c for c in rows.columns if c != "entity" and c not in used], F.coalesce("entity", "_entity").alias("entity"), *[F.when(F.col("_entity").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in used])
    return rows.select("profile", "n_records", "key", "g", "n_group", "entity"), theirs.select("k", "g", "entity")


def bounded(keyed: DataFrame, own: Sequence[str], entities: DataFrame, m: Matching) -> tuple[DataFrame, DataFrame, list[int]]:
    """own, n, where its candidates are counted (tile, lot, parts, grp) and lo0, hi0, ...: the box in its group that holds
    them, a bound null where there is none; the group's members (tile, part, lot, grp, entity, c0, ...); the dimensions.

    keyed: rows of ``profiles``, or of distinct ones; own: the columns that tell its rows apart. Every row comes back, with
    n = 0 without a candidate. Filters apply in order: each cuts the boxes of the rows that it concerns, and where nothing
    is left the box stays as it was, or with a strict filter n is 0. So one count for each set of filters decides.
    """
    theirs = _members(entities, m)
    n_of = F.sum("n_records") if "n_records" in own else F.count(F.lit(1))
    zones = stored(keyed.groupBy("key", "zone").agg(n_of.alias("n_rows")), "zones")
    best = _best(zones, theirs, m).withColumnsRenamed({"key": "bk", "zone": "bz"})
    zones = stored(zones.join(best, (F.col("key") == F.col("bk")) & F.col("zone").eqNullSafe(F.col("bz")), "left").drop("bk", "bz"), "zones", replaces=zones)
    n_rows = zones.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    groups, shared, in_parts = numbered(zones.where("g is not null").groupBy("key", "g").agg(F.max("n_group").alias("n_group"), F.sum("n_rows").alias("n_rows")), n_rows)
    deal = ["grp", "tile", "parts", "lots"]
    to = zones.join(groups.select(F.col("key").alias("gk"), F.col("g").alias("gg"), *deal), (F.col("key") == F.col("gk")) & (F.col("g") == F.col("gg")), "left")
    to = to.select(F.col("key").alias("bk"), F.col("zone").alias("bz"), "n_group", *deal)
    rows = keyed.join(to, F.col("key").eqNullSafe(F.col("bk")) & F.col("zone").eqNullSafe(F.col("bz")))

    type_of = lambda df, c: df.schema[c].dataType if c in df.columns else None
    named = {}
    for f in m.filters:
        named.setdefault(f.dimension(), (f.dimension()[1], type_of(rows, f"r_{f.record}"), type_of(theirs, f"e_{f.entity}")))
    at = {x: i for i, x in enumerate(named)}
    dim_of = [at[f.dimension()] for f in m.filters]
    members = theirs.join(groups.select("key", "g", *deal), (F.col("k") == F.col("key")) & (theirs["g"] == groups["g"]))
    members = dealt_points(members.select("entity", *deal, *[_coordinate(F.col(f"e_{x[0]}"), *named[x]).alias(f"c{i}") for x, i in at.items()]), "entity")
    ends = {}
    for f, filter_ in enumerate(m.filters):
        lo, hi = filter_.interval(named[filter_.dimension()][1], named[filter_.dimension()][2])
        ends |= {f"lo{f}": F.when(filter_.applies(), lo), f"hi{f}": F.when(filter_.applies(), hi)}
    asked = dealt_boxes(rows.select(*own, F.coalesce("n_group", F.lit(0)).alias("n_group"), *deal, *[x.alias(c) for c, x in ends.items()]), own[0], shared)
    kept = [*own, "tile", "lot", "parts", "grp", "n_group", *ends]
    counts = counts_by_subset(asked, members, dim_of, kept, in_parts).withColumn("_sets", F.array("n_group", *[f"n{s}" for s in range(1, 1 << len(m.filters))]))
    state, none = F.lit(0), F.lit(False)
    for f, filter_ in enumerate(m.filters):
        counts = counts.withColumn(f"_s{f}", state)  # the set of filters that have cut the box so far
        more = F.get("_sets", F.col(f"_s{f}") + (1 << f)) > 0
        if filter_.strict:
            none = none | F.col(f"lo{f}").isNotNull() & ~more
        state = F.when(more, F.col(f"_s{f}") + (1 << f)).otherwise(F.col(f"_s{f}"))
    counts = counts.withColumn("_s", state)
    n = F.when(none, F.lit(0).cast("bigint")).otherwise(F.get("_sets", "_s"))

    def cut(end: str, d: int, pick: Callable[..., Column]) -> Column:
        of = [F.when(F.col("_s").bitwiseAND(F.lit(1 << f)) > 0, F.col(f"{end}{f}")) for f in range(len(dim_of)) if dim_of[f] == d]
        return pick(*of) if len(of) > 1 else of[0]

    box = [cut(end, d, pick).alias(f"{end}{d}") for d in at.values() for end, pick in (("lo", F.greatest), ("hi", F.least))]
    return counts.select(*own, "tile", "lot", "parts", "grp", n.alias("n"), *box), members, list(at.values())


def candidates(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """profile, n_records and entity: one row for each distinct profile and each of its candidates."""
    rows, members = filtered(records, entities, m)
    theirs = members.select("k", F.col("g").alias("_g"), F.col("entity").alias("_entity"))
    out = rows.join(theirs, F.col("entity").isNull() & (F.col("key") == F.col("k")) & (F.col("g") == F.col("_g")), "left")
    return out.select("profile", "n_records", F.coalesce("entity", "_entity").alias("entity"))


def sized_candidates(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """profile, n_records, entity and n, the number of the profile's candidates: of a whole group it is known before."""
    rows, members = filtered(records, entities, m)
    if m.filters:
        rows = rows.withColumn("n", F.when(F.col("entity").isNull(), F.col("n_group")).otherwise(F.count(F.lit(1)).over(W.partitionBy("profile"))))
    else:
        rows = rows.withColumn("n", F.col("n_group"))
    theirs = members.select("k", F.col("g").alias("_g"), F.col("entity").alias("_entity"))
    out = rows.join(theirs, F.col("entity").isNull() & (F.col("key") == F.col("k")) & (F.col("g") == F.col("_g")), "left")
    return out.select("profile", "n_records", F.coalesce("entity", "_entity").alias("entity"), "n")


def candidate_pairs(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """record, entity: every candidate of every record."""
    return profiles(records, m).select("record", "profile").join(candidates(records, entities, m).drop("n_records"), "profile").select("record", "entity")


def profile_sizes(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """profile, n_records and n, the number of its candidates, none of which is made; only profiles that have one."""
    if not m.filters:
        return _settled(records, _members(entities, m), m).select("profile", "n_records", F.col("n_group").alias("n"))
    mine = profiles(records, m).groupBy("profile").agg(F.count(F.lit(1)).alias("n_records")).select("profile", "n_records", "profile.*")
    return bounded(mine, ("profile", "n_records"), entities, m)[0].where("n > 0").select("profile", "n_records", "n")


def record_stats(records: DataFrame, entities: DataFrame, m: Matching = Matching()) -> DataFrame:
    """record, n_candidates, matched: one row per record, matched or not."""
    if m.filters:
        counts = bounded(profiles(records, m).drop("profile"), ("record",), entities, m)[0]
        return counts.select("record", F.col("n").alias("n_candidates"), (F.col("n") > 0).alias("matched"))
    counts = profile_sizes(records, entities, m).select("profile", "n")
    mine = profiles(records, m).select("record", "profile")
    joined = mine.join(counts, mine["profile"].eqNullSafe(counts["profile"]), "left")
    return joined.select("record", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"), (F.coalesce("n", F.lit(0)) > 0).alias("matched"))
