"""MinHash near-dedup with odd sketches.

1. Every document's set of word shingles gives MinHash values for banding and
   one-permutation MinHash samples (the smallest hash in each of ``bins``
   parts), folded into a parity bitmap: each sample flips one bit. Documents
   with equal sets (128 bits and the size stand for a set) form a class; only
   one of each goes on.
2. Classes that share a band are candidates. In every bucket the class that
   meets most others leads, and the others pair with it, so a bucket gives a
   star and not all its pairs. The XOR of two bitmaps counts the samples in
   which two sets differ, which tells high similarities apart; pairs that are
   clearly too far are dropped, by five standard deviations.
3. What is left is confirmed on the full sets: the set of one side is sent to
   the block of the other, once a block.
4. Classes joined by buckets form a cluster. Where a cluster still holds several
components, its full sets are compared in chunks of bounded size, every two
chunks once: bitmaps first, then exact intersections, and only links that join
components leave the chunk. So a link beside the leader is not lost, and no
pairs are sent.

Bands are chosen so that a pair at the threshold shares none with probability
under ``miss``. Links lead to components by smallest id.

Defined cases: null and empty texts, and texts without words, have an empty set,
are linked with nothing and kept; texts of fewer words than a shingle have the
whole sequence as one shingle; rows with one id are separate documents (ordered
by text) with one component_id; null ids come last; an empty table gives an
empty result; very long texts are one set of their shingles; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import block_bounds, blocked, in_order
from .common import partitions, stored
from .components import components
from .text import Texts, inside, mix, owners, range_hashes, window_hashes

U64 = np.uint64
BINS, BITS, ROWS = 1024, 2048, 4


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in order, and their offsets."""
    low = texts.lowered()
    starts, ends, at = low.words()
    prints = range_hashes(low.data, starts, ends)
    ok = np.flatnonzero(inside(at, words))
    values = window_hashes(prints, words)[ok] if len(ok) else np.zeros(0, U64)
    doc = owners(at)
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < words))
    if len(few):
        whole = np.zeros(len(few), U64)
        for k in range(1, words):
            some = np.diff(at)[few] == k
            if some.any():
                whole[some] = window_hashes(prints, k, k)[at[few[some]]]
        values = np.concatenate([values, whole])
    doc = np.concatenate([doc[ok], few])
    by = np.lexsort((values, doc))
    values, doc = values[by], doc[by]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def odd_sketches(values: np.ndarray, doc: np.ndarray, m: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the one-permutation samples of m sets (doc: the set of each value, in order), and the numbers of samples.

    ``step`` sets at a time, as each takes its bins and bits as whole numbers for a moment.
    """
    none = U64((1 << 64) - 1)
    sketch, samples = np.zeros((m, BITS // 8), np.uint8), np.zeros(m, np.int64)
    for a in range(0, m, step):
        n = min(step, m - a)
        lo, hi = np.searchsorted(doc, [a, a + n])
        least = np.full(n * BINS, none)
        other = mix(values[lo:hi] ^ U64(0xD1342543DE82EF95))
        np.minimum.at(least, (doc[lo:hi] - a) * BINS + (other >> U64(64 - 10)).astype(np.int64), other)
        filled = least != none
        at_bit = (mix(least[filled]) >> U64(64 - 11)).astype(np.int64)
        flips = np.bincount(np.flatnonzero(filled) // BINS * BITS + at_bit, minlength=n * BITS) & 1
        sketch[a : a + n] = np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1)
        samples[a : a + n] = filled.reshape(n, BINS).sum(1)
    return sketch, samples


def signatures(values: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty set: a fingerprint in two halves of 64 bits, band hashes, parity bitmap and number of samples."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    cuts, doc = at[:-1][full], np.repeat(np.arange(len(full)), n[full])
    m = len(full)
    whole = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), cuts) if m else np.zeros(0, U64)
    whole = mix(whole + n[full].astype(U64))
    other = mix(np.add.reduceat(mix(values * U64(0x9E3779B97F4A7C15) ^ U64(0x2545F4914F6CDD1D)), cuts)) if m else np.zeros(0, U64)
    draw = np.random.default_rng(20240229)
    mins = np.empty((bands * ROWS, m), U64)
    for i in range(bands * ROWS):
        a, b = draw.integers(1, 1 << 63, 2, dtype=U64)
        mins[i] = np.minimum.reduceat((values ^ (values >> U64(29))) * (a | U64(1)) + b, cuts) if m else 0
    keys = np.zeros((bands, m), U64)
    for b in range(bands):
        h = np.full(m, U64(b + 1))
        for i in range(ROWS):
            h = mix(h * U64(0x9E3779B97F4A7C15) + mins[b * ROWS + i])
        keys[b] = h
    sketch, samples = odd_sketches(values, doc, m)
    return whole, other, keys, sketch, samples


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, mx: np.ndarray, my: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two bitmaps (rows of 64-bit words) allow a similarity of the threshold, with five standard deviations to spare."""
    fits = np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9
    odd = np.bitwise_count(x ^ y).sum(-1).astype(float)
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * odd / BITS, 1e-3))  # samples in one of the two only
    samples = (mx + my) / 2
    allowed = 2 * samples * (1 - threshold) / (1 + threshold)
    # in a full bin a shingle of one set can hide a common one; small sets have few full bins, large ones are sampled
    crowded = np.minimum(1.0, np.maximum(nx, ny) / BINS)
    sampling = 2 * allowed * crowded
    folding = np.maximum(BITS / 4 * (np.exp(4 * allowed / BITS) - 1) - allowed, 0)
    return fits & (differ <= allowed * (1 + crowded) + 5 * np.sqrt(sampling + folding) + 3)


def band_count(threshold: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, and n_links (links of its class among the pairs confirmed)."""
    return _decide(docs, id_col, text_col, **params).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each group, with its columns unchanged."""
    bounds = block_bounds(docs, id_col)
    gone = _decide(docs, id_col, text_col, bounds=bounds, **params).where(~F.col("kept")).select("block", "uid").repartition(partitions(docs.sparkSession), "block")
    kind = docs.schema

    def keep(block: pa.Table, dropped: pa.Table) -> pa.Table:
        block = in_order(block)
        mask = np.ones(block.num_rows, bool)
        if block.num_rows:
            mask[dropped.column("uid").to_numpy() - (block.column("rank")[0].as_py() << 32)] = False
        return block.filter(pa.array(mask)).select(["row"])

    rows = blocked(docs, id_col, text_col, carry=True, bounds=bounds)
    return rows.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(keep, f"row {kind.simpleString()}").select("row.*")


def _decide(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, miss: float = 2e-8, chunk: int = 1500, bounds: tuple[list, int] | None = None) -> DataFrame:
    """uid (place in the order of documents), block, id, n_shingles, component_id, kept and n_links."""
    spark = docs.sparkSession
    n, id_type = partitions(spark), docs.schema[id_col].dataType.simpleString()
    bands = band_count(threshold, miss)
    percent = round(threshold * 100)
    texts = blocked(docs, id_col, text_col, bounds=bounds)

    def sign(block: pa.Table) -> pa.Table:
        block = in_order(block)
        base = (block.column("rank")[0].as_py() << 32) if block.num_rows else 0
        out = []
        for a, part in Texts.of(block.column("text")).parts(2 << 20):
            values, at = shingle_sets(part, words)
            size = np.diff(at)
            whole, other, keys, sketch, samples = signatures(values, at, bands)
            full = size > 0
            place = np.full(len(part), -1)
            place[full] = np.arange(int(full.sum()))
            pick = pa.array(np.where(full, place, 0), mask=~full)
            take = lambda x: x.take(pick)
            band = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * bands, pa.int32()), pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel()))
            out.append(pa.table({"uid": pa.array(base + np.arange(a, a + len(part))), "id": block.column("id").slice(a, len(part)).combine_chunks(), "block": pa.array(np.full(len(part), block.column("block")[0].as_py()), pa.int32()), "n": pa.array(size.astype(np.int64)), "m": take(pa.array(samples.astype(np.int64))), "whole": take(pa.array(whole.view(np.int64))), "other": take(pa.array(other.view(np.int64))), "bands": take(band), "sketch": take(pa.array([x.tobytes() for x in sketch], pa.binary()))}, schema=None))
        names = ["uid", "id", "block", "n", "m", "whole", "other", "bands", "sketch"]
        return pa.concat_tables(out).select(names) if out else pa.table({k: [] for k in names})

    sig = stored(texts.groupBy("block").applyInArrow(sign, f"uid long, id {id_type}, block int, n long, m long, whole long, other long, bands array<long>, sketch binary"), "signatures")
    some = sig.where(F.col("n") > 0)
    classes = stored(some.groupBy("whole", "other", "n").agg(F.min("uid").alias("uid")), "classes")
    reps = some.join(classes.select("uid"), "uid")
    member = reps.select("uid", "n", F.posexplode("bands").alias("band", "key"))
    # buckets of two classes at least; one of those with the same members is enough
    found = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("s"), F.min("uid").alias("lo")).where(F.col("c") > 1)
    buckets = stored(found.groupBy("c", "s", "lo").agg(F.min(F.struct("band", "key")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), "c"), "buckets")
    inner = stored(member.join(buckets, ["band", "key"]), "members")  # uid, n, bucket, c
    met = inner.groupBy("uid").agg(F.sum("c").alias("met"))
    ranked = inner.join(met, "uid")
    leader = ranked.groupBy("band", "key").agg(F.max(F.struct("met", (-F.col("uid")).alias("u"), "n")).alias("l")).select("band", "key", (-F.col("l.u")).alias("lead"), F.col("l.n").alias("lead_n"))
    star = inner.join(leader, ["band", "key"]).where((F.col("uid") != F.col("lead")) & (F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent)).select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct()
    marks = some.select("uid", "block", "n", "m", "sketch")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(batch.num_rows, -1) for c in ("as_", "bs_"))
            num = {c: batch.column(c).to_numpy().astype(float) for c in ("an", "bn", "am", "bm")}
            ok = may_link(x, y, num["an"], num["bn"], num["am"], num["bm"], threshold)
            yield batch.filter(pa.array(ok)).select(["a", "b", "ablock", "bblock"])

    def side(s: str) -> DataFrame:
        return marks.select(F.col("uid").alias(s), F.col("block").alias(f"{s}block"), F.col("n").alias(f"{s}n"), F.col("m").alias(f"{s}m"), F.col("sketch").alias(f"{s}s_"))

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "ablock", "bblock", "an", "bn", "am", "bm", "as_", "bs_").mapInArrow(sift, "a long, b long, ablock int, bblock int")

    def sets_of(block: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """All sets of a block, each in order."""
        block = in_order(block)
        values, at = [], [np.zeros(1, np.int64)]
        for _, part in Texts.of(block.column("text")).parts():
            v, o = shingle_sets(part, words)
            values.append(v)
            at.append(o[1:] + at[-1][-1])
        base = (block.column("rank")[0].as_py() << 32) if block.num_rows else 0
        return np.concatenate(values) if values else np.zeros(0, U64), np.concatenate(at), base

    def send(block: pa.Table, pairs: pa.Table) -> pa.Table:
        """The set of a, once for each block that holds a b, with those bs."""
        rows: dict[str, list] = {k: [] for k in ("bblock", "a", "values", "bs")}
        if pairs.num_rows and block.num_rows:
            values, at, base = sets_of(block)
            for lot in pairs.group_by(["a", "bblock"]).aggregate([("b", "list")]).to_pylist():
                i = lot["a"] - base
                own = values[at[i] : at[i + 1]]
                rows["bblock"].append(lot["bblock"])
                rows["a"].append(lot["a"])
                rows["values"].append(own.tobytes())
                rows["bs"].append(lot["b_list"])
        return pa.table({"bblock": pa.array(rows["bblock"], pa.int32()), "a": pa.array(rows["a"], pa.int64()), "values": pa.array(rows["values"], pa.binary()), "bs": pa.array(rows["bs"], pa.list_(pa.int64()))})

    def confirm(block: pa.Table, sent: pa.Table) -> pa.Table:
        us, vs = [], []
        if sent.num_rows and block.num_rows:
            values, at, base = sets_of(block)
            for lot in zip(sent.column("a"), sent.column("values"), sent.column("bs"), strict=True):
                a, raw, bs = (x.as_py() for x in lot)
                left = np.frombuffer(raw, U64)
                for b in bs:
                    right = values[at[b - base] : at[b - base + 1]]
                    place = np.minimum(np.searchsorted(left, right), len(left) - 1)
                    common = int((left[place] == right).sum())
                    if 100 * common >= percent * (len(left) + len(right) - common):
                        us.append(a)
                        vs.append(b)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    def confirmed(pairs: DataFrame) -> DataFrame:
        at_a = pairs.select(F.col("ablock").alias("block"), "a", "b", "bblock").repartition(n, "block")
        sent = texts.groupBy("block").cogroup(at_a.groupBy("block")).applyInArrow(send, "bblock int, a long, values binary, bs array<long>")
        at_b = sent.withColumnRenamed("bblock", "block").repartition(n, "block")
        return texts.groupBy("block").cogroup(at_b.groupBy("block")).applyInArrow(confirm, "u long, v long")

    links = stored(confirmed(near(star)), "confirmed")
    roots = stored(components(links), "roots")
    # clusters of classes that share buckets, and those that still hold several components
    cluster = components(inner.join(leader, ["band", "key"]).select(F.col("lead").alias("u"), F.col("uid").alias("v")))
    nodes = inner.select("uid").distinct()
    label = lambda df, name: nodes.join(df, nodes["uid"] == df["u"], "left").select("uid", F.coalesce("root", "uid").alias(name))
    placed = stored(label(cluster, "cluster").join(label(roots, "root"), "uid").join(some.select("uid", "block", "n"), "uid"), "clusters")
    split = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("root").alias("r0"), F.max("root").alias("r1")).where(F.col("r0") != F.col("r1"))
    chunks = F.greatest(F.ceil(F.col("c") / chunk), F.ceil(F.col("w") / (chunk * 1000))).cast("int")
    open_ = placed.join(split.select("cluster", chunks.alias("chunks")), "cluster").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))

    def deal(block: pa.Table, wanted: pa.Table) -> pa.Table:
        """The sets of the members of open clusters, once for every two chunks."""
        rows: list[tuple] = []
        if wanted.num_rows and block.num_rows:
            values, at, base = sets_of(block)
            for w in wanted.to_pylist():
                i = w["uid"] - base
                raw = values[at[i] : at[i + 1]].tobytes()
                rows += [(w["cluster"], min(w["own"], k), max(w["own"], k), w["own"], w["uid"], w["root"], raw) for k in range(w["chunks"])]
        names = (("cluster", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.int32()), ("uid", pa.int64()), ("root", pa.int64()), ("values", pa.binary()))
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(names)})

    def cross(group: pa.Table) -> pa.Table:
        """Links between components, of one chunk or between two; each joins components that no other link given joins."""
        group = group.sort_by("uid")
        uid, label_, own = (group.column(c).to_numpy().copy() for c in ("uid", "root", "own"))
        sets = [np.frombuffer(raw.as_py(), U64) for raw in group.column("values")]
        size = np.array([len(x) for x in sets])
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        sketch, samples = odd_sketches(flat, doc, len(sets))
        sketch = sketch.view(U64)
        # shingles of two sets at least, as bits
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.cumsum(count > 1) - 1
        width = int((count > 1).sum())
        bitmap = None
        if len(sets) * width <= 1 << 29:
            bitmap = np.zeros((len(sets), -(-width // 64) * 8), np.uint8)
            shared = count[code] > 1
            bit = common[code[shared]]
            np.bitwise_or.at(bitmap, (doc[shared], bit >> 3), (1 << (bit & 7)).astype(np.uint8))
            bitmap = bitmap.view(U64)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        us, vs = [], []
        real = size.astype(float)
        for i in np.flatnonzero(own == lo):
            j = np.flatnonzero((own == hi) & (label_ != label_[i]) & ((np.arange(len(sets)) > i) | (lo != hi)) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i])))
            if not len(j):
                continue
            j = j[may_link(sketch[i], sketch[j], real[i], real[j], samples[i], samples[j], threshold)]
            for part in (j[a : a + 4096] for a in range(0, len(j), 4096)):
                if bitmap is not None:
                    both = np.bitwise_count(bitmap[i] & bitmap[part]).sum(1).astype(np.int64)
                else:
                    place = lambda k: np.minimum(np.searchsorted(sets[i], sets[k]), size[i] - 1)
                    both = np.array([int((sets[i][place(k)] == sets[k]).sum()) for k in part])
                linked = part[100 * both >= percent * (size[i] + size[part] - both)]
                for label_of in np.unique(label_[linked]):
                    if label_of != label_[i]:
                        us.append(uid[i])
                        vs.append(uid[linked[label_[linked] == label_of][0]])
                        low = min(label_of, label_[i])
                        label_[(label_ == label_of) | (label_ == label_[i])] = low
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    wanted = open_.select("block", "cluster", "own", "chunks", "uid", "root").repartition(n, "block")
    dealt = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(deal, "cluster long, lo int, hi int, own int, uid long, root long, values binary")
    more = stored(dealt.groupBy("cluster", "lo", "hi").applyInArrow(cross, "u long, v long"), "confirmed")
    every = links.unionByName(more)
    # the components so far are stars already
    final = components(roots.select(F.col("u"), F.col("root").alias("v")).unionByName(more)) if more.take(1) else roots
    degree = every.select(F.explode(F.array("u", "v")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
    ids = sig.select(F.col("uid").alias("root"), F.col("id").alias("component_id"))
    of_class = classes.join(final, classes["uid"] == final["u"], "left").select("whole", "other", "n", F.coalesce("root", "uid").alias("root"), classes["uid"].alias("rep")).join(degree.withColumnRenamed("uid", "rep"), "rep", "left").join(ids, "root")
    out = sig.select("uid", "block", "id", "n", "whole", "other").join(of_class.drop("rep"), ["whole", "other", "n"], "left")
    own_id = F.col("n") == 0
    return out.select("uid", "block", "id", F.col("n").alias("n_shingles"), F.when(own_id, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (own_id | (F.col("uid") == F.col("root"))).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
