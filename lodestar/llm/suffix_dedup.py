"""Suffix-array dedup of byte strings over a whole corpus.

Which strings of ``length`` bytes occur more than once is read from a
Burrows-Wheeler transform by threshold-bounded interval expansion: the intervals
of all strings of l bytes are extended backward by one byte, breadth first, which
sets the common prefixes of neighbouring suffixes in increasing order; at
``length`` the expansion stops, and neighbours whose prefix is not yet set share
at least so many bytes.

One transform of the corpus can't be built, so strings that can be equal are
brought together first. Every window of ``length`` bytes holds an anchor, the
``gram``-byte string with the smallest hash in it; equal windows have equal
anchors. Round 1 counts anchors (one entry for each distinct anchor of a block).
Round 2 sends the text around anchors that occur twice or more to the slice of
their hash, distinct surroundings of a block once. The slice joins them, equal
ones once, builds suffix arrays of bounded size and answers which windows start
earlier elsewhere; a group of one anchor that is too large is split by longer
common strings. Last, each block removes the bytes of those windows.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing;
documents are ordered by id, those with one id by text, null ids last
(by a hash of the text, then the text), so of repeated rows all but the first
lose all windows; very long texts are one document of their block, in memory at
once; an empty table gives an empty result; columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import SENT, bits, blocked, in_order, labels, messages, pack, rounds, slices_of, spread, squeeze, unbits, unpack
from .common import partitions, slices
from .text import Texts, covered, equal_ranges, gram_codes, inside, mix, per_document, range_hashes

U64 = np.uint64
SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least; symbols are below 512."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 7
    while step < depth:
        now = rank[order]
        same = np.zeros(n, bool)
        same[1:] = now[1:] == now[:-1]
        same[:-1] |= same[1:]
        at = np.flatnonzero(same)
        if not len(at):
            break
        who = order[at]
        ahead = who + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(rank[who] * (n + 1) + follow, kind="stable")
        who, follow = who[by], follow[by]
        order[at] = who
        was = rank[who]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (was[1:] != was[:-1]) | (follow[1:] != follow[:-1])
        rank[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        step *= 2
    return order


def expand_intervals(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefixes of neighbours in the suffix order, by increasing value; ``least`` where they are at least that.

    Works on the transform alone: the rows sorted by the byte before them are the rows reached by extending backward.
    A boundary between two rows at one length becomes a boundary between their extensions at the next.
    """
    n = len(order)
    first = symbols[order]
    before = symbols[order - 1]  # the transform; row 0's text starts after the last separator
    reached = np.argsort(before, kind="stable")
    prefix = np.full(n, least, np.int16 if least < 1 << 15 else np.int32)
    edge = np.ones(n, bool)
    edge[1:] = first[1:] != first[:-1]
    prefix[edge] = 0
    rows = np.flatnonzero(~edge)
    lo, hi = reached[rows - 1], reached[rows]
    # where two neighbours extend two neighbours, the boundary moves along; else any boundary in between will do
    next_ = np.full(n, -1)
    close = hi == lo + 1
    next_[hi[close]] = rows[close]
    rows, lo, hi = rows[~close], lo[~close], hi[~close]
    front = np.flatnonzero(edge)
    for length in range(1, least):
        if not len(front):
            break
        moved = next_[front]
        moved = moved[moved >= 0]
        if len(rows) * 12 < n:
            split = np.searchsorted(front, hi, "right") > np.searchsorted(front, lo, "right")
        else:
            marks = np.zeros(n, np.int32)
            marks[front] = 1
            np.cumsum(marks, out=marks)
            split = marks[hi] > marks[lo]
        front = np.sort(np.concatenate([moved, rows[split]]))
        prefix[front] = length
        rows, lo, hi = rows[~split], lo[~split], hi[~split]
    return prefix


def first_windows(texts: list[np.ndarray], keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For every text the window starts whose ``length`` bytes also start at a smaller key among the texts.

    keys: of each text's byte 0; a window at offset o has key + o.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    symbols = np.zeros(ends[-1], np.uint16)
    solid = np.ones(ends[-1], bool)
    solid[ends - 1] = False
    symbols[solid] = np.concatenate(texts).astype(np.uint16) + 1
    del solid
    order = suffix_array(symbols, length)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(expand_intervals(symbols, order, length) < length) - 1
    del order, symbols
    starts = ends - sizes
    count = np.maximum(0, sizes - length)  # windows of each text
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    own = keys[owner] + offset.astype(U64)
    of = group[starts[owner] + offset]
    least = np.full(int(group.max()) + 1, U64((1 << 64) - 1))
    np.minimum.at(least, of, own)
    late = own > least[of]
    cuts = np.cumsum(count)
    return np.split(late, cuts[:-1])


class Anchors:
    """Anchors of a block's texts: byte places, codes and the text around each."""

    def __init__(self, texts: Texts, length: int, gram: int) -> None:
        self.data, self.offsets = texts.data, texts.offsets
        at, codes = [], []
        span = length - gram + 1
        for a, part in texts.parts():
            base = int(texts.offsets[a])
            ok = inside(part.offsets, length)
            if not ok.any():
                continue
            h = gram_codes(part.data, gram)
            # the smallest upper half of a hash, of equals the first: the same in every text that holds the window
            low = U64(0xFFFFFFFF)
            least = (h & ~low) | np.arange(len(h), dtype=U64)
            width = 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            place = (least[: len(ok)] & low).astype(np.int64)[ok]
            place = place[np.append(True, place[1:] != place[:-1])]
            at.append(place + base)
            codes.append(mix(h[place]))  # the smallest hashes lie low; mixed, they spread over all slices
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, U64)
        doc = np.searchsorted(self.offsets, self.at, "right") - 1
        self.start = np.maximum(self.offsets[doc], self.at - (length - gram))
        self.end = np.minimum(self.offsets[doc + 1], self.at + length)

    def around(self, rows: np.ndarray) -> np.ndarray:
        """A hash of the text around each of the rows, and of the anchor's place in it."""
        return range_hashes(self.data, self.start[rows], self.end[rows]) ^ (self.at[rows] - self.start[rows]).astype(U64)


def repeats_of_lead(data: np.ndarray, by: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows in order, which have the keys, the size and all bytes of the first row with their keys."""
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in (*keys, size)], axis=0)
    lead = by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by
    same = ~new
    same[same] = equal_ranges(data, starts[by[same]], starts[lead[same]], size[by[same]])
    return same


def earlier_windows(payloads: list[bytes], ranks: np.ndarray, length: int, gram: int, piece: int) -> list[bytes]:
    """For each message, of all windows of its texts, which start earlier elsewhere."""
    lots = [spread(p, U64, np.uint64, np.uint32, np.uint32, np.uint8) for p in payloads]
    sizes = [len(x[0]) for x in lots]
    code, size, anchor = (np.concatenate([x[i] for x in lots]) for i in (0, 2, 3))
    size, anchor = size.astype(np.int64), anchor.astype(np.int64)
    key = np.concatenate([x[1] for x in lots]).astype(U64) | np.repeat(ranks.astype(np.int64), sizes).astype(U64) << U64(40)
    data = np.concatenate([x[4] for x in lots])
    del lots
    ends = np.cumsum(size)
    starts = ends - size
    count = np.maximum(0, size - length + 1)
    late = np.zeros(int(count.sum()), bool)
    into = np.cumsum(count) - count
    whole = range_hashes(data, starts, ends) ^ anchor.astype(U64)
    by = np.lexsort((key, whole, code))
    same = repeats_of_lead(data, by, starts, size, (code, whole, anchor))
    for i in by[same].tolist():  # equal surroundings: all but the first repeat it whole
        late[into[i] : into[i] + count[i]] = True
    lead = by[~same]

    def run(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Windows lo..hi (relative to the anchor) of the rows' texts."""
        a = np.maximum(0, anchor[rows] + lo)
        b = np.minimum(size[rows], anchor[rows] + hi + length)
        fits = b - a >= length
        rows, a, b = rows[fits], a[fits], b[fits]
        if not len(rows):
            return
        got = first_windows([data[starts[r] + x : starts[r] + y] for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist(), strict=True)], key[rows] + a.astype(U64), length)
        for r, x, marks in zip(rows.tolist(), a.tolist(), got, strict=True):
            late[into[r] + x : into[r] + x + len(marks)] |= marks

    def divide(rows: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Rows that can share a window lo..hi, in groups of bounded size: by the bytes common to all these windows."""
        if int(size[rows].sum()) <= piece or lo == hi:
            yield rows, lo, hi
            return
        middle = (lo + hi) // 2
        for x, y in ((lo, middle), (middle + 1, hi)):
            has = (anchor[rows] + y >= 0) & (anchor[rows] + x + length <= size[rows])
            some = rows[has]
            a, b = starts[some] + np.maximum(0, anchor[some] + y), starts[some] + np.minimum(size[some], anchor[some] + x + length)
            common = range_hashes(data, a, b)
            order = np.argsort(common, kind="stable")
            cut = np.flatnonzero(np.append(True, common[order][1:] != common[order][:-1]))
            for part in np.split(some[order], cut[1:]):
                if len(part) > 1:
                    yield from divide(part, x, y)

    group = np.flatnonzero(np.append(True, code[lead][1:] != code[lead][:-1])) if len(lead) else np.zeros(0, np.int64)
    load: list[tuple[np.ndarray, int, int]] = []
    weight = 0

    def flush() -> None:
        if load:
            lengths = [len(x[0]) for x in load]
            run(np.concatenate([x[0] for x in load]), np.repeat([x[1] for x in load], lengths), np.repeat([x[2] for x in load], lengths))
            load.clear()

    for part in np.split(lead, group[1:]) if len(lead) else []:
        for lot in divide(part, gram - length, 0):
            load.append(lot)
            weight += int(size[lot[0]].sum())
            if weight > piece:
                flush()
                weight = 0
    flush()
    cuts = np.cumsum([0, *sizes])
    total = np.append(into, len(late))
    return [squeeze(np.packbits(late[total[cuts[i]] : total[cuts[i + 1]]])) for i in range(len(payloads))]


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, code_bits: int = 40, piece: int = 1 << 19) -> DataFrame:
    """One row per document: id and the columns of SCHEMA. ``piece``: bytes of a suffix array."""
    n = slices(docs.sparkSession)
    keys, id_type = labels(n), docs.schema[id_col].dataType.simpleString()
    texts = blocked(docs, id_col, text_col)
    shift = U64(64 - code_bits)

    def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order by code, distinct codes, their counts, cuts by slice."""
        short = codes >> shift
        order = np.argsort(short, kind="stable")
        short = short[order]
        new = np.ones(len(short), bool)
        new[1:] = short[1:] != short[:-1]
        found = short[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(short)))
        return order, found, counts, np.searchsorted(slices_of(found << shift, n), np.arange(n + 1))

    def anchors(block: pa.Table) -> pa.Table:
        own = Anchors(Texts.of(in_order(block).column("text")), length, gram)
        _, codes, counts, cuts = distinct(own.codes)
        out = []
        for s in range(n):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                packed = pack(codes[a:b])
                out.append((s, np.uint32(len(packed)).tobytes() + packed + bits(counts[a:b] > 1)))
        return messages(block, keys, out)

    def repeated(payloads: list[bytes], ranks: np.ndarray) -> list[bytes]:
        codes, twice = [], []
        for p in payloads:
            end = 4 + int(np.frombuffer(p, np.uint32, 1)[0])
            codes.append(unpack(p[4:end]))
            twice.append(unbits(p[end:], len(codes[-1])))
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        often = np.bincount(at, weights=1 + np.concatenate(twice), minlength=len(found)) > 1
        cuts = np.cumsum([0, *map(len, codes)])
        marks = often[at]
        return [bits(marks[cuts[i] : cuts[i + 1]]) for i in range(len(payloads))]

    def candidates(block: pa.Table, answers: pa.Table) -> tuple[Anchors, np.ndarray, np.ndarray]:
        """The anchors; those found elsewhere too, by code and surroundings; marks of the first of each."""
        own = Anchors(Texts.of(in_order(block).column("text")), length, gram)
        order, codes, counts, cuts = distinct(own.codes)
        often = np.zeros(len(codes), bool)
        for s, p in zip(answers.column("at").to_pylist(), answers.column("payload"), strict=True):
            often[cuts[s] : cuts[s + 1]] = unbits(p.as_py(), cuts[s + 1] - cuts[s])
        rows = np.sort(order[np.repeat(often, counts)])
        prints = own.around(rows)
        by = np.lexsort((rows, prints, own.codes[rows] >> shift))
        rows, prints = rows[by], prints[by]
        keys = (own.codes[rows] >> shift, prints, own.at[rows] - own.start[rows])
        return own, rows, ~repeats_of_lead(own.data, np.arange(len(rows)), own.start[rows], (own.end - own.start)[rows], keys)

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        own, rows, first = candidates(block, answers)
        rows = rows[first]
        code = own.codes[rows] >> shift
        cuts = np.searchsorted(slices_of(code << shift, n), np.arange(n + 1))
        out = []
        for s in range(n):
            some = rows[cuts[s] : cuts[s + 1]]
            if len(some):
                a, b = own.start[some], own.end[some]
                text = np.concatenate([own.data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
                out.append((s, squeeze(code[cuts[s] : cuts[s + 1]], a.astype(np.uint64), (b - a).astype(np.uint32), (own.at[some] - a).astype(np.uint32), text)))
        return messages(block, keys, out)

    def remove(block: pa.Table, both: pa.Table) -> pa.Table:
        block = in_order(block)
        own, rows, first = candidates(block, both.filter(pa.compute.equal(both.column("round"), 1)))
        count = np.maximum(0, own.end - own.start - length + 1)
        again = rows[~first]
        starts, ends = [own.start[again][count[again] > 0]], [own.end[again][count[again] > 0]]
        lead = rows[first]
        cuts = np.searchsorted(slices_of(own.codes[lead] >> shift << shift, n), np.arange(n + 1))
        second = both.filter(pa.compute.equal(both.column("round"), 2))
        for s, p in zip(second.column("at").to_pylist(), second.column("payload"), strict=True):
            some = lead[cuts[s] : cuts[s + 1]]
            total = int(count[some].sum())
            late = np.unpackbits(spread(p.as_py(), np.uint8)[0], count=total).astype(bool)
            at = np.repeat(own.start[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(total)
            starts.append(at[late])
            ends.append(at[late] + length)
        gone = covered(np.concatenate(starts), np.concatenate(ends), len(own.data))
        begins = gone.copy()
        edge = np.zeros(len(gone) + 1, bool)
        edge[own.offsets] = True
        begins[1:] &= ~gone[:-1] | edge[1:-1]
        left = per_document(~gone, own.offsets)
        kept, cut = memoryview(own.data[~gone].tobytes()), np.cumsum(np.append(0, left))
        hashes = [hashlib.sha256(kept[cut[i] : cut[i + 1]]).hexdigest() for i in range(len(left))]
        return pa.table({"id_": block.column("id"), "n_bytes": pa.array(np.diff(own.offsets)), "n_removed": pa.array(np.diff(own.offsets) - left), "n_spans": pa.array(per_document(begins, own.offsets)), "kept_sha256": pa.array(hashes, pa.string())})

    first = rounds(texts.groupBy("block").applyInArrow(anchors, SENT), repeated)
    second = rounds(texts.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send, SENT), lambda payloads, ranks: earlier_windows(payloads, ranks, length, gram, piece))
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).repartition(partitions(docs.sparkSession), "block")
    out = texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, f"id_ {id_type}, {SCHEMA}")
    return out.withColumnRenamed("id_", id_col)
