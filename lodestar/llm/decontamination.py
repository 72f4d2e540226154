"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are brought to lower case with runs of anything but letters and
digits as one space. An item may differ from a passage by ``rate`` of its bytes
(edit distance over UTF-8). Cut into one piece more than that budget, at least
one piece must occur exactly, so all occurrences are found by looking up pieces:
a table of their first bytes is tested at every byte of the text at once, and a
hit is compared in full. The text around it is verified with Myers' bit-parallel
distance, the whole item against any passage. Items of fewer than
``short_bytes`` bytes have no budget and are found as whole words.

A piece that many items share (the opening of a template) says little. Its hits
are gathered as arrays, and the text around them is cut into tiles; an edit
spoils at most ``GRAM`` of an item's byte runs of that length, so an item whose
remaining runs are not nearly all in the tile needs no verification. Runs that
many items share are taken as found, so what is counted is what tells them apart.

The items go to the executors in lots of ``lot_bytes``; ``lots_a_pass`` of them
are looked for in one pass, which normalises each text once. If there are more,
every pass writes its hits, and they are joined to the documents by hashes of
the text, so neither the driver nor a task ever holds more items than a pass
has. The documents' texts are never shuffled.

Defined cases: null and empty texts match nothing; items with a null id or text,
or without a letter or digit, are ignored; ids may have any type; repeated rows
each get a row; without items all documents are kept; an empty table of
documents gives an empty result; very long texts are read whole; extra columns are ignored, or carried along, and a clashing name
(``n_items``, ``items``, ``distance``, ``kept``) is replaced by the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored
from .text import Texts, inside, range_hashes, window_hashes

U64 = np.uint64
TABLE_BITS = 22
_GAP = re.compile(r"[\W_]+")


def normalised(text: str) -> bytes:
    return _GAP.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def budget(size: int, rate: float, least_piece: int) -> int:
    """Allowed edits: a share of the item, but pieces keep a length that can be looked up."""
    return max(0, min(int(size * rate), size // least_piece - 1))


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of an item; the smallest distance to any passage of a text."""

    def __init__(self, item: bytes) -> None:
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: bytes, enough: int = 0) -> tuple[int, int]:
        """Distance and end of the best passage; stops at the first that is at most ``enough``."""
        full = (1 << self.size) - 1
        top, up, down, score = 1 << (self.size - 1), full, 0, self.size
        best, end = score, 0
        for j, c in enumerate(text):
            eq = self.masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
                    if best <= enough:
                        break
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | (full & ~(xv | ph))
            down = ph & xv
        return best, end


#: A seed with over so many pieces is a crowd; bytes of the runs that tell its items apart.
MANY, GRAM = 4, 5
#: Pieces are looked up by so many of their first bytes, as many as they have.
SEEDS = (16, 12, 8)


class Seeds:
    """Pieces of one seed length: a table of marks for all places of a text, and the pieces of each seed."""

    def __init__(self, seed: int, cut: list[tuple[int, int, bytes]]) -> None:
        self.seed, self.lookup, self.crowds = seed, {}, {}
        for k, at, p in cut:
            self.lookup.setdefault(p[:seed], []).append((k, at, p))
        for key, own in self.lookup.items():
            if len(own) > MANY:
                by: dict[bytes, list[tuple[int, int]]] = {}
                for k, at, p in own:
                    by.setdefault(p, []).append((k, at))
                self.crowds[key] = [(p, np.array(x, np.int64).T) for p, x in by.items()]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.cells(np.frombuffer(b"".join(self.lookup), np.uint8))[::seed]] = True

    def cells(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.seed + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
        mixed = words[:n] * U64(0x9E3779B97F4A7C15) ^ words[self.seed - 8 : self.seed - 8 + n] * U64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ mixed >> U64(31)) * U64(0x94D049BB133111EB) >> U64(64 - TABLE_BITS)).astype(np.int64)


class Runs:
    """The byte runs of the items that share pieces with many, to tell which of them a tile of text may hold."""

    def __init__(self, texts: list[bytes], errors: list[int], which: list[int]) -> None:
        item = np.repeat(np.array(which, np.int64), [max(0, len(texts[k]) - GRAM + 1) for k in which])
        codes = np.concatenate([self.codes(np.frombuffer(texts[k], np.uint8)) for k in which])
        order = np.argsort(codes, kind="stable")
        self.known, at, n = np.unique(codes[order], return_index=True, return_counts=True)
        self.item, self.at, self.n = item[order].astype(np.int32), at, n
        hot = n > max(64, len(which) // 20)
        self.need = np.zeros(len(texts), np.int64)
        for k in which:
            self.need[k] = len(texts[k]) - GRAM + 1 - GRAM * errors[k]
        taken = np.repeat(hot, n)
        self.need -= np.bincount(self.item[taken], minlength=len(texts))
        self.n = np.where(hot, 0, n)

    @staticmethod
    def codes(data: np.ndarray) -> np.ndarray:
        """A number for each run; that two runs share one can only add a candidate."""
        n = len(data) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint32)
        word = np.zeros(n, U64)
        for i in range(GRAM):
            word = word << U64(8) | data[i : i + n].astype(U64)
        return (word * U64(0x9E3779B97F4A7C15) >> U64(32)).astype(np.uint32)

    def may_hold(self, tile: np.ndarray) -> np.ndarray:
        """For each item whether enough of its runs are in the tile."""
        codes = np.unique(self.codes(tile))
        at = np.searchsorted(self.known, codes)
        at = at[at < len(self.known)]
        at = at[np.isin(self.known[at], codes)]
        n = self.n[at]
        first = np.repeat(self.at[at] - np.cumsum(n) + n, n)
        found = self.item[first + np.arange(len(first))]
        return np.bincount(found, minlength=len(self.need)) >= self.need


class Items:
    """A lot of items, ready to be looked up."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float, least_piece: int, short_bytes: int) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        short = [len(t) < short_bytes for t in self.texts]
        self.errors = [0 if s else budget(len(t), rate, least_piece) for t, s in zip(self.texts, short, strict=True)]
        cut = [(k, at, p) for k, t in enumerate(self.texts) if not short[k] for at, p in pieces(t, self.errors[k])]
        by: dict[int, list] = {}
        for x in cut:
            by.setdefault(next(s for s in SEEDS if len(x[2]) >= s), []).append(x)
        self.seeds = [Seeds(s, x) for s, x in by.items()]
        self.sizes, self.edits = np.array([len(t) for t in self.texts], np.int64), np.array(self.errors, np.int64)
        self.runs: Runs | None = None  # made when a crowd is met
        self.words: dict[int, dict[int, list[int]]] = {}  # short items by number of words and hash
        for k in np.flatnonzero(short).tolist():
            starts, ends, _ = Texts.of(pa.array([self.texts[k].decode("utf-8", "replace")])).words()
            n = len(starts)
            code = window_hashes(range_hashes(np.frombuffer(self.texts[k], np.uint8), starts, ends), n)[0]
            self.words.setdefault(n, {}).setdefault(int(code), []).append(k)
        self.patterns: dict[int, Pattern] = {}

    def find(self, texts: list[bytes]) -> dict[int, dict[int, int]]:
        """For each text with a match: the items in it and their distances."""
        gap = b"\0" * 16
        joined = gap.join(texts)
        starts = np.cumsum([0, *(len(t) + 16 for t in texts)])
        data = np.frombuffer(joined, np.uint8)
        ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        met: list[tuple[int, int, np.ndarray]] = []
        for seeds in self.seeds:
            hits = np.flatnonzero(seeds.table[seeds.cells(data)])
            docs = np.searchsorted(starts, hits, "right") - 1
            for h, d in zip(hits.tolist(), docs.tolist(), strict=True):
                key = joined[h : h + seeds.seed]
                if key in seeds.crowds:
                    met += [(h, d, own) for p, own in seeds.crowds[key] if joined.startswith(p, h)]
                    continue
                for k, at, p in seeds.lookup.get(key, ()):
                    if joined.startswith(p, h):
                        a = h - at - self.errors[k]
                        ranges.setdefault((d, k), []).append((max(a, int(starts[d])), min(a + len(self.texts[k]) + 2 * self.errors[k], int(starts[d]) + len(texts[d]))))
        if met:
            self._crowded(data, starts, [len(t) for t in texts], met, ranges)
        found: dict[int, dict[int, int]] = {}
        for (d, k), spans in ranges.items():
            distance = self._verified(joined, k, spans)
            if distance is not None:
                found.setdefault(d, {})[k] = distance
        if self.words:
            self._whole_words(texts, found)
        return found

    def _crowded(self, data: np.ndarray, starts: np.ndarray, sizes: list[int], met: list[tuple[int, int, np.ndarray]], ranges: dict[tuple[int, int], list[tuple[int, int]]]) -> None:
        """Adds the spans of those items of the crowds that the text around their hits may hold."""
        if self.runs is None:
            self.runs = Runs(self.texts, self.errors, sorted({int(k) for s in self.seeds for own in s.crowds.values() for _, x in own for k in x[0]}))
        n = [x.shape[1] for _, _, x in met]
        k, at = np.concatenate([x for _, _, x in met], 1)
        h, d = np.repeat([x[0] for x in met], n), np.repeat([x[1] for x in met], n)
        first = starts[d]
        a = np.maximum(h - at - self.edits[k], first)
        b = np.minimum(a + self.sizes[k] + 2 * self.edits[k], first + np.array(sizes)[d])
        # windows of up to a power of two lie in a tile of twice that, one of which begins at each multiple of it
        power = np.ceil(np.log2(self.sizes[k] + 2 * self.edits[k])).astype(np.int64)
        tiles, tile = np.unique((d << 5 | power) << 32 | a - first >> power, return_inverse=True)
        code = tile * len(self.texts) + k
        order = np.argsort(code)
        cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
        own, a, b = code[order][cuts], np.minimum.reduceat(a[order], cuts), np.maximum.reduceat(b[order], cuts)
        of, k = own // len(self.texts), own % len(self.texts)
        edges = np.searchsorted(of, np.arange(len(tiles) + 1))
        for i, x in enumerate(tiles.tolist()):
            d0, p0, at0 = x >> 37, x >> 32 & 31, x & 0xFFFFFFFF
            begin = int(starts[d0]) + (at0 << p0)
            may = self.runs.may_hold(data[begin : min(begin + (2 << p0), int(starts[d0]) + sizes[d0])])
            for j in (np.flatnonzero(may[k[edges[i] : edges[i + 1]]]) + edges[i]).tolist():
                ranges.setdefault((d0, int(k[j])), []).append((int(a[j]), int(b[j])))

    def _verified(self, joined: bytes, k: int, spans: list[tuple[int, int]]) -> int | None:
        """The distance of an item to the best passage of the spans, if the budget allows it."""
        item, limit = self.texts[k], self.errors[k]
        pattern = self.patterns.get(k) or self.patterns.setdefault(k, Pattern(item))
        best, merged = limit + 1, []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            if b - a >= len(item) - limit:
                best = 0 if joined.find(item, a, b) >= 0 else min(best, pattern.nearest(joined[a:b])[0])
            if not best:
                break
        return best if best <= limit else None

    def _whole_words(self, texts: list[bytes], found: dict[int, dict[int, int]]) -> None:
        all_ = Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        starts, ends, at = all_.words()
        prints, raw = range_hashes(all_.data, starts, ends), all_.data.tobytes()
        for n, known in self.words.items():
            ok = np.flatnonzero(inside(at, n))
            if len(ok):
                codes = window_hashes(prints, n)
                ok = ok[np.isin(codes[ok], np.array(list(known), U64))]
                for i, d in zip(ok.tolist(), (np.searchsorted(at, ok, "right") - 1).tolist(), strict=True):
                    for k in known[int(codes[i])]:
                        if raw[starts[i] : ends[i + n - 1]] == self.texts[k]:
                            found.setdefault(d, {})[k] = 0


RESULT = ("n_items", "items", "distance", "kept")


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **params) -> DataFrame:
    """id (with ``carry`` all columns), n_items, items (ids in order), distance (the smallest) and kept of every document."""
    names = [c for c in (docs.columns if carry else [id_col]) if c not in RESULT]
    ids = F.array_sort(F.array_distinct("found.item"))
    out = _found(docs, items, names, text_col, **params)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.size(ids).cast("long").alias("n_items"), ids.alias("items"), F.array_min("found.distance").alias("distance"), (F.size("found") == 0).alias("kept"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The documents without those that hold an item, their columns unchanged."""
    return _found(docs, items, docs.columns, text_col, **params).where(F.size("found") == 0).select("row.*")


def _found(docs: DataFrame, items: DataFrame, names: list[str], text_col: str, item_id: str = "item_id", item_text: str = "text", rate: float = 0.08, least_piece: int = 8, short_bytes: int = 24, lot_bytes: int = 8 << 20, lots_a_pass: int = 8) -> DataFrame:
    """row (a struct of the named columns) and found (an array of item and distance) of every document."""
    kind = items.schema[item_id].dataType
    passes = _passes(items, item_id, item_text, lot_bytes, lots_a_pass)
    first, second = next(passes), next(passes, None)
    rows = docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("text"))
    scan = lambda lots: _scan(lots, kind, rate, least_piece, short_bytes)(F.col("text"))
    if second is None:
        return rows.select("row", scan(first).alias("found"))  # only the text goes to Python
    key = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    texts = rows.select(key[0].alias("a"), key[1].alias("b"), "text")
    hits = None
    for lots in (first, second, *passes):
        some = texts.select("a", "b", scan(lots).alias("found")).where(F.size("found") > 0)
        some = stored(some.dropDuplicates(["a", "b"]), "hits")
        hits = some if hits is None else hits.unionByName(some)
    hits = hits.groupBy("a", "b").agg(F.flatten(F.collect_list("found")).alias("found"))  # a list for each pass
    empty = F.array().cast(hits.schema["found"].dataType)
    return rows.select("row", key[0].alias("a"), key[1].alias("b")).join(hits, ["a", "b"], "left").select("row", F.coalesce("found", empty).alias("found"))


def _passes(items: DataFrame, item_id: str, item_text: str, lot_bytes: int, lots_a_pass: int) -> Iterator[list[list[tuple[object, bytes]]]]:
    """The items in lots of bounded size, some for each pass; the first pass is there even if it is empty."""
    lots: list[list[tuple[object, bytes]]] = [[]]
    size, given = 0, False
    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        text = normalised(row["t"])
        if text:
            if size + len(text) > lot_bytes and lots[-1]:
                if len(lots) == lots_a_pass:
                    yield lots
                    lots, given = [], True
                lots.append([])
                size = 0
            lots[-1].append((row["i"], text))
            size += len(text)
    if lots[-1] or not given:
        yield lots


def _scan(lots: list[list[tuple[object, bytes]]], item_type, rate: float, least_piece: int, short_bytes: int):
    ready: list[Items] = []  # filled once in each worker
    kind = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("distance", pa.int64())]))

    @F.arrow_udf(f"array<struct<item: {item_type.simpleString()}, distance: bigint>>")
    def run(text: pa.Array) -> pa.Array:
        if not ready:
            ready.extend(Items(lot, rate, least_piece, short_bytes) for lot in lots if lot)
        out, a = [], 0
        while a < len(text):
            texts, size = [], 0
            while a + len(texts) < len(text) and (size < 2 << 20 or not texts):
                texts.append(normalised(text[a + len(texts)].as_py() or ""))
                size += len(texts[-1])
            found: list[list] = [[] for _ in texts]
            for items in ready:
                for i, own in items.find(texts).items():
                    found[i] += [{"item": items.ids[j], "distance": e} for j, e in sorted(own.items())]
            out += found
            a += len(texts)
        return pa.array(out, kind)

    return run
