"""Quality rules: counts of each text, and repetition found with a suffix array.

The words of a document are numbered and their suffixes sorted by prefix
doubling, for all documents of a batch at once. The common prefix of neighbours
in that order gives the longest-common-prefix intervals; the deepest interval of
a suffix is the longest repeated passage that begins there, and it is maximal
unless the passage beginning one word earlier contains it. The union of the
maximal repeats is the repeated share of the text, which is limited together
with the longest repeat.

Defined cases: null and empty texts have zero counts and fail the base rules
(fewer than ``min_words`` words); repeated rows are judged one by one; an
empty table gives an empty result; very long texts are judged whole, in time
that grows little faster than their length; columns other than id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import BLANK, Texts, covered, inside, owners, per_document, range_hashes, window_hashes

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, longest_repeat long, repeat_words long, n_maximal_repeats long, kept boolean"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def suffix_order(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all documents, sorted within each, and the ranks after 1, 2, 4 ... words (equal: same words)."""
    n = len(ids)
    doc = owners(offsets)
    end = offsets[1:][doc] if n else np.zeros(0, np.int64)
    rank = np.unique(doc.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.zeros(n, np.int64)  # ranks are places in the order, so they stay right as groups split
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    first[order] = place[new][np.cumsum(new) - 1] if n else place
    ranks, step = [first.astype(np.int32)], 1
    while True:
        now = ranks[-1].astype(np.int64)
        sorted_now = now[order]
        same = np.zeros(n, bool)
        same[1:] = sorted_now[1:] == sorted_now[:-1]
        same[:-1] |= same[1:]
        at = np.flatnonzero(same)  # places in groups of equal prefixes
        if not len(at):
            return order, ranks
        who = order[at]
        ahead = who + step
        key = np.where(ahead < end[who], now[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((key, now[who]))
        who, key, was = who[by], key[by], now[who][by]
        order[at] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = (was[1:] != was[:-1]) | (key[1:] != key[:-1])
        after = ranks[-1].copy()
        after[who] = at[fresh][np.cumsum(fresh) - 1]
        if np.array_equal(after, ranks[-1]) and not (key > 0).any():
            return order, ranks
        ranks.append(after)
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """For each place the words that its suffix shares with the one before it; 0 at the first of a document."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    end = offsets[1:][owners(offsets)]
    place = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[place - 1], order[place]
    room, length = np.minimum(end[a] - a, end[b] - b), np.zeros(len(place), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        fits = length + (1 << level) <= room
        i = np.flatnonzero(fits)
        equal = ranks[level][a[i] + length[i]] == ranks[level][b[i] + length[i]]
        length[i[equal]] += 1 << level
    lcp[place] = length
    return lcp


def repeats(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeated passages of at least so many words, and each word's longest repeat."""
    order, ranks = suffix_order(ids, offsets)
    lcp = common_prefixes(order, ranks, offsets)
    deepest = np.zeros(len(ids), np.int64)
    deepest[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(ids) else lcp
    inner = np.zeros(len(ids), bool)
    inner[1:] = deepest[:-1] == deepest[1:] + 1
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero((deepest >= least) & ~inner)
    return at, deepest[at], deepest


def measure(texts: Texts, min_words: int, repeat_percent: int, window: int, least: int, covered_percent: float, longest: int) -> list[np.ndarray]:
    starts, ends, offsets = texts.words()
    data, n = texts.data, np.diff(offsets)
    doc = owners(offsets)
    point = (data & 0xC0) != 0x80
    word_chars = per_document(point & ~BLANK[data], texts.offsets)
    symbols = per_document(_SYMBOL[data], texts.offsets)
    # lines with a word, equal to an earlier line of the document
    a, b, at = texts.lines()
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~BLANK[data], out=solid[1:])
    filled = solid[b] > solid[a]
    line_doc = owners(at)[filled]
    lines = np.stack([line_doc.astype(np.uint64), range_hashes(data, a[filled], b[filled])], 1)
    distinct = np.unique(lines.view([("d", "u8"), ("h", "u8")]).ravel())
    dup = np.bincount(line_doc, minlength=len(texts)) - np.bincount(distinct["d"].astype(np.int64), minlength=len(texts))
    ids = np.unique(range_hashes(data, starts, ends), return_inverse=True)[1]
    # words in windows that are found twice or more in the document
    ok = np.flatnonzero(inside(offsets, window))
    codes = window_hashes(ids, window)[ok] if len(ok) else np.zeros(0, np.uint64)
    order = np.lexsort((codes, doc[ok]))
    s_doc, s_code = doc[ok][order], codes[order]
    twin = np.zeros(len(ok), bool)
    same = (s_doc[1:] == s_doc[:-1]) & (s_code[1:] == s_code[:-1])
    twin[1:] |= same
    twin[:-1] |= same
    found = ok[order[twin]]
    repeated = per_document(covered(found, found + window, len(ids)), offsets)
    failed = (n < min_words) | (100 * repeated > repeat_percent * n)
    # maximal repeats from the suffix array
    at, length, deepest = repeats(ids, offsets, least)
    spans = per_document(covered(at, at + length, len(ids)), offsets)
    count = np.bincount(doc[at], minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, deepest)
    kept = ~failed & (100 * spans <= covered_percent * n) & (top <= longest)
    return [n, word_chars, symbols, dup, repeated, failed, top, spans, count, kept]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, window: int = 5, least_repeat: int = 10, covered_percent: float = 15.0, longest_repeat: int = 60) -> DataFrame:
    """One row per document: id and the columns of SCHEMA. ``kept`` needs the base rules, at most ``covered_percent``
    of the words in repeats of ``least_repeat`` words or more, and no repeat of over ``longest_repeat`` words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts.of(batch.column(1))
            for a, part in texts.parts(2 << 20):
                columns = measure(part, min_words, repeat_percent, window, least_repeat, covered_percent, longest_repeat)
                values = [pa.array(c.astype(bool) if c.dtype == bool else c.astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), *values], ["id_", *FIELDS])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id_ {id_type}, {SCHEMA}")
    return out.withColumnRenamed("id_", id_col)
