"""Stupid-backoff scores of all documents against counts of the whole corpus.

The n-gram count tables lie by hash in slices. Every block of documents sends
its distinct n-grams of all orders with their counts, each slice adds the counts
of all blocks, and the join brings the totals back to the n-grams of the blocks
that asked. There each word of a document is scored and the scores are summed
by document. A document's own n-grams are taken off the counts, so a text is
scored by what the rest of the corpus says and the backoff is exercised.

A word with K - 1 words before it (K at most ``order``) has the score
``alpha**(K - k) * c(k words) / c(k - 1 words)`` for the largest k whose count is
positive, with the words of the rest of the corpus for c(no words); a word found
nowhere else has ``alpha**K`` over that number (1 at least).

An n-gram of the longest order travels as its context and a code of its last
word: it lies in the slice of its context, beside the context's own count, and
contexts are sent once. Rows are packed, one message for all n-grams of a block
in a slice, as hundreds of millions of n-grams as rows of their own would take
more than twice the disk.

Defined cases: null and empty texts have no words and score 0; texts of one word
use the single-word counts; repeated rows count as documents of their own; null
ids are ids; very long texts are read whole; an empty table gives an empty
result; extra columns are ignored. Counts are exact but for n-grams of one order
whose codes agree: ``code_bits`` bits for orders below the longest, each with a
space of its own, and for the longest those of its context and ``last_bits`` for
its last word. A true n-gram is never more frequent than its context, so a hit
with a rarer context is such an agreement and counts as not found: no score is
infinite. At 30 GB, with about 4e9 distinct n-grams below the longest order, 64
bits let less than one agreement be expected; a context with 70,000 different
last words lets one in a million new ones agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import SENT, blocked, counts_in, counts_out, in_order, labels, messages, pack_wide, rounds, slices_of, spread, squeeze, unpack_wide
from .common import slices
from .text import Texts, owners, range_hashes, window_hashes

U64 = np.uint64
SCHEMA = "n_words long, n_full long, score double, mean_score double"


def ngrams(texts: Texts, orders: int, code_bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Word offsets, for each order the code of the n-gram that ends at each word (0 where there is none), and the words' own hashes."""
    offsets, codes, words = [np.zeros(1, np.int64)], [[] for _ in range(orders)], []
    shift = U64(64 - code_bits)
    for _, part in texts.parts():
        starts, ends, at = part.words()
        prints = range_hashes(part.data, starts, ends)
        place = np.arange(len(starts)) - np.repeat(at[:-1], np.diff(at))
        for k in range(1, orders + 1):
            out = np.zeros(len(starts), U64)
            if len(starts) >= k:
                out[k - 1 :] = np.maximum(window_hashes(prints, k, k) >> shift, U64(1))
            out[place < k - 1] = 0
            codes[k - 1].append(out)
        words.append(prints)
        offsets.append(at[1:] + offsets[-1][-1])
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, U64)
    return np.concatenate(offsets), [whole(c) for c in codes], whole(words)


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, their counts, and for each value which of them it is; one sort, no search."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(ranked), np.int64)
    group[order] = np.cumsum(new) - 1
    return ranked[new], np.diff(np.append(np.flatnonzero(new), len(ranked))), group


class Lots:
    """The distinct n-grams of a block: by order the codes, their counts and, for each word, which of them ends there (-1: none).

    The longest order has keys of the context's place among the codes before it and the code of the last word.
    """

    def __init__(self, texts: Texts, order: int, code_bits: int, last_bits: int) -> None:
        self.offsets, codes, words = ngrams(texts, max(1, order - 1), code_bits)
        self.found, self.counts, self.of = [], [], []
        for k, c in enumerate(codes):
            self._add(c, np.flatnonzero(c))
            codes[k] = None
        if order > 1:
            context = np.full(len(words), -1)
            context[1:] = self.of[-1][:-1]
            context[self.offsets[:-1][np.diff(self.offsets) > 0]] = -1
            self._add(context.astype(U64) << U64(last_bits) | words >> U64(64 - last_bits), np.flatnonzero(context >= 0))

    def _add(self, values: np.ndarray, some: np.ndarray) -> None:
        found, counts, group = groups(values[some])
        of = np.full(len(values), -1)
        of[some] = group
        self.found.append(found)
        self.counts.append(counts)
        self.of.append(of)

    def cuts(self, n: int, order: int, code_bits: int, last_bits: int) -> list[np.ndarray]:
        """By order, where each of n slices begins."""
        out = [np.searchsorted(slices_of(f << U64(64 - code_bits), n), np.arange(n + 1)) for f in self.found[: max(1, order - 1)]]
        if order > 1:
            out.append(np.searchsorted(self.found[-1], out[-1].astype(U64) << U64(last_bits)))
        return out


def pack_last(codes: np.ndarray) -> bytes:
    """Codes of up to 36 bits: 32 of each, then the rest, two to a byte."""
    rest = np.zeros(len(codes) + len(codes) % 2, np.uint8)
    rest[: len(codes)] = codes >> U64(32)
    return (codes & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (rest[::2] | rest[1::2] << 4).tobytes()


def unpack_last(data: bytes, at: int, n: int) -> np.ndarray:
    pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 4 * n)
    rest = np.stack([pairs & 15, pairs >> 4], 1).ravel()[:n]
    return np.frombuffer(data, np.uint32, n, at).astype(U64) | rest.astype(U64) << U64(32)


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, code_bits: int = 64, last_bits: int = 36) -> DataFrame:
    """One row per document: id, n_words, n_full (words scored at the longest order), score (sum of natural logarithms) and its mean."""
    n = slices(docs.sparkSession)
    keys, id_type = labels(n), docs.schema[id_col].dataType.simpleString()
    texts = blocked(docs, id_col, text_col)
    low = (U64(1) << U64(last_bits)) - U64(1)

    def count(block: pa.Table) -> pa.Table:
        lots = Lots(Texts.of(block.column("text")), order, code_bits, last_bits)
        cuts = lots.cuts(n, order, code_bits, last_bits)
        words, out = np.array([int(lots.offsets[-1])]), []
        for s in range(n):
            parts = [(f[c[s] : c[s + 1]], m[c[s] : c[s + 1]]) for f, m, c in zip(lots.found, lots.counts, cuts, strict=True)]
            plain = parts[:-1] if order > 1 else parts
            packed = [pack_wide(f) for f, _ in plain]
            last, each = np.zeros(0, U64), np.zeros(0, np.int64)
            if order > 1:
                last = parts[-1][0] & low
                each = np.bincount((parts[-1][0] >> U64(last_bits)).astype(np.int64) - cuts[-2][s], minlength=len(plain[-1][0]))
            head = squeeze(words, np.array([len(x) for x in packed]), *counts_in(np.concatenate([m for _, m in parts]) - 1), *counts_in(each))
            out.append((s, len(head).to_bytes(8, "little") + head + b"".join(packed) + pack_last(last)))
        return messages(block, keys, out)  # to every slice, so that each answers with the number of all words

    def total(payloads: list[bytes], ranks: np.ndarray) -> list[bytes]:
        words, codes, counts, each, last = 0, [[] for _ in range(max(1, order - 1))], [], [], []
        for p in payloads:
            at = 8 + int.from_bytes(p[:8], "little")
            own, sizes, small, far, rest, small_e, far_e, rest_e = spread(p[8:at], np.int64, np.int64, np.uint8, np.uint32, np.int64, np.uint8, np.uint32, np.int64)
            words += int(own[0])
            for k, size in enumerate(sizes.tolist()):
                codes[k].append(unpack_wide(p[at : at + size]))
                at += size
            counts.append(counts_out(small, far, rest) + 1)
            each.append(counts_out(small_e, far_e, rest_e))
            last.append(unpack_last(p, at, int(each[-1].sum())))
        answers: list[list[np.ndarray]] = [[] for _ in payloads]
        begin = np.zeros(len(payloads), np.int64)
        for k in range(order):
            if k < len(codes):
                sizes = [len(x) for x in codes[k]]
                found, at = np.unique(np.concatenate(codes[k]), return_inverse=True)
                codes[k] = None
            else:
                sizes = [len(x) for x in last]
                context = np.repeat(at, np.concatenate(each)).astype(U64)
                found, at = np.unique(context << U64(last_bits) | np.concatenate(last), return_inverse=True)
            own = np.concatenate([c[b : b + m] for c, b, m in zip(counts, begin.tolist(), sizes, strict=True)])
            begin += sizes
            sums = np.bincount(at, weights=own, minlength=len(found)).astype(np.int64)[at] - own  # in the other blocks
            for i, part in enumerate(np.split(sums, np.cumsum(sizes)[:-1])):
                answers[i].append(part)
        return [squeeze(np.array([words]), *counts_in(np.concatenate(parts))) for parts in answers]

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        lots = Lots(Texts.of(block.column("text")), order, code_bits, last_bits)
        cuts, totals = lots.cuts(n, order, code_bits, last_bits), lots.counts
        words = 0
        for s, p in zip(answers.column("at").to_pylist(), answers.column("payload"), strict=True):
            total_, small, far, rest = spread(p.as_py(), np.int64, np.uint8, np.uint32, np.int64)
            words, sums, at = int(total_[0]), counts_out(small, far, rest), 0
            for k, c in enumerate(cuts):
                m = int(c[s + 1] - c[s])
                totals[k][c[s] : c[s + 1]] += sums[at : at + m]
                at += m
        offsets = lots.offsets
        doc, n_words = owners(offsets), np.diff(offsets)
        place = np.arange(len(doc)) - np.repeat(offsets[:-1], n_words)
        others = np.repeat(np.maximum(words - n_words, 1), n_words).astype(float)
        rest = []  # counts in the rest of the corpus, by order
        for of, sums in zip(lots.of, totals, strict=True):
            some = np.flatnonzero(of >= 0)
            _, sizes, group = groups(of[some] * len(n_words) + doc[some])  # of the document's own
            r = np.zeros(len(of), np.int64)
            r[some] = sums[of[some]] - sizes[group]
            rest.append(r)
        longest = np.minimum(place + 1, order)
        logs = longest * np.log(alpha) - np.log(others)
        full, open_ = np.zeros(len(doc), bool), np.ones(len(doc), bool)
        for k in range(order, 0, -1):
            hit = open_ & (rest[k - 1] > 0)
            if k > 1:
                hit[1:] &= rest[k - 2][:-1] >= rest[k - 1][1:]
            under = others[hit] if k == 1 else rest[k - 2][np.flatnonzero(hit) - 1]
            logs[hit] = (longest[hit] - k) * np.log(alpha) + np.log(rest[k - 1][hit]) - np.log(under)
            full |= hit & (longest == k)
            open_ &= ~hit
        sums = np.bincount(doc, weights=logs, minlength=len(n_words)).astype(float)
        return pa.table({"id_": block.column("id"), "n_words": pa.array(n_words), "n_full": pa.array(np.bincount(doc[full], minlength=len(n_words))), "score": pa.array(sums), "mean_score": pa.array(sums / np.maximum(n_words, 1))})

    counted = rounds(texts.groupBy("block").applyInArrow(lambda block: count(in_order(block)), SENT), total)
    out = texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(lambda block, answers: score(in_order(block), answers), f"id_ {id_type}, {SCHEMA}")
    return out.select(F.col("id_").alias(id_col), "n_words", "n_full", "score", "mean_score")
