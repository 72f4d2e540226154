"""Substring dedup with a count-min prefilter over word windows.

Round 1: every block sends a sketch of its windows to each slice of the hash
space: the distinct codes, with a mark for those that it holds twice. A slice
adds the sketches of all blocks into its part of a count-min table (two rows of
counters) and answers which codes have an estimate of two or more. The estimate
is never below the count, so no repeated window is lost.
Round 2: only windows estimated repeated are sent again, with a second
fingerprint, and grouped exactly (by 100 bits); the slice answers which of them
occur in an earlier block.
Last, each block marks the words of all windows that start earlier elsewhere,
and hashes what is left.

Defined cases: null and empty texts have no words and the hash of the empty
string; texts of fewer words than a window lose nothing; documents are ordered
by id, those with one id by text, null ids last (by a hash of the text, then the
text), so of repeated rows all but the first lose their windows; very long texts
are one document of their block, in memory at once; an empty table gives an
empty result; columns other than id and text are ignored.

Windows are compared by codes of 36 + 63 bits, not by their words. Among 10**13
windows two different ones agree with a chance of about 10**26 / 2**100, one in
ten thousand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import SENT, bits, blocked, in_order, labels, messages, pack, rounds, slices_of, unbits, unpack
from .common import partitions, slices
from .text import BLANK, Texts, covered, inside, per_document, range_hashes, window_hashes

U64 = np.uint64
SCHEMA = "n_words long, n_removed long, kept_sha256 string"


def _windows(texts: Texts, window: int, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Word offsets, window codes of every start (0 where none fits), and a second fingerprint of each."""
    offsets, codes, more = [np.zeros(1, np.int64)], [], []
    for _, part in texts.parts():
        starts, ends, at = part.words()
        ok = inside(at, window)
        for seed, into in ((0, codes), (1, more))[: 1 + second]:
            full = np.zeros(len(starts), U64)
            full[: len(ok)] = np.where(ok, window_hashes(range_hashes(part.data, starts, ends, seed), window, seed) | U64(1), U64(0)) if len(ok) else full[:0]
            into.append(full)
        offsets.append(at[1:] + offsets[-1][-1])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, U64)
    return np.concatenate(offsets), join(codes), join(more) if second else None


class _Distinct:
    """The windows of a block by code: the order, the first of each code, and where each slice begins."""

    def __init__(self, codes: np.ndarray, bits: int, n: int) -> None:
        at = np.flatnonzero(codes)
        short = codes[at] >> U64(64 - bits)
        by = np.argsort(short, kind="stable")
        self.at, short = at[by], short[by]
        self.first = np.ones(len(short), bool)
        self.first[1:] = short[1:] != short[:-1]
        self.group = np.cumsum(self.first) - 1
        self.codes = short[self.first]
        self.twice = np.bincount(self.group, minlength=len(self.codes)) > 1 if len(short) else np.zeros(0, bool)
        self.cuts = np.searchsorted(slices_of(self.codes << U64(64 - bits), n), np.arange(n + 1))


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, code_bits: int = 36, sketch_cells: int = 1 << 22) -> DataFrame:
    """One row per document: id and the columns of SCHEMA.

    ``code_bits``: bits of a window's code in the sketches; ``sketch_cells``: counters in each of the two rows that a
    slice holds. Both only change how many windows reach the exact round.
    """
    n = slices(docs.sparkSession)
    keys, id_type = labels(n), docs.schema[id_col].dataType.simpleString()
    texts = blocked(docs, id_col, text_col)

    def sketch(block: pa.Table) -> pa.Table:
        _, codes, _ = _windows(Texts.of(in_order(block).column("text")), window, False)
        own = _Distinct(codes, code_bits, n)
        out = []
        for s in range(n):
            a, b = own.cuts[s], own.cuts[s + 1]
            if b > a:
                packed = pack(own.codes[a:b])
                out.append((s, np.uint32(len(packed)).tobytes() + packed + bits(own.twice[a:b])))
        return messages(block, keys, out)

    def estimate(payloads: list[bytes], ranks: np.ndarray) -> list[bytes]:
        rows = [np.zeros(sketch_cells, np.uint8) for _ in range(2)]

        def read(p: bytes) -> tuple[np.ndarray, np.ndarray]:
            end = 4 + int(np.frombuffer(p, np.uint32, 1)[0])
            codes = unpack(p[4:end])
            return codes, unbits(p[end:], len(codes))

        def cells(codes: np.ndarray) -> list[np.ndarray]:
            return [(codes * U64(m) >> U64(24)) % U64(sketch_cells) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

        for p in payloads:
            codes, twice = read(p)
            for row, cell in zip(rows, cells(codes), strict=True):
                found = np.bincount(cell.astype(np.int64), weights=1 + twice, minlength=0) if sketch_cells < 4 * len(codes) else None
                if found is not None:
                    row[: len(found)] = np.minimum(row[: len(found)] + np.minimum(found, 2).astype(np.uint8), 2)
                else:
                    cell, where = np.unique(cell, return_inverse=True)
                    more = np.minimum(np.bincount(where, weights=1 + twice), 2).astype(np.uint8)
                    row[cell] = np.minimum(row[cell] + more, 2)
        out = []
        for p in payloads:
            c = cells(read(p)[0])
            out.append(bits(np.minimum(rows[0][c[0]], rows[1][c[1]]) >= 2))
        return out

    def flagged(own: _Distinct, answers: pa.Table) -> np.ndarray:
        """Which distinct codes the answers name."""
        out = np.zeros(len(own.codes), bool)
        for s, p in zip(answers.column("at").to_pylist(), answers.column("payload"), strict=True):
            a, b = own.cuts[s], own.cuts[s + 1]
            out[a:b] = unbits(p.as_py(), b - a)
        return out

    def candidates(block: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word offsets; the windows estimated repeated by code, second fingerprint and place; marks of the first of each kind."""
        offsets, codes, more = _windows(Texts.of(in_order(block).column("text")), window, True)
        own = _Distinct(codes, code_bits, n)
        chosen = flagged(own, answers)[own.group] if len(own.group) else np.zeros(0, bool)
        at = own.at[chosen]
        code, second = codes[at] >> U64(64 - code_bits), more[at]
        by = np.lexsort((at, second, code))
        at, code, second = at[by], code[by], second[by]
        first = np.ones(len(at), bool)
        first[1:] = (code[1:] != code[:-1]) | (second[1:] != second[:-1])
        return offsets, at, code, second, first

    def exact(block: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, code, second, first = candidates(block, answers)
        code, second = code[first], second[first]
        cuts = np.searchsorted(slices_of(code << U64(64 - code_bits), n), np.arange(n + 1))
        out = []
        for s in range(n):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                packed = pack(code[a:b])
                out.append((s, np.uint32(len(packed)).tobytes() + packed + second[a:b].tobytes()))
        return messages(block, keys, out)

    def earlier(payloads: list[bytes], ranks: np.ndarray) -> list[bytes]:
        """Which of a block's windows occur in a block of smaller rank."""
        lengths, codes, seconds = [], [], []
        for p in payloads:
            end = 4 + int(np.frombuffer(p, np.uint32, 1)[0])
            codes.append(unpack(p[4:end]))
            seconds.append(np.frombuffer(p[end:], U64))
            lengths.append(len(codes[-1]))
        code, second, rank = np.concatenate(codes), np.concatenate(seconds), np.repeat(ranks, lengths)
        by = np.lexsort((rank, second, code))
        first = np.ones(len(by), bool)
        first[1:] = (code[by][1:] != code[by][:-1]) | (second[by][1:] != second[by][:-1])
        late = np.zeros(len(by), bool)
        late[by] = ~first
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        return [bits(late[cuts[i] : cuts[i + 1]]) for i in range(len(payloads))]

    def remove(block: pa.Table, both: pa.Table) -> pa.Table:
        block = in_order(block)
        first_round = both.filter(pa.compute.equal(both.column("round"), 1))
        offsets, at, code, second, first = candidates(block, first_round)
        late = ~first
        cuts = np.searchsorted(slices_of(code[first] << U64(64 - code_bits), n), np.arange(n + 1))
        known = np.zeros(int(first.sum()), bool)
        second_round = both.filter(pa.compute.equal(both.column("round"), 2))
        for s, p in zip(second_round.column("at").to_pylist(), second_round.column("payload"), strict=True):
            known[cuts[s] : cuts[s + 1]] = unbits(p.as_py(), cuts[s + 1] - cuts[s])
        late[first] = known
        gone = covered(at[late], at[late] + window, int(offsets[-1]))
        hashes, texts_ = [], Texts.of(block.column("text"))
        for a, part in texts_.parts():
            hashes += kept_hashes(part, ~gone[offsets[a] : offsets[a + len(part)]])
        return pa.table({"id_": block.column("id"), "n_words": pa.array(np.diff(offsets)), "n_removed": pa.array(per_document(gone, offsets)), "kept_sha256": pa.array(hashes, pa.string())})

    first = rounds(texts.groupBy("block").applyInArrow(sketch, SENT), estimate)
    second = rounds(texts.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(exact, SENT), earlier)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).repartition(partitions(docs.sparkSession), "block")
    out = texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, f"id_ {id_type}, {SCHEMA}")
    return out.withColumnRenamed("id_", id_col)


def kept_hashes(texts: Texts, keep: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept words, joined by one space."""
    starts, ends, at = texts.words()
    data = np.append(texts.data, np.uint8(32))
    data[ends[BLANK[data[ends]]]] = 32  # not where the next document begins at once
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    chosen = np.flatnonzero(keep)
    last = np.zeros(len(starts), bool)
    if len(chosen):
        last[chosen[np.append(doc[chosen][1:] != doc[chosen][:-1], True)]] = True
    stop = ends + ~last
    step = np.bincount(starts[chosen], minlength=len(data) + 1).astype(np.int64) - np.bincount(stop[chosen], minlength=len(data) + 1)
    mask = np.cumsum(step)[: len(data)] > 0
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    out, cut = memoryview(data[mask].tobytes()), sums[texts.offsets]
    return [hashlib.sha256(out[cut[i] : cut[i + 1]]).hexdigest() for i in range(len(texts))]
