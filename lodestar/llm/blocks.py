"""Blocks of documents, and packed messages between blocks and slices of a hash space.

Operators that compare all passages of a corpus work in rounds. The documents
lie in blocks: runs of the order by id, each held by one task, shuffled once.
A block sends what it knows of its passages (fingerprints, sorted and packed) to
the slices of the hash space; a slice sees one packed message of each block,
decides, and answers each block with a bitmap in the order of the message. A
passage found many times in a block is sent once, so hot passages cost one entry
a block. The number of blocks and of slices follows the session's shuffle
partitions; nothing is gathered on the driver but the block bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, slices

U64 = np.uint64


def _residue(i: int, n: int) -> int:
    """The partition of an integer key under Spark's hash partitioning (Murmur3 with seed 42)."""
    m = 0xFFFFFFFF
    k = i * 0xCC9E2D51 & m
    k = ((k << 15) | (k >> 17)) & m
    h = 42 ^ (k * 0x1B873593 & m)
    h = ((h << 13) | (h >> 19)) & m
    h = (h * 5 + 0xE6546B64) & m ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return (h - (1 << 32) if h >= 1 << 31 else h) % n


def labels(n: int) -> list[int]:
    """n integer keys, of which hash partitioning into n puts one into each partition."""
    found: dict[int, int] = {}
    i = 0
    while len(found) < n:
        found.setdefault(_residue(i, n), i)
        i += 1
    return [found[k] for k in range(n)]


def _place(key: Column, bounds: list) -> Column:
    """How many bounds lie below the key: first among every k-th bound, then within that run."""
    if not bounds:
        return F.lit(0)
    k = max(1, math.isqrt(len(bounds)))
    heads = F.array(*[F.lit(x) for x in bounds[::k]])
    run = F.size(F.filter(heads, lambda x: x < key))
    near = F.slice(F.array(*[F.lit(x) for x in bounds]), F.greatest(run - 1, F.lit(0)) * k + 1, F.lit(k))
    return F.greatest(run - 1, F.lit(0)) * k + F.size(F.filter(near, lambda x: x < key))


def block_bounds(docs: DataFrame, id_col: str) -> tuple[list, int]:
    """Ids that part the documents into blocks, and how many of the blocks, the last ones, are for rows without an id.

    The ids are approximate, and another call may give others.
    """
    n = partitions(docs.sparkSession)
    row = docs.agg(F.count(F.lit(1)).alias("all"), F.count(id_col).alias("own")).first()
    spare = n * (row["all"] - row["own"]) // max(1, row["all"])
    shares = [(i + 1) / (n - spare) for i in range(n - spare - 1)]
    return sorted((docs.agg(F.percentile_approx(id_col, shares, 20_000).alias("b")).first()["b"] or []) if shares else []), spare


def blocked(docs: DataFrame, id_col: str, text_col: str, carry: bool = False, bounds: tuple[list, int] | None = None) -> DataFrame:
    """The documents with block (its key) and rank (its place in the order by id), one block a partition. Null ids come
    last, by a hash of the text if they fill several blocks, so equal texts stay together.

    With ``carry`` all columns come along in the struct ``row``. Tables that must share blocks share ``bounds``.
    """
    n = partitions(docs.sparkSession)
    ids, spare = block_bounds(docs, id_col) if bounds is None else bounds
    last = F.lit(n - spare) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(spare)) if spare else F.lit(n - 1)
    rank = F.when(F.col(id_col).isNull(), last).otherwise(_place(F.col(id_col), ids))
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    keyed = docs.select(rank.cast("int").alias("rank"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    key = F.element_at(F.array(*[F.lit(x) for x in labels(n)]), F.col("rank") + 1)
    return keyed.select(key.cast("int").alias("block"), "rank", "id", "text", *["row"][: carry]).repartition(n, "block")


def in_order(block: pa.Table) -> pa.Table:
    """The documents of a block by id and text, so that every round sees them alike."""
    return block.sort_by([("id", "ascending"), ("text", "ascending")])


def slices_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The slice, of n equal parts of the hash space, that holds each 64-bit code."""
    return ((codes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as gaps: 16 low bits of each, and the rest of the few larger ones."""
    gaps = np.diff(values, prepend=U64(0))
    if len(gaps) and np.median(gaps) > 40_000:
        low, high, kind = (gaps & U64(0xFFFFFFFF)).astype(np.uint32), gaps >> U64(32), 4
    else:
        low, high, kind = (gaps & U64(0xFFFF)).astype(np.uint16), gaps >> U64(16), 2
    at = np.flatnonzero(high)
    head = np.array([len(gaps), len(at), kind], np.uint32)
    return head.tobytes() + low.tobytes() + at.astype(np.uint32).tobytes() + high[at].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, m, kind = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    gaps = np.frombuffer(data, np.uint16 if kind == 2 else np.uint32, n, 12).astype(np.uint64)
    at = np.frombuffer(data, np.uint32, m, 12 + kind * n)
    gaps[at] |= np.frombuffer(data, np.uint64, m, 12 + kind * n + 4 * m) << U64(8 * kind)
    return np.cumsum(gaps, dtype=U64)


def pack_wide(values: np.ndarray) -> bytes:
    """Sorted codes with gaps of many bits: the low bytes of each gap as they are, as they do not compress, and the rest apart."""
    gaps = np.diff(values, prepend=U64(0))
    low = max(0, (int(np.median(gaps)).bit_length() - 1) // 8) if len(gaps) else 0
    high = gaps >> U64(8 * low)
    far = np.flatnonzero(high > U64(254))
    body = squeeze(np.where(high > U64(254), U64(255), high).astype(np.uint8), far.astype(np.uint32), high[far])
    head = np.array([len(gaps), low, len(body)], np.uint32)
    return head.tobytes() + body + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()


def unpack_wide(data: bytes) -> np.ndarray:
    n, low, size = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    small, far, rest = spread(data[12 : 12 + size], np.uint8, np.uint32, np.uint64)
    high = small.astype(np.uint64)
    high[far] = rest
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :low] = np.frombuffer(data, np.uint8, n * low, 12 + size).reshape(n, low)
    return np.cumsum(gaps.view("<u8").reshape(-1).astype(np.uint64) | high << U64(8 * low), dtype=U64)


def counts_in(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, with the places and values of the few larger ones."""
    far = np.flatnonzero(x > 254)
    return np.minimum(x, 255).astype(np.uint8), far.astype(np.uint32), x[far].astype(np.int64)


def counts_out(small: np.ndarray, far: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[far] = rest
    return out


def bits(x: np.ndarray) -> bytes:
    """Marks, eight to a byte."""
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    """The first n marks."""
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    body = b"".join(raw)
    return np.array([len(body), *map(len, raw)], np.uint64).tobytes() + pa.compress(body, "zstd", asbytes=True) if body else np.zeros(len(arrays) + 1, np.uint64).tobytes()


def spread(data: bytes, *kinds: type) -> list[np.ndarray]:
    head = np.frombuffer(data, np.uint64, len(kinds) + 1).astype(np.int64)
    body = pa.decompress(data[8 * (len(kinds) + 1) :], int(head[0]), "zstd", asbytes=True) if head[0] else b""
    out, a = [], 0
    for kind, size in zip(kinds, head[1:].tolist(), strict=True):
        out.append(np.frombuffer(body[a : a + size], kind))
        a += size
    return out


def rounds(sent: DataFrame, answer: Callable[[list[bytes], np.ndarray], list[bytes]], by: str = "slice") -> DataFrame:
    """Brings the messages (slice, block, rank, at, payload) of each slice together and returns the answers (block, at, payload)."""
    spark = sent.sparkSession

    def run(table: pa.Table) -> pa.Table:
        payloads = [x.as_py() for x in table.column("payload")]
        answers = answer(payloads, table.column("rank").to_numpy())
        return pa.table({"block": table.column("block"), "at": table.column("at"), "payload": pa.array(answers, pa.binary())})

    return sent.repartition(slices(spark), by).groupBy(by).applyInArrow(run, "block int, at int, payload binary").repartition(partitions(spark), "block")


SENT = "slice int, block int, rank int, at int, payload binary"


def messages(block: pa.Table, keys: list[int], payloads: list[tuple[int, bytes]]) -> pa.Table:
    """One row for each slice that the block writes to."""
    m = len(payloads)
    head = [block.column(c)[0].as_py() if block.num_rows else 0 for c in ("block", "rank")]
    at = [x[0] for x in payloads]
    return pa.table({"slice": pa.array([keys[i] for i in at], pa.int32()), "block": pa.array([head[0]] * m, pa.int32()), "rank": pa.array([head[1]] * m, pa.int32()), "at": pa.array(at, pa.int32()), "payload": pa.array([x[1] for x in payloads], pa.binary())})
