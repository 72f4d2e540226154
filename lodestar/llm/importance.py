"""Importance resampling towards a target distribution.

Features are runs of words, hashed into buckets by CRC-32. A byte automaton
reads the UTF-8 buffer of an Arrow batch: one lookup table says which bytes
belong to words, differences of these marks give the word boundaries, and a
table-driven CRC advances over the bytes of all words at once. A task sums its
bucket counts before they are shuffled, so ``buckets`` rows a task leave it,
whatever the words. Gains by bucket (a table of ``buckets`` numbers, which is
what the driver holds) weigh the documents in a second pass over their texts.
Weights and a Gumbel draw from the id's hash make the score; the places are
numbered by range, so no task ranks all documents.

Defined cases: a null text has no words; an empty table or target gives gains
of smoothed counts; rows of one id and text have one score and take places of
their own; ids that are null count as empty in the hash and come last among
equals; a word of any length is one feature; very long texts are one row of
work; other columns are left out by ``importance_resample`` and carried
unchanged, whatever their names, by ``draw_documents``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.cleaning import surrogate_key
from .common import stored
from .text import Texts, owners, per_document

U32 = np.uint32
#: Bytes of words: digits, small letters and everything beyond ASCII; capitals are lowered first.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def crc_table() -> np.ndarray:
    """The table of the reflected CRC-32 polynomial, by its rule."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = (t >> U32(1)) ^ np.where(t & U32(1), U32(0xEDB88320), U32(0))
    return t


CRC = crc_table()
#: Longer words go through zlib one by one: the automaton takes as many steps as the longest word has bytes.
LONG = 64


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes, and the word offsets of the documents."""
    marks = WORD_BYTE[data]
    starts_doc = np.zeros(len(data) + 1, bool)
    starts_doc[offsets] = True
    change = np.diff(marks.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero((change[:-1] == 1) | (marks & starts_doc[:-1]))
    ends = np.flatnonzero((change[1:] == -1) | (marks & starts_doc[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes of all ranges, one byte of each at a time."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    size, at, now = size[order], starts[order], state[order]
    n_long = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(n_long):
        now[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    size, at, short = size[n_long:], at[n_long:], now[n_long:]
    for step in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -step, "left"))  # those with more bytes than steps taken
        s = short[:m]
        short[:m] = CRC[(s ^ data[at[:m] + step]) & U32(255)] ^ (s >> U32(8))
    out = np.empty_like(now)
    out[order] = now
    return out


def feature_buckets(texts: Texts, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``most`` words, the documents they belong to, and the words of each document."""
    data = LOWER[texts.data]
    starts, ends, offsets = word_bounds(data, texts.offsets)
    doc = owners(offsets)
    state, at = np.full(len(starts), 0xFFFFFFFF, U32), np.arange(len(starts))
    found, owner = [], []
    for k in range(most):
        if k:
            going = at + k < len(starts)
            going[going] = doc[at[going] + k] == doc[at[going]]
            at, state = at[going], state[going]
            state = CRC[(state ^ U32(32)) & U32(255)] ^ (state >> U32(8))
        state = advance(state, data, starts[at + k], ends[at + k])
        found.append((state ^ U32(0xFFFFFFFF)).astype(np.int64) % buckets)
        owner.append(doc[at])
    return np.concatenate(found), np.concatenate(owner), np.diff(offsets)


def bucket_counts(docs: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).parts():
                sums += np.bincount(feature_buckets(part, most, buckets)[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of the target's smoothed share to the corpus's, for each bucket, rounded down."""
    have = []
    for df, column in ((docs, text_col), (target, target_col)):
        sums = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, column, most, buckets).collect():  # at most ``buckets`` rows
            sums[r["bucket"]] = r["n"]
        have.append(sums.tolist())
    s, t = have
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(id_: Column, seed: str) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _weighed(docs: DataFrame, gains: np.ndarray, most: int, id_col: str, text_col: str, carry: bool, seed: str) -> DataFrame:
    """id, n_words, n_features, weight, score, and with ``carry`` the whole row."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in Texts.of(batch.column(1)).parts():
                found, owner, n = feature_buckets(part, most, buckets)
                order = np.argsort(owner, kind="stable") if most > 1 else slice(None)
                features = np.bincount(owner, minlength=len(part)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(features)])
                columns = [n, features, per_document(gains[found[order]], at)]
                rest = [batch.column(i).slice(a, len(part)) for i in (0, *[2] * carry)]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c.astype(np.int64)) for c in columns]], ["id", *["row"] * carry, "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *["row"] * carry)]
    out = rows.mapInArrow(weigh, ", ".join([*kinds, "n_words long, n_features long, weight long"]))
    return out.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def _ranked(weighed: DataFrame, least_words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents as written, those long enough with their places, and how many are drawn."""
    scored = stored(weighed.withColumn("tie", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")]  # the tie also parts rows that are alike
    return scored, surrogate_key(able, "place", order), drawn


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank; the ``percent`` of those with ``least_words``
    words that score highest are drawn (rank 1, 2, 3 ...; of equals the smaller id), the others have no rank."""
    gains = bucket_gains(docs, target, text_col, target_col, most, buckets)
    scored, places, drawn = _ranked(_weighed(docs, gains, most, id_col, text_col, False, seed), least_words, percent)
    own = ["id", "n_words", "n_features", "weight", "score"]
    ranked = places.select(*own, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(*own, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)


def draw_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """The drawn documents themselves, columns unchanged: a filter by the last drawn score and id, no join. Rows that
    repeat the id of the last one drawn come along with it."""
    gains = bucket_gains(docs, target, text_col, target_col, most, buckets)
    _, places, drawn = _ranked(_weighed(docs, gains, most, id_col, text_col, False, seed), least_words, percent)
    last = places.where(F.col("place") == drawn).select("score", "id").first() if drawn else None
    if last is None:
        return docs.limit(0)
    id_ = F.col("id")
    upto = F.lit(True) if last["id"] is None else F.coalesce(id_ <= F.lit(last["id"]), F.lit(False))
    rows = _weighed(docs, gains, most, id_col, text_col, True, seed).where(F.col("n_words") >= least_words)
    return rows.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & upto)).select("row.*")
