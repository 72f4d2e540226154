"""Product codes of vectors, with codebooks by a Lloyd iteration that is maintained by deltas.

Vectors are cut into parts, and each part position has a codebook. A round is one
pass: a task assigns the parts of its vectors, writes the assignments beside the
vectors, and sums what changed - plus a part where it goes, minus where it left -
by position and entry before anything is shuffled. The running integer sums of
all entries, ``parts`` times ``entries`` rows bounded by these parameters, are
what the driver holds; parts whose assignment stays cost nothing. All arithmetic
is in integers, so that the order of summation does not matter.

Defined cases: rows with a null vector or null or non-finite components are
dropped, as are vectors of another length than the first kept one's; fewer
vectors than entries make smaller codebooks; vectors without components have
error 0; ids may repeat or be null (last in order), each row gets its code;
components beyond a bound at which squared distances would not fit a long (about
half a million for 64 components) count as that bound; an empty table gives an
empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stored

#: Label sums of up to so many labels go to all tasks; above it they are joined in ``SALTS`` parts.
MOST_SENT, SALTS = 100_000, 32
#: Entry of a part that no round has assigned yet.
NONE = -1


def _bound(width: int) -> int:
    return 1 << ((60 - max(1, width).bit_length()) // 2)


def _usable(vector: Column, kind: T.DataType) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.forall(vector, lambda x: x.isNotNull())
    return vector.isNotNull() & whole


def _matrix(column: pa.Array, width: int, scale: int, parts: int) -> np.ndarray:
    """Integer components of a list column as (rows, parts, width of a part)."""
    flat = column.flatten().cast(pa.float64(), safe=False)
    with np.errstate(over="ignore"):
        x = np.floor(flat.to_numpy(zero_copy_only=False) * float(scale))
    most = _bound(width)
    return np.clip(x, -most, most).astype(np.int64).reshape(len(column), parts, width // parts)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the nearest entry of its codebook (rows, parts), the lower of equals, and the squared distance."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * max(1, x.shape[2]) * top * top < 1 << 53  # then doubles are integers, and products of matrices will do
    at, far = np.empty(x.shape[:2], np.int16), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        if exact:
            a, b = x[:, p].astype(np.float64), book[p].astype(np.float64)
            d = (b * b).sum(1)[None, :] - 2 * (a @ b.T) + (a * a).sum(1)[:, None]
        else:
            d = ((x[:, p, None, :] - book[p][None, :, :]) ** 2).sum(2)
        at[:, p] = d.argmin(1)
        far[:, p] = np.take_along_axis(d, at[:, p : p + 1].astype(np.int64), 1)[:, 0].astype(np.int64)
    return at, far


class _Deltas:
    """Sums by position and entry of the parts that came and went."""

    def __init__(self, parts: int, entries: int, width: int) -> None:
        self.n, self.sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

    def move(self, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        for p in range(x.shape[1]):
            changed = np.flatnonzero(old[:, p] != new[:, p])
            for at, sign in ((new[changed, p], 1), (old[changed, p], -1)):
                have = at != NONE
                np.add.at(self.n[p], at[have], sign)
                np.add.at(self.sums[p], at[have], sign * x[changed[have], p])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cell (position and entry as one number), count and sums of the cells touched."""
        n, sums = self.n.reshape(-1), self.sums.reshape(self.n.size, self.sums.shape[2])
        at = np.flatnonzero((n != 0) | (sums != 0).any(1))
        return at, n[at], sums[at]


def _round(rows: DataFrame, book: np.ndarray, scale: int) -> DataFrame:
    """One pass: every vector with its new assignment, and (where id, label and vector are null) the deltas of the task."""
    parts, entries, each = book.shape
    width = parts * each
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Deltas(parts, entries, each)
        kinds = None
        for batch in batches:
            id_, label, vector, codes = (batch.column(c) for c in ("id", "label", "vector", "codes"))
            kinds = [c.type for c in (id_, label, vector)]
            x = _matrix(vector, width, scale, parts)
            old = np.stack([np.frombuffer(c.as_py(), np.int16) for c in codes]) if len(codes) else np.zeros((0, parts), np.int16)
            new, _ = nearest(x, book)
            sums.move(x, old, new)
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([id_, label, vector, pa.array([r.tobytes() for r in new], pa.binary()), none, none, pa.nulls(len(x), pa.list_(pa.int64()))], [*names, "cell", "n", "sums"])
        if kinds is not None:
            at, n, total = sums.rows()
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), k) for k in kinds], pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], [*names, "cell", "n", "sums"])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("cell long, n long, sums array<long>").fields])
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))


def train_codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, np.ndarray | None]:
    """The kept vectors (id, label, vector) and their codebooks (parts, entries, width of a part) after the rounds;
    None for a table without any kept vector."""
    v = F.col(vector_col)
    item = vectors.schema[vector_col].dataType.elementType
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.where(_usable(v, item)).select(F.col(id_col).alias("id"), label.alias("label"), v.alias("vector"))
    first = [F.col("id").asc_nulls_last(), F.col("vector")]
    lead = kept.orderBy(*first).select(F.size("vector").alias("n")).first()
    if lead is None:
        return kept, None
    width = int(lead["n"])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vector") == width)
    seeds = kept.orderBy(*first).select("vector").limit(entries).collect()  # a parameter bounds them
    start = _matrix(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), width, scale, parts)
    book = np.ascontiguousarray(start.transpose(1, 0, 2))
    n, sums = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
    rows = kept.withColumn("codes", F.lit(np.full(parts, NONE, np.int16).tobytes()))
    for _ in range(rounds):
        done = stored(_round(rows, book, scale), "assigned")
        rows = done.where(F.col("cell").isNull()).select("id", "label", "vector", "codes")
        total = [F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(book.shape[2])]
        for r in done.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows
            at = divmod(r["cell"], book.shape[1])
            n[at] += r["n"]
            sums[at] += np.array([r[f"s{j}"] for j in range(book.shape[2])], np.int64)
        book = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], book)
    return kept, book


def codebook_digest(book: np.ndarray | None) -> str:
    """SHA-256 of the components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist() if book is not None else [])).encode()).hexdigest()


def encode(kept: DataFrame, book: np.ndarray, scale: int = 256) -> DataFrame:
    """id, label, code (two hex digits for each part) and error (squared distances, summed over parts) of each vector."""
    parts, _, each = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = nearest(_matrix(batch.column("vector"), parts * each, scale, parts), book)
            codes = [r.astype(np.uint8).tobytes().hex() for r in at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["id", "label", "code", "error"])

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    return kept.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, book: np.ndarray, scale: int = 256, code_col: str = "code", out: str = "vector") -> DataFrame:
    """Adds the vectors that the codes stand for, in the components' own units."""
    books = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in part]) for part in book.tolist()])
    steps = [F.element_at(F.element_at(books, p + 1), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p in range(book.shape[0])]
    return codes.withColumn(out, F.concat(*steps))


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: id, code, error, label_error (the errors of its label summed, nulls together) and
    codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept, book = train_codebooks(vectors, parts, entries, rounds, scale, id_col, vector_col, label_col)
    digest = F.lit(codebook_digest(book)).alias("codebooks_sha256")
    if book is None:
        return kept.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))], digest)
    coded = stored(encode(kept, book, scale), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(MOST_SENT + 1).count() <= MOST_SENT:
        met = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        far = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        met = salted.join(far, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", digest)
