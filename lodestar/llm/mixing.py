"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed hash. For every source the words are summed by hash
bucket; the budget falls into one bucket, and only the documents of that bucket
are summed again by the next bits of the hash, until the bucket holds one hash
value. The result is a threshold for each source, applied as a filter: no sort
of the documents and the same choice in every run. A larger budget has a larger
threshold, so mixes are nested.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; a source without words has target 0; rows with one id share a
hash and are taken together, those without an id go by their text; an empty
table gives an empty result; very long texts are one row with their size;
columns other than id, text and source are carried along, and a clashing name
(``size``, ``source_size``, ``target``, ``taken``) is replaced by the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stored

#: Up to so many sources, their plan goes to all tasks; above it is joined.
MOST_SENT = 100_000


def _sent(plan: DataFrame, n: int) -> DataFrame:
    return F.broadcast(plan) if n <= MOST_SENT else plan


#: The hash has 60 bits, of which each round of histograms looks at 12.
HASH_BITS, ROUND_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
_OWN = ("size", "source_size", "target", "taken")


def hash60(key: Column, text: Column) -> Column:
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text "), text), F.lit(""))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def fill_targets(totals: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Shares ``share`` of all words by weight; no target exceeds ``cap`` times its source, the excess goes to the others by weight."""
    budget = share * sum(totals)
    order = sorted(range(len(totals)), key=lambda i: (cap * totals[i] / weights[i], i))
    full, level = 0, 0.0
    filled, rest = 0.0, float(sum(weights))
    for full in range(len(order) + 1):
        if full == len(order):
            break
        level = (budget - filled) / rest
        i = order[full]
        if level <= cap * totals[i] / weights[i]:
            break
        filled += cap * totals[i]
        rest -= weights[i]
    out = [0.0] * len(totals)
    for at, i in enumerate(order):
        out[i] = cap * totals[i] if at < full else level * weights[i]
    return out


def thresholds(sized: DataFrame, budgets: dict) -> dict:
    """For each source the largest hash that is taken: with all smaller ones it brings the words nearest to the budget.

    ``sized`` has source, size and h. One aggregation a round over the documents of the boundary buckets.
    """
    spark = sized.sparkSession
    done, open_ = {}, {}
    for source, budget in budgets.items():
        if budget > 0:
            open_[source] = (0, 0, budget)  # prefix so far, words below it, budget
        else:
            done[source] = -1
    kind = T.StructType([T.StructField("source", sized.schema["source"].dataType), T.StructField("prefix", T.LongType()), T.StructField("below", T.LongType()), T.StructField("budget", T.DoubleType())])
    for bits in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        if not open_:
            break
        at = spark.createDataFrame([(s, *v) for s, v in open_.items()], kind)
        s = at.select(F.col("source").alias("s"), "prefix", "below", "budget")
        near = sized.join(_sent(s, len(open_)), sized["source"].eqNullSafe(s["s"])).where(F.shiftright("h", HASH_BITS - bits + ROUND_BITS) == F.col("prefix"))
        hist = near.groupBy("source", "below", "budget", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"))
        # at most 2**ROUND_BITS buckets of a source, whatever the number of documents
        cells = F.sort_array(F.collect_list(F.struct("bucket", "words", "least", "most")))
        for row in hist.groupBy("source", "below", "budget").agg(cells.alias("cells")).toLocalIterator():
            below, top = row["below"], row["cells"][0]["least"] - 1
            for cell in row["cells"]:
                words = cell["words"]
                if below + words <= row["budget"] and not (cell is row["cells"][-1]):
                    below, top = below + words, cell["most"]
                    continue
                if cell["least"] == cell["most"]:  # one hash value: in or out
                    if 2 * below + words <= 2 * row["budget"]:
                        below, top = below + words, cell["most"]
                        if cell is not row["cells"][-1]:
                            continue
                    done[row["source"]] = top
                elif below + words <= row["budget"]:
                    done[row["source"]] = cell["most"]
                else:
                    open_[row["source"]] = (cell["bucket"], below, row["budget"])
                break
        open_ = {s: v for s, v in open_.items() if s not in done}
    return done


def mix_to_weights(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = True) -> DataFrame:
    """Adds size, source_size, target and taken (long: words taken, repeats counted) to every document.

    The weights repeat over the sources in code point order. A target of q times its source and a rest takes
    every document q times and the rest by hash threshold. The driver holds one row for each source.
    ``carry=False`` returns id, source and the added columns only, and reads the texts once.
    """
    rest = [c for c in docs.columns if c not in _OWN] if carry else [id_col, source_col]
    out = _planned(docs, rest, weights, share, cap, id_col, text_col, source_col, carry)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns unchanged."""
    out = _planned(docs, docs.columns, weights, share, cap, id_col, text_col, source_col, True)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(cap))))).where(F.col("copy") <= copies).select("row.*")


def _planned(docs: DataFrame, rest: list[str], weights: Sequence[float], share: float, cap: float, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    """row (a struct of the named columns), size, source_size, target and taken of every document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = (F.col(source_col).alias("source"), size.alias("size"), hash60(F.col(id_col), F.col(text_col)).alias("h"))
    sized = stored(docs.select(F.col(id_col).alias("id"), *own), "sized")
    totals = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).toLocalIterator()}
    names = sorted((s for s in totals if s is not None), key=str) + [None] * (None in totals)
    targets = fill_targets([totals[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share, cap) if names else []
    whole = {s: int(t // totals[s]) if totals[s] else 0 for s, t in zip(names, targets, strict=True)}
    limit = thresholds(sized, {s: t - whole[s] * totals[s] for s, t in zip(names, targets, strict=True)})
    kind = T.StructType([T.StructField("of", docs.schema[source_col].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("limit", T.LongType())])
    plan = docs.sparkSession.createDataFrame([(s, totals[s], t, whole[s], limit[s]) for s, t in zip(names, targets, strict=True)], kind)
    if carry:
        rows = docs.select(F.struct(*rest).alias("row"), *own)
    else:
        rows = sized.select(F.struct(F.col("id").alias(id_col), F.col("source").alias(source_col)).alias("row"), "source", "size", "h")
    took = F.col("size") * (F.col("whole") + (F.col("h") <= F.col("limit")).cast("long"))
    return rows.join(_sent(plan, len(names)), F.col("source").eqNullSafe(F.col("of"))).select("row", "size", "source_size", "target", took.alias("taken"))
