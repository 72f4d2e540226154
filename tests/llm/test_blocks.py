"""Blocks: rows without ids, anchors that tie, keys of partitions; empty tables and repeated rows through the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_labels_fall_into_a_partition_each(spark):
    """The keys of blocks replay Spark's hash partitioning; a change of it would make blocks uneven."""
    from lodestar.llm.blocks import labels

    for n in (1, 7, 40):
        keys = spark.createDataFrame([(k,) for k in labels(n)], "k int").repartition(n, "k")
        assert [r[0] for r in keys.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect()] == [1] * n


def mostly_without_ids(seed=5):
    r = random.Random(seed)
    say = lambda k: " ".join(f"w{r.randrange(60)}" for _ in range(k))
    passage = say(30)
    rows = [(i, say(20) + " " + passage) for i in range(6)]
    rows += [(None, say(r.randint(5, 60)) + (" " + passage if i % 4 == 0 else "")) for i in range(54)] + [(None, None), (None, ""), (None, passage), (None, passage)]
    return rows


def test_rows_without_ids_spread_over_blocks(spark):
    from lodestar.llm.blocks import block_bounds, blocked
    from lodestar.llm.common import partitions

    rows = mostly_without_ids()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids, spare = block_bounds(docs, "doc_id")
    assert partitions(spark) - 1 <= len(ids) + 1 + spare <= partitions(spark) and spare >= 4
    got = blocked(docs, "doc_id", "text").collect()
    assert len({x.rank for x in got if x.id is None}) >= 3 and Counter(x.text for x in got) == Counter(t for _, t in rows)
    assert max(x.rank for x in got if x.id is not None) < min(x.rank for x in got if x.id is None)


def brute(items, size):
    """How many elements windows that start earlier cover, for items in order."""
    seen, out = set(), []
    for seq in items:
        gone = set()
        for i in range(len(seq) - size + 1):
            key = tuple(seq[i : i + size])
            gone |= set(range(i, i + size)) if key in seen else set()
            seen.add(key)
        out.append(len(gone))
    return out


def groups(texts):
    """How many groups of near copies there are; texts without words are on their own."""
    sets = []
    for t in texts:
        ws = (t or "").split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    return sum(root[i] == i for i in range(len(sets)))


def test_operators_over_rows_without_ids(spark):
    """Documents with ids are judged as ever, all rows are there, and of equal passages one is left in all."""
    from lodestar.llm import lm_score, near_dedup, suffix_dedup, window_dedup

    rows = mostly_without_ids()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = sorted((i, t) for i, t in rows if i is not None)
    windows = window_dedup.remove_repeated_windows(docs).collect()
    strings = suffix_dedup.remove_repeated_strings(docs).collect()
    assert len(windows) == len(strings) == len(rows)
    assert [x.n_removed for x in sorted((x for x in windows if x.doc_id is not None), key=lambda x: x.doc_id)] == brute([t.split() for _, t in own], 20)
    assert [x.n_removed for x in sorted((x for x in strings if x.doc_id is not None), key=lambda x: x.doc_id)] == brute([list(t.encode()) for _, t in own], 100)
    whole = hashlib.sha256(b"").hexdigest()
    assert sum(x.doc_id is None and x.n_words == 30 and x.kept_sha256 == whole for x in windows) == 2  # the passage alone, whose words all repeat
    left = groups([t for _, t in rows])
    near = near_dedup.near_duplicates(docs).collect()
    assert len(near) == len(rows) and sum(x.kept for x in near) == left < len(rows)
    assert near_dedup.drop_near_duplicates(docs).count() == left
    scores = sorted(x.n_words for x in lm_score.backoff_scores(docs).collect())
    assert scores == sorted(len((t or "").split()) for _, t in rows)


def test_all_rows_without_ids(spark):
    from lodestar.llm.window_dedup import remove_repeated_windows

    docs = spark.createDataFrame([(None, f"only text {i}") for i in range(20)] + [(None, None)], "doc_id bigint, text string")
    assert remove_repeated_windows(docs).count() == 21


def test_anchors_do_not_depend_on_the_text_around():
    """Windows of ties (runs of few letters) have the same anchors in short and in long texts."""
    from lodestar.llm.suffix_dedup import Anchors
    from lodestar.llm.text import Texts

    r = np.random.default_rng(2)
    body = np.concatenate([np.full(150, 97), r.integers(97, 99, 400), np.tile(r.integers(97, 123, 9), 30)]).astype(np.uint8).tobytes().decode()
    fill = "".join(chr(x) for x in r.integers(97, 123, 300_000))
    own = Anchors(Texts.of(pa.array([body])), 100, 32)
    far = Anchors(Texts.of(pa.array([fill + body])), 100, 32)
    inner = set((far.at - len(fill)).tolist())
    # every window of the body that lies whole in both texts has its anchor in both
    places = set(own.at.tolist())
    for start in range(len(body) - 99):
        window = range(start, start + 100 - 32 + 1)
        assert any(i in places for i in window) and any(i in inner for i in window)
    assert {i for i in inner if i >= 100} == {i for i in places if i >= 100}


def test_mix_of_a_very_long_text(spark):
    from lodestar.llm.mixing import mix_to_weights

    long = "ab " * 3_500_000
    out = {x.doc_id: x.size for x in mix_to_weights(spark.createDataFrame([(1, long, "s"), (2, "a b", "t"), (3, None, None)], "doc_id bigint, text string, source string")).collect()}
    assert len(long) > 10_000_000 and out == {1: 3_500_000, 2: 2, 3: 0}


def test_pipeline_of_nothing_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words in a text", None, "s", None), (2, "some words in a text", None, "s", None), (None, "some words in a text", "en", "s", 5)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]
        got = out.collect()
        assert len({x.text for x in got}) == (1 if rows else 0)
