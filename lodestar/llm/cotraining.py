"""Quality classifier by co-training of two views.

One view sees the words and shape of the text, the other the metadata of the
page: source, language and length. Both are logistic regressions over a few
dense features and the presence of chosen words or tags, fitted on a bounded
sample of labelled documents (``most_labelled`` ids with the smallest hashes,
one row each). The words are chosen by counts made in Spark over all words of
the sample.

In every round each view scores all unlabelled documents. Those of which it is
confident are its pseudo-labels; of these a bounded sample by hash
(``most_pseudo`` rows at most, in the proportion of the labels, so a view that is
sure of one class only adds nothing) is added to the labelled rows of the other
view, which is fitted again. Then both are calibrated on
labelled rows held out from the fit, combined by a logistic regression over the
two calibrated scores, and all documents are scored in one pass. The same is
done for the toxic label where there is one; a document is kept if it is likely
of good quality and not likely toxic.

The driver holds ``most_labelled`` and ``most_pseudo`` rows of small numbers, no
text; the model is a few thousand numbers, whatever the corpus.

Defined cases: null text, source or language count as empty; an empty text is
rejected; if the labels miss, have one class or number under 20, the label's
score is its share (1 for quality and 0 for toxicity without any label); labels
with a null or repeated doc_id: nulls are ignored, the smallest quality and the
largest toxicity count; a label without a value counts for the other target
only; of documents with one labelled id one is fitted; repeated rows are scored
alike; an empty table of documents gives an empty result; very long texts are
read whole; extra columns are ignored or carried
along, and a clashing name (``quality_score``, ``toxic_score``, ``kept``) is
replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .text import BLANK, Texts, inside, owners, per_document, range_hashes, window_hashes

U64 = np.uint64
DENSE = ("words", "mean_length", "upper", "digit", "symbol", "bang", "bar", "punctuation", "distinct", "same_as_last", "window_repeats", "line_length", "longest_run", "top_word", "capital_words", "short_words")
_TABLES = {}
for _name, _bytes in (("upper", range(65, 91)), ("digit", range(48, 58)), ("symbol", b"#*$%&<>"), ("bang", b"!"), ("bar", b"|"), ("punctuation", b".,;:?")):
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True


#: Bytes of the stems that longer words count for as well.
STEMS = (6, 8)


def word_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Codes of the words in lower case without punctuation at their ends, word offsets, byte starts and ends; and of
    each stem length the words that are longer and the codes of their beginnings."""
    starts, ends, at = texts.words()
    low = texts.lowered().data
    edge = np.zeros(256, bool)
    edge[list(b".,;:!?\"'()[]")] = True
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        full = a < b
        b[full] -= edge[low[b[full] - 1]]
        full = a < b
        a[full] += edge[low[a[full]]]
    stems = []
    for n in STEMS:
        long = np.flatnonzero(b - a > n)
        stems.append((long, range_hashes(low, a[long], a[long] + n, n)))
    return range_hashes(low, a, b), at, starts, ends, stems


def dense_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shape of each text (columns as in DENSE), and the codes of its words and stems with their texts."""
    codes, at, starts, ends, stems = word_codes(texts)
    data, n = texts.data, np.diff(at)
    some, size = np.maximum(n, 1), np.maximum(np.diff(texts.offsets), 1)
    doc = owners(at)
    first = np.ones(len(codes), bool)
    first[1:] = doc[1:] != doc[:-1]
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & ~first[1:]
    order = np.lexsort((codes, doc))
    new = np.ones(len(codes), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(texts))
    counts = np.diff(np.append(np.flatnonzero(new), len(codes))) if len(codes) else np.zeros(0, np.int64)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc[order][new], counts)
    ok = np.flatnonzero(inside(at, 5))
    grams = window_hashes(codes, 5)[ok] if len(ok) else np.zeros(0, U64)
    by = np.lexsort((grams, doc[ok]))
    twin = np.zeros(len(ok), bool)
    twin[1:] = (grams[by][1:] == grams[by][:-1]) & (doc[ok][by][1:] == doc[ok][by][:-1])
    again = np.bincount(doc[ok][by][twin], minlength=len(texts))
    run = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(same, out=run[1:])
    breaks = np.maximum.accumulate(np.where(same, 0, np.arange(len(codes)))) if len(codes) else np.zeros(0, np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, np.arange(len(codes)) - breaks)
    per = {k: per_document(t[data], texts.offsets) / size for k, t in _TABLES.items()}
    lines = per_document(data == 10, texts.offsets) + 1
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_TABLES["upper"][data], out=letters[1:])
    capital = per_document(letters[ends] - letters[starts] >= np.maximum(2, (ends - starts) // 2), at)
    short = per_document(ends - starts <= 3, at)
    solid = per_document(~BLANK[data], texts.offsets)
    columns = [np.log1p(n), solid / some, per["upper"], per["digit"], per["symbol"], per["bang"], per["bar"], per["punctuation"], distinct / some / np.maximum(0.2, 1 - np.log1p(n) / 15), same.astype(float), again / some, np.log1p(n / lines), np.log1p(longest), top / some, capital / some, short / some]
    columns[9] = per_document(same, at) / some
    return np.stack(columns, 1), np.concatenate([codes, *[c for _, c in stems]]), np.concatenate([doc, *[doc[i] for i, _ in stems]])


def meta_features(source: list, lang: list, size: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Length, and codes of source, language and both."""
    from hashlib import blake2b

    def code(*x: object) -> int:
        return int.from_bytes(blake2b(repr(x).encode(), digest_size=8).digest(), "little")

    length = np.log1p(size)
    dense = np.stack([length, length**2 / 10, (size < 200).astype(float)], 1)
    return dense, [[code("s", s or ""), code("l", g or ""), code("b", s or "", g or "")] for s, g in zip(source, lang, strict=True)]


#: Of each view: words chosen at most, documents that must hold one, and the penalty of the fit. The words bound the model,
#: not what is counted or scored; the most telling ones are chosen among those that pass a test of significance.
SHAPES = ((400, 5, 4.0), (200, 20, 4.0))
Shapes = tuple[tuple[int, int, float], tuple[int, int, float]]


class View:
    """Logistic regression over scaled dense features and the presence of chosen words or tags."""

    def __init__(self, penalty: float, size: int, own: np.ndarray) -> None:
        """size: of the vocabulary of all targets; own: the places in it that this one looks at."""
        self.penalty, self.own = penalty, np.zeros(size, bool)
        self.own[own] = True

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -6, 6)

    def fit(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, steps: int = 150) -> None:
        if not hasattr(self, "mean"):  # by the labelled rows, which come first
            self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-9
        on = self.own[cols]
        x, r, c = self.scaled(dense), rows[on], cols[on]
        d, v, n = x.shape[1], len(self.own), len(y)
        w, m, s = np.zeros(d + v + 1), np.zeros(d + v + 1), np.zeros(d + v + 1)
        w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        if hasattr(self, "w"):  # on from the last round
            w, steps = self.w, steps // 2
        for t in range(1, steps + 1):  # Adam on the whole sample
            z = x @ w[:d] + np.bincount(r, weights=w[d : d + v][c], minlength=n) + w[-1]
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.concatenate([x.T @ e, np.bincount(c, weights=e[r], minlength=v), [e.sum()]]) / n
            g[:-1] += self.penalty * w[:-1] / n
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        self.w = w

    def score(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        x, d = self.scaled(dense), dense.shape[1]
        return x @ self.w[:d] + np.bincount(rows, weights=self.w[d:-1][cols], minlength=len(dense)) + self.w[-1]


def platt(columns: list[np.ndarray], y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression over a few scores; the last is the constant. Newton steps, halved until they gain."""
    raw = np.stack(columns, 1)
    mean, scale = raw.mean(0), np.maximum(raw.std(0), 0.1)
    x = np.concatenate([(raw - mean) / scale, np.ones((len(y), 1))], 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, was = np.linalg.solve(h, x.T @ (p - y) + ridge * w), loss(w)
        while np.abs(step).max() > 1e-9 and loss(w - step) > was:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w - step
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


class CoTrained:
    """Two views of one label, calibrated and combined."""

    def __init__(self, y: np.ndarray, held: np.ndarray, views: list[View]) -> None:
        self.y, self.held, self.views = y, held, views
        fit = len(y) >= 20 and 0 < y[~held].mean() < 1 and 0 < (y[held].mean() if held.any() else 0) < 1
        self.constant = None if fit else float(y.mean()) if len(y) else float("nan")

    def fit(self, data: list[tuple], given: list[tuple] | None) -> None:
        """data: (dense, rows, cols) of the labelled rows for both views; given: for each view (dense, rows, cols, labels) from the other."""
        train = np.flatnonzero(~self.held)
        for i, view in enumerate(self.views):
            x, labels = pick(data[i], train), self.y[train]
            if given and len(given[i][3]):
                dense, rows, cols, more = given[i]
                x = np.concatenate([x[0], dense]), np.concatenate([x[1], rows + len(x[0])]), np.concatenate([x[2], cols])
                labels = np.concatenate([labels, more])
            view.fit(*x, labels)

    def calibrate(self, data: list[tuple]) -> None:
        held = np.flatnonzero(self.held)
        scores = [v.score(*pick(d, held)) for v, d in zip(self.views, data, strict=True)]
        self.single = [platt([s], self.y[held]) for s in scores]
        self.both = platt([s * w[0] + w[1] for s, w in zip(scores, self.single, strict=True)], self.y[held])
        self.y = self.held = None  # what scores is the model alone

    def probability(self, data: list[tuple], missing: float) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(data[0][0]), missing if np.isnan(self.constant) else self.constant)
        z = [v.score(*d) * w[0] + w[1] for v, d, w in zip(self.views, data, self.single, strict=True)]
        return sigmoid(z[0] * self.both[0] + z[1] * self.both[1] + self.both[2])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pick(data: tuple, keep: np.ndarray) -> tuple:
    place = np.full(len(data[0]), -1)
    place[keep] = np.arange(len(keep))
    on = place[data[1]] >= 0
    return data[0][keep], place[data[1][on]], data[2][on]


def both_views(text: pa.Array, source: list, lang: list) -> Iterator[tuple[int, int, list[tuple]]]:
    """Start, number and views (dense, rows, codes) of parts of a batch; a code once a row."""
    texts = Texts.of(text)
    for a, part in texts.parts():
        dense, codes, rows = dense_features(part)
        m = len(part)
        meta, tags = meta_features(source[a : a + m], lang[a : a + m], np.diff(part.offsets))
        by = np.lexsort((codes, rows))
        codes, rows = codes[by], rows[by]
        new = np.ones(len(by), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        yield a, m, [(dense, rows[new], codes[new]), (meta, np.repeat(np.arange(m), 3), np.array([c for t in tags for c in t], U64))]


def placed(view: tuple, vocabulary: np.ndarray) -> tuple:
    """(dense, rows, cols): codes as places in the vocabulary, others left out."""
    dense, rows, codes = view
    if not len(vocabulary):
        return dense, rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    hit = vocabulary[at] == codes
    return dense, rows[hit], at[hit]


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


def _arrays(table: pa.Table | pa.RecordBatch, dense: str, cols: str) -> tuple:
    """(dense, rows, cols) of two list columns."""
    def whole(name: str) -> pa.Array:
        c = table.column(name)
        return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)

    lists, values = whole(cols), whole(dense)
    x = np.asarray(values.flatten()).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, 1))
    return x, np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()).astype(np.int64)), np.asarray(lists.flatten()).astype(np.int64)


FEATURES = "dense array<float>, {0} array<{1}>, meta array<float>, {2} array<{1}>"


def _features(columns: list[str], vocabulary: list[np.ndarray] | None):
    """For mapInArrow: the features of text_, source_ and lang_ beside the columns; codes, or places in the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column("source_").to_pylist(), batch.column("lang_").to_pylist()
            for a, m, views in both_views(batch.column("text_"), source, lang):
                out = []
                for k, view in enumerate(views):
                    dense, rows, values = view if vocabulary is None else placed(view, vocabulary[k])
                    flat = values.view(np.int64) if vocabulary is None else values.astype(np.int32)
                    width = pa.array(np.arange(m + 1) * dense.shape[1], pa.int32())
                    out += [pa.ListArray.from_arrays(width, pa.array(dense.astype(np.float32).ravel())), _lists(rows, flat, m)]
                names = ["dense", "codes", "meta", "tags"] if vocabulary is None else ["dense", "words", "meta", "marks"]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).slice(a, m) for c in columns], *out], [*columns, *names])

    return run


def _vocabularies(sample: DataFrame, codes: str, have: list[str], least: int, most: int) -> dict[str, np.ndarray]:
    """For each target the codes whose presence tells most about the labels (G statistic), counted over the sample's rows for the fit."""
    rows = sample.where("NOT held")
    total = rows.agg(*[f(t).alias(f"{k}_{t}") for t in have for k, f in (("n", F.count), ("y", F.sum))]).first()
    counts = [f(t).alias(f"{k}_{t}") for t in have for k, f in (("n", F.count), ("y", F.sum))]
    counted = stored(rows.select(F.explode(codes).alias("code"), *have).groupBy("code").agg(*counts), "codes")
    out = {}
    for t in have:
        n, y = F.col(f"n_{t}"), F.coalesce(f"y_{t}", F.lit(0.0))
        share = (total[f"y_{t}"] or 0.0) / max(1, total[f"n_{t}"])
        if not 0 < share < 1:
            out[t] = np.zeros(0, U64)
            continue
        found = counted.where(n > 0).count()
        rate = F.least(F.greatest((y + share) / (n + 1), F.lit(1e-6)), F.lit(1 - 1e-6))
        g = 2 * (y * F.log(rate / share) + (n - y) * F.log((1 - rate) / (1 - share)))
        # few by chance, of so many
        top = counted.where((n >= least) & (g > 8 + 2 * float(np.log(found + 1)))).orderBy(g.desc(), "code").limit(most).select("code").toArrow()
        out[t] = np.sort(np.asarray(top.column("code")).astype(np.int64).view(U64))
    return out


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, str, str, str], targets: tuple[str, ...], rounds: int, confident: float, most_labelled: int, most_pseudo: int, shapes: Shapes = SHAPES) -> tuple[dict[str, CoTrained], list[np.ndarray]]:
    """The models by target, and the vocabularies of both views."""
    id_col, text_col, source_col, lang_col = columns
    have = [t for t in targets if t in labels.columns]
    if not have:
        return {}, [np.zeros(0, U64)] * 2
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id_")).agg(*[(F.min if t == "quality" else F.max)(t).cast("double").alias(t) for t in have])
    known = stored(known.dropna(how="all", subset=have).select("id_", F.xxhash64("id_", F.lit(7)).alias("k"), *[(F.col(t) > 0.5).cast("double").alias(t) for t in have]), "labels")
    few = known.where(F.col("k") <= _limit(known.count(), 1.1 * most_labelled)).orderBy("k").limit(most_labelled)
    read = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(source_col).cast("string").alias("source_"), F.col(lang_col).cast("string").alias("lang_"))
    parts = F.struct(F.xxhash64("text_", "source_", "lang_").alias("h"), "text_", "source_", "lang_")
    one = read.join(F.broadcast(few), "id_").groupBy("id_", "k", *have).agg(F.min(parts).alias("r")).select("k", *have, "r.text_", "r.source_", "r.lang_")
    kinds = "k long, " + "".join(f"{t} double, " for t in have)
    sample = stored(one.mapInArrow(_features(["k", *have], None), kinds + FEATURES.format("codes", "long", "tags")).withColumn("held", F.pmod("k", F.lit(4)) == 3), "sample")
    chosen = [_vocabularies(sample, c, have, least, most) for c, (most, least, _) in zip(("codes", "tags"), shapes, strict=True)]
    vocabulary = [np.unique(np.concatenate(list(v.values()))) for v in chosen]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for k, name in enumerate(("codes", "tags")):
                _, rows, codes = _arrays(batch, ("dense", "meta")[k], name)
                _, rows, at = placed((None, rows, codes.view(U64)), vocabulary[k])
                cols.append(_lists(rows, at.astype(np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k", *have, "held", "dense")], cols[0], batch.column("meta"), cols[1]], ["k", *have, "held", "dense", "words", "meta", "marks"])

    got = sample.mapInArrow(narrow, f"{kinds}held boolean, " + FEATURES.format("words", "int", "marks")).toArrow().sort_by("k")
    models, data = {}, {}
    for t in have:
        mine = got.filter(pa.compute.is_valid(got.column(t)))
        views = [View(penalty, len(vocabulary[i]), np.searchsorted(vocabulary[i], chosen[i][t])) for i, (_, _, penalty) in enumerate(shapes)]
        models[t] = CoTrained(np.asarray(mine.column(t)).astype(float), np.asarray(mine.column("held")).astype(bool), views)
        data[t] = [_arrays(mine, "dense", "words"), _arrays(mine, "meta", "marks")]
    live = [t for t in have if models[t].constant is None]
    if not live:
        return models, vocabulary
    for t in live:
        models[t].fit(data[t], None)
    if rounds:
        # the small features of all documents without a label, read once a round
        keyed = read.withColumn("k", F.xxhash64(F.lit(7), "id_", "text_"))
        kind = docs.schema[id_col].dataType.simpleString()
        free = keyed.mapInArrow(_features(["id_", "k"], vocabulary), f"id_ {kind}, k long, " + FEATURES.format("words", "int", "marks"))
        free = stored(free.join(known.select("id_"), "id_", "left_anti").drop("id_"), "unlabelled")
    for _ in range(rounds):
        given = _pseudo_labels(free, {t: models[t] for t in live}, confident, most_pseudo)
        for t in live:
            models[t].fit(data[t], given[t])
    for t in live:
        models[t].calibrate(data[t])
    return models, vocabulary


def _limit(n: int, most: float) -> int:
    """The 64-bit hash below which about ``most`` of n lie."""
    return min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, most / max(1, n))))


def _pseudo_labels(free: DataFrame, models: dict[str, CoTrained], confident: float, most: int) -> dict[str, list[tuple]]:
    """By target, for each view the rows (dense, rows, cols, labels) that the other one is confident of, of all documents."""
    cases = [(t, view, label) for t in models for view in (0, 1) for label in (0, 1)]

    def sure(table: pa.RecordBatch) -> np.ndarray:
        data = [_arrays(table, "dense", "words"), _arrays(table, "meta", "marks")]
        p = {(t, v): sigmoid(models[t].views[v].score(*data[v])) for t in models for v in (0, 1)}
        some = data[0][0][:, 0] > 0  # a text without words is rejected anyway and teaches nothing
        return np.stack([some & (p[t, v] >= confident if label else p[t, v] <= 1 - confident) for t, v, label in cases])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = (sure(batch) << np.arange(len(cases))[:, None]).sum(0)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("k")), pa.array(bits)], ["k", "sure"])

    has = [F.approx_count_distinct(F.when(F.col("sure").bitwiseAND(1 << i) > 0, F.col("k"))).alias(str(i)) for i in range(len(cases))]
    counts = free.mapInArrow(marks, "k long, sure long").agg(*has).first()
    found, wanted = dict(zip(cases, counts, strict=True)), []
    for t, view, label in cases:  # in the proportion of the labels: a view that is sure of one class only teaches nothing
        share = models[t].y.mean()
        whole = min(most, found[t, view, 1] / share, found[t, view, 0] / (1 - share))
        wanted.append(whole * (share if label else 1 - share))
    limits = np.array([_limit(n, w) for n, w in zip(counts, wanted, strict=True)])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = np.asarray(batch.column(batch.schema.get_field_index("k"))).astype(np.int64)
                mine = sure(batch) & (k <= limits[:, None])
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array((mine << np.arange(len(cases))[:, None]).sum(0))], [*batch.schema.names, "sure"])
                yield out.filter(pa.array(mine.any(0)))

    got = free.mapInArrow(few, "k long, " + FEATURES.format("words", "int", "marks") + ", sure long").dropDuplicates(["k"]).toArrow().sort_by("k")
    bits = np.asarray(got.column("sure")).astype(np.int64)
    data = [_arrays(got, "dense", "words"), _arrays(got, "meta", "marks")]
    out: dict[str, list[tuple]] = {}
    for t in models:
        out[t] = []
        for view in (0, 1):  # each learns from the other
            low, high = (bits >> cases.index((t, 1 - view, label)) & 1 for label in (0, 1))
            keep = np.flatnonzero(low | high)
            out[t].append((*pick(data[view], keep), high[keep].astype(float)))
    return out


ADDED = ("quality_score", "toxic_score", "kept")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = 3, confident: float = 0.9, most_labelled: int = 10_000, most_pseudo: int = 4_000, shapes: Shapes = SHAPES, carry: bool = False) -> DataFrame:
    """id, quality_score, toxic_score (probabilities) and kept of every document; with ``carry`` also its columns.

    The fit is bounded by ``most_labelled`` labelled ids, ``most_pseudo`` pseudo-labels and ``shapes`` (of each view the
    words in the model, the documents that must hold one, the penalty); all documents and words are counted and scored.
    """
    names = [c for c in (docs.columns if carry else [id_col]) if c not in ADDED]
    scored = _scored(docs, labels, names, (id_col, text_col, source_col, lang_col), rounds, confident, most_labelled, most_pseudo, shapes)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(f"score.{c}").alias(c) for c in ADDED])


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = 3, confident: float = 0.9, most_labelled: int = 10_000, most_pseudo: int = 4_000, shapes: Shapes = SHAPES) -> DataFrame:
    """The documents that are kept, their columns unchanged."""
    return _scored(docs, labels, docs.columns, (id_col, text_col, source_col, lang_col), rounds, confident, most_labelled, most_pseudo, shapes).where("score.kept").select("row.*")


def _scored(docs: DataFrame, labels: DataFrame, names: list[str], columns: tuple[str, str, str, str], rounds: int, confident: float, most_labelled: int, most_pseudo: int, shapes: Shapes) -> DataFrame:
    """row (a struct of the named columns) and score (a struct) of every document."""
    models, vocabulary = train(docs, labels, columns, ("quality", "toxic"), rounds, confident, most_labelled, most_pseudo, shapes)

    @F.arrow_udf("struct<quality_score: double, toxic_score: double, kept: boolean>")
    def score(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        good, bad, kept = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, bool)]
        for _, m, views in both_views(text, source.to_pylist(), lang.to_pylist()):
            some = np.bincount(views[0][1], minlength=m) > 0
            data = [placed(v, x) for v, x in zip(views, vocabulary, strict=True)]
            good.append(models["quality"].probability(data, 1.0) if "quality" in models else np.ones(m))
            bad.append(models["toxic"].probability(data, 0.0) if "toxic" in models else np.zeros(m))
            kept.append(some & (good[-1] >= 0.5) & (bad[-1] < 0.5))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (good, bad, kept)], list(ADDED))

    _, text, source, lang = columns
    # only what the model reads goes to Python; the other columns stay behind
    return docs.select(F.struct(*names).alias("row"), score(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string")).alias("score"))
