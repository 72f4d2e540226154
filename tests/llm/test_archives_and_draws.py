"""WARC archives, importance resampling and vector codes against brute force and edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest

PAGES = "page_id bigint, url string, html string, key string, digest int, size int, payload string, salt int, of int, row int, first string"


def page(i, url, html):
    return (i, url, html, "k", 1, 2, "p", 3, 4, 5, "f")


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(4)
    base = "<p>" + "ä word " * 50 + "</p>"
    rows = [page(i, f"http://h{i % 3}.example/{i}", f"<html>{r.random()}</html>") for i in range(60)]
    rows += [page(100 + i, f"http://copy/{i}", base) for i in range(90)]  # a hot payload
    rows += [page(95, "http://first/", base), page(300, None, None), page(301, "u\r\nX-Bad: 1", ""), page(302, "u", "")]
    rows += [page(400, "same", "twice"), page(400, "same", "twice"), page(400, None, "twice"), page(None, "n", "twice"), page(None, None, "nobody else")]
    rows += [page(500, "tricky", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), page(501, "long", "x" * 3_000_000), page(502, "nul", "a\0b\n")]
    return spark.createDataFrame(rows, PAGES).repartition(4)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_archive(rows, least):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    out, groups = [], {}
    for x in rows:
        groups.setdefault(x.html or "", []).append(x)
    for text, own in groups.items():
        own.sort(key=lambda x: (x.page_id is None, x.page_id or 0, x.url is None, x.url or ""))
        for k, x in enumerate(own):
            again = k > 0 and len(text.encode()) >= least
            out.append((x.page_id, len(text.encode()), b32(text), "revisit" if again else "response", own[0].page_id if again else None))
    return Counter(out)


@pytest.mark.parametrize(("least", "compression"), [(0, "gzip"), (10, "none")])
def test_archives_against_brute_force(spark, pages, tmp_path, least, compression):
    from lodestar.llm.warc import read_archives, resolve_revisits, write_archives

    write_archives(pages, str(tmp_path / "a"), least_bytes=least, stamp="2024-01-02T03:04:05Z", compression=compression)
    records = read_archives(spark, str(tmp_path / "a"), "bigint", payloads=True).cache()
    got = Counter((x.key, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in resolve_revisits(records).collect())
    assert got == brute_archive(pages.collect(), least)
    rows = records.collect()
    assert len({x.record_id for x in rows}) == len(rows) == pages.count()
    held = {x.record_id: x for x in rows if x.record_type == "response"}
    assert all(x.stated_digest == x.payload_digest and b32(x.payload.decode()) == x.payload_digest for x in held.values())
    for x in rows:
        if x.record_type == "revisit":
            assert x.payload is None and held[x.refers_to_id].payload_digest == x.payload_digest
    want = Counter(x.html or "" for x in pages.collect())
    assert {x.payload.decode() for x in held.values()} == set(want)
    assert {x.url for x in rows if x.key == 301} == {"u%0D%0AX-Bad: 1"} and {x.url for x in rows if x.key == 300} == {"urn:page:300"}


def test_archives_are_warc(spark, pages, tmp_path):
    """A second reader, by the rules of the format alone, over the bytes of the files."""
    from lodestar.llm.warc import write_archives

    write_archives(pages, str(tmp_path / "a"), stamp="2024-01-02T03:04:05Z")
    kinds = Counter()
    for f in (tmp_path / "a").glob("part-*"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode().split("\r\n")
            assert head[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in head[1:])
            size = int(fields["Content-Length"])
            block = data[end + 4 : end + 4 + size]
            assert len(block) == size and data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Date"] == "2024-01-02T03:04:05Z" and uuid.UUID(fields["WARC-Record-ID"][10:-1])
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and b"\r\n\r\n" in block
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"].endswith("identical-payload-digest") and block.endswith(b"\r\n\r\n") and fields["WARC-Refers-To-Date"]
            kinds[fields["WARC-Type"]] += 1
            at = end + 8 + size
    assert kinds["revisit"] == 90 + 2 + 3 and sum(kinds.values()) == pages.count()


def test_archives_rewritten_as_one(spark, tmp_path):
    """Repeats across archives become revisits; a revisit finds its payload in another archive."""
    from lodestar.llm.warc import read_archives, resolve_revisits, rewrite_archives, write_archives

    schema = "page_id bigint, url string, html string"
    write_archives(spark.createDataFrame([(5, "a", "shared"), (6, "b", "shared"), (7, "c", "own")], schema), str(tmp_path / "a"))
    write_archives(spark.createDataFrame([(2, "d", "shared"), (9, "e", "own"), (10, "f", "new")], schema), str(tmp_path / "b"))
    rewrite_archives(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    got = {x.key: (x.record_type, x.refers_to, x.payload_bytes) for x in resolve_revisits(read_archives(spark, str(tmp_path / "c"), "bigint")).collect()}
    assert got == {2: ("response", None, 6), 5: ("revisit", 2, 6), 6: ("revisit", 2, 6), 7: ("response", None, 3), 9: ("revisit", 7, 3), 10: ("response", None, 3)}


def test_reader_takes_members_and_other_records():
    from lodestar.llm.warc import opened, parsed

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nWARC-Filename: a\r\n  b\r\n\r\nx: y\n\r\n\r\n"
    data = gzip.compress(info) + gzip.compress(info)
    assert [f["warc-filename"] for f, _ in parsed(opened(data))] == ["a b", "a b"]
    import zstandard

    packed = zstandard.compress(info) + zstandard.compress(info)
    assert len(list(parsed(opened(packed)))) == 2
    with pytest.raises(ValueError):
        list(parsed(io.BytesIO(info[:-8])))
    with pytest.raises(ValueError):
        list(parsed(io.BytesIO(b"no record")))


def test_empty_archives(spark, tmp_path):
    from lodestar.llm.warc import archived

    got = archived(spark.createDataFrame([], "page_id string, url string, html string"), str(tmp_path / "a"))
    assert got.count() == 0 and dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == "string"


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_draw(docs, target, most, buckets, least, percent):
    grams = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(words_of(text))))
    for text in target:
        t.update(map(bucket, grams(words_of(text))))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, text in docs:
        ws = words_of(text)
        weight = sum(gain(bucket(g)) for g in grams(ws))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(ws), len(grams(ws)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    out = []
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    for r in rows:
        out.append((*r, drawn.get(id(r))))
    return Counter(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(9)
    vocabulary = ["Äpfel", "don't", "x1", "ZWEI", "été", "日本", "a-b", "straße", *[f"w{i}" for i in range(40)]]
    docs = [(i * 2, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for i in range(120)]
    docs += [(500, ""), (501, None), (502, " \t--"), (503, "q" * 70_000 + " " + "z" * 64 + " " + "y" * 65), (504, "one"), (505, docs[3][1]), (505, docs[3][1]), (None, docs[4][1]), (None, docs[4][1])]
    return docs, [" ".join(r.choice(vocabulary[:12]) for _ in range(40)) for _ in range(8)] + [None, ""]


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_draw_against_brute_force(spark, prose, most, percent):
    from lodestar.llm.importance import draw_documents, importance_resample

    docs, target = prose
    wide = [(i, t, "r", 1, 2.5, 7, "p", i) for i, t in docs]
    df = spark.createDataFrame(wide, "doc_id bigint, text string, row string, rank int, score double, weight int, place string, id bigint").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance_resample(df, items, most=most, buckets=97, percent=percent)
    got = [(x.doc_id, x.n_words, x.n_features, x.weight, x.score, x["rank"]) for x in out.collect()]
    want = brute_draw(docs, target, most, 97, 20, percent)
    assert Counter(got) == want
    ranks = sorted(x[5] for x in got if x[5])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    drawn = draw_documents(df, items, most=most, buckets=97, percent=percent)
    assert drawn.columns == df.columns
    ids = {x[0] for x in want if x[5]}
    assert {x.doc_id for x in drawn.collect()} == ids and drawn.count() >= len(ranks)


def test_words_and_crcs(prose):
    import pyarrow as pa

    from lodestar.llm.importance import LOWER, feature_buckets, word_bounds
    from lodestar.llm.text import Texts

    texts = Texts.of(pa.array([t for _, t in prose[0]]))
    data = LOWER[texts.data]
    starts, ends, at = word_bounds(data, texts.offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for _, t in prose[0] for w in words_of(t)]
    assert np.diff(at).tolist() == [len(words_of(t)) for _, t in prose[0]]
    assert feature_buckets(texts, 1, 1 << 32)[0].tolist() == [zlib.crc32(w.encode()) for w in found]


def test_words_that_touch_the_next_document():
    import pyarrow as pa

    from lodestar.llm.importance import LOWER, word_bounds
    from lodestar.llm.text import Texts

    texts = Texts.of(pa.array(["ab", "", "cd", None, "e f", "Gh"]))
    data = LOWER[texts.data]
    starts, ends, at = word_bounds(data, texts.offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e", b"f", b"gh"]
    assert np.diff(at).tolist() == [1, 0, 1, 0, 2, 1]


def test_draw_edge_cases(spark, prose):
    from lodestar.llm.importance import draw_documents, importance_resample

    docs, _ = prose
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame(docs, "doc_id bigint, text string")
    none = spark.createDataFrame([], "text string")
    assert importance_resample(empty, none).count() == 0 and draw_documents(empty, none).count() == 0
    got = {x.doc_id: x.weight for x in importance_resample(some, none).collect()}
    assert len(got) == len({i for i, _ in docs}) and got[501] == 0
    assert draw_documents(some, none, least_words=10**6).count() == 0
    alike = spark.createDataFrame([(None, "a b c " * 10)] * 50 + [(1, "a b c " * 10)] * 50, "doc_id bigint, text string")
    ranks = sorted(x["rank"] for x in importance_resample(alike, none, percent=30).collect() if x["rank"])
    assert ranks == list(range(1, 31))


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    each = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * each : (p + 1) * each]
    lead = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in lead] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda e: (dist(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = []
    for i, lab, v in kept:
        at = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, bytes(at).hex(), sum(dist(cut(v, p), books[p][at[p]]) for p in range(parts))))
    sums = Counter()
    for _, lab, _, e in out:
        sums[lab] += e
    return Counter((i, c, e, sums[lab], digest) for i, lab, c, e in out)


def vectors(n=150, width=8, seed=3):
    r = random.Random(seed)
    rows = [(i * 3, [round(r.gauss(0, 0.3), 2) for _ in range(width)], r.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(7, None, 1), (8, [0.1] * (width - 1) + [None], 1), (10, [float("nan")] * width, 0), (11, [float("inf")] + [0.0] * (width - 1), 0), (13, [-0.001] * width, None), (13, [-0.001] * width, None), (None, [0.5] * width, 2), (5000, [30.0, -40.0] * (width // 2), 2)]
    return rows


@pytest.mark.parametrize(("kind", "parts", "entries", "rounds"), [("double", 4, 16, 2), ("float", 8, 256, 3), ("double", 2, 500, 0)])
def test_codes_against_brute_force(spark, kind, parts, entries, rounds):
    from lodestar.llm.codes import compress_vectors

    rows = vectors()
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], f"vec_id bigint, embedding array<{kind}>, label int, id int, codes string, cell int").repartition(3)
    entries = min(entries, 256)
    got = Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in compress_vectors(df, parts, entries, rounds).collect())
    assert got == brute_codes(rows, parts, entries, rounds, 256)


def test_deltas_are_of_changed_parts_only(spark):
    """Plus and minus contributions alone: as many moves as there are parts that change, and the sums still hold."""
    from lodestar.llm.codes import _Deltas, nearest

    r = np.random.default_rng(5)
    x, book = r.integers(-50, 50, (40, 2, 3)), r.integers(-50, 50, (2, 5, 3))
    first, far = nearest(x, book)
    assert far.min() >= 0
    sums = _Deltas(2, 5, 3)
    sums.move(x, np.full((40, 2), -1), first)
    assert sums.n.sum() == 80
    second = first.copy()
    second[:4, 0] = (second[:4, 0] + 1) % 5
    change = _Deltas(2, 5, 3)
    change.move(x, first, second)
    assert not change.n[1].any() and np.abs(change.n[0]).sum() <= 8
    for p in range(2):
        for e in range(5):
            own = x[second[:, p] == e, p]
            assert (sums.sums + change.sums)[p, e].tolist() == own.sum(0).tolist() and (sums.n + change.n)[p, e] == len(own)


def test_distances_of_large_components():
    from lodestar.llm.codes import nearest

    x = np.array([[[1 << 27, -(1 << 27)]]])
    book = np.array([[[-(1 << 27), 1 << 27], [1 << 27, 1 - (1 << 27)]]])
    at, far = nearest(x, book)
    assert at.tolist() == [[1]] and far.tolist() == [[1]]


def test_codes_edge_cases(spark):
    from lodestar.llm.codes import compress_vectors, decode, encode, train_codebooks

    schema = "vec_id bigint, embedding array<float>, label int"
    assert compress_vectors(spark.createDataFrame([], schema)).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    one = compress_vectors(spark.createDataFrame([(1, [0.5] * 32, None)] * 3, schema)).collect()
    assert [(x.code, x.error, x.label_error) for x in one] == [("00" * 16, 0, 0)] * 3
    other = compress_vectors(spark.createDataFrame([(1, [0.5] * 32, 1), (2, [0.5] * 16, 1)], schema)).collect()
    assert [x.vec_id for x in other] == [1]
    huge = compress_vectors(spark.createDataFrame([(1, [3e38] * 32, 1), (2, [-3e38] * 32, 1), (3, [0.0] * 32, None)], schema)).collect()
    assert len(huge) == 3 and all(x.error == 0 for x in huge)
    none = compress_vectors(spark.createDataFrame([(1, [], 1)], schema)).collect()
    assert [(x.code, x.error) for x in none] == [("00" * 16, 0)]
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, [0.5] * 17, 1)], schema))
    df = spark.createDataFrame([(i, [i / 8, -i / 4, 0.5, 1.0], i % 2) for i in range(8)], schema)
    kept, book = train_codebooks(df, parts=2, entries=8, rounds=1)
    back = decode(encode(kept, book), book).collect()
    assert {x.id: [round(y, 3) for y in x.vector] for x in back} == {i: [i / 8, -i / 4, 0.5, 1.0] for i in range(8)}


def test_label_sums_by_join(spark, monkeypatch):
    from lodestar.llm import codes

    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(codes, "MOST_SENT", 1)
    got = Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in codes.compress_vectors(df, 4, 16, 1).collect())
    assert got == brute_codes(rows, 4, 16, 1, 256)
