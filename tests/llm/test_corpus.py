"""Corpus operators against brute force, SQL and edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept string, block int"


def made(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeats, nulls and blanks."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "kö ba ci du ef gà".split() for b in "ra sti mon ver qu lé".split()]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = say(40), say(80)
    texts = []
    for i in range(n):
        t = say(r.randint(1, 120))
        kind = i % 10
        if kind == 1:
            t = base
        elif kind == 2:
            w = base.split()
            w[r.randrange(len(w))] = "zzz"
            t = " ".join(w)
        elif kind == 3:
            t = say(20) + "\n" + passage + "\n\n" + say(15)
        elif kind == 4:
            t = (say(12) + " ") * 4
        elif kind == 5:
            t = "aaaa " * 60
        elif kind == 6:
            t = "\t ".join([say(3), "Line # 42 of the footer", "Line # 43 of the footer"])
        elif kind == 7:
            t = say(5) + "\nCall 555-0100 now for more\n" + say(9)
        texts.append(t)
    texts += ["", "   \n\t", None, "word", base, passage]
    rows = [(i * 3, t, "en", None if i % 13 == 0 else f"s{i % 4}", None, i, "x", 7) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_windows(items: list[list], size: int) -> list[set[int]]:
    """Places covered by windows that start earlier, in the given order of documents."""
    seen, out = set(), []
    for seq in items:
        gone = set()
        for i in range(len(seq) - size + 1):
            key = tuple(seq[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out.append(gone)
    return out


def test_window_dedup(docs, rows):
    from lodestar.llm.window_dedup import remove_repeated_windows

    got = {r.doc_id: r for r in remove_repeated_windows(docs).collect()}
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    for row, ws, gone in zip(rows, words, brute_windows(words, 20), strict=True):
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        r = got[row[0]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("piece", [1 << 19, 64])
def test_suffix_dedup(docs, rows, piece):
    """The small piece forces groups to be split by longer common strings."""
    from lodestar.llm.suffix_dedup import remove_repeated_strings

    got = {r.doc_id: r for r in remove_repeated_strings(docs, piece=piece).collect()}
    data = [(t or "").encode() for _, t, *_ in rows]
    for row, b, gone in zip(rows, data, brute_windows([list(x) for x in data], 100), strict=True):
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        r = got[row[0]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_interval_expansion_against_neighbours():
    from lodestar.llm.suffix_dedup import expand_intervals, suffix_array

    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(1, 4, 400), [0], np.tile(r.integers(1, 4, 30), 6), [0]]).astype(np.uint16)
    order = suffix_array(text, 50)
    prefix = expand_intervals(text, order, 20)
    raw = text.tolist()
    for i in range(1, len(order)):
        a, b, k = int(order[i - 1]), int(order[i]), 0
        while a + k < len(raw) and b + k < len(raw) and raw[a + k] == raw[b + k] and k < 20:
            k += 1
        if 0 not in raw[a : a + k]:
            assert prefix[i] == k


def sets_of(text: str | None, words: int) -> set:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize(("words", "threshold", "chunk"), [(3, 0.85, 1500), (5, 0.8, 3)])
def test_near_dedup(spark, words, threshold, chunk):
    from lodestar.llm.near_dedup import near_duplicates

    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(2 * i, t, "", "", 0, 0, "", 0) for i, (_, t, *_) in enumerate(made(2, 40))]
    for i in range(40):  # a cluster around a base: some near each other, some only near the base
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        rows.append((1000 + 7 * i, " ".join(w), "", "", 0, 0, "", 0))
    rows.append((5000, " ".join(base), "", "", 0, 0, "", 0))
    sets = {row[0]: sets_of(row[1], words) for row in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= round(100 * threshold) * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r_.doc_id: r_ for r_ in near_duplicates(spark.createDataFrame(rows, SCHEMA), words=words, threshold=threshold, chunk=chunk).collect()}
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in ids} == {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()}


def test_odd_sketches_tell_the_difference():
    from lodestar.llm.near_dedup import BITS, may_link, odd_sketches

    r = np.random.default_rng(1)
    for n in (30, 300, 5000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for similar, expected in ((0.9, True), (0.85, True), (0.5, False)):
            common = int(2 * n * similar / (1 + similar))
            b = np.concatenate([a[:common], r.integers(0, 1 << 63, n - common, dtype=np.uint64)])
            sketch, samples = odd_sketches(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            assert sketch.shape[1] * 8 == BITS
            x = sketch.view(np.uint64)
            sizes = np.array([float(n)])
            assert may_link(x[0], x[1:2], sizes, sizes, samples[:1], samples[1:], 0.85)[0] == expected


def test_one_of_each_stays_with_its_columns(spark):
    from lodestar.llm.near_dedup import drop_near_duplicates

    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t, "a", "s", 1, 1, "x", 1), (1, t, "a", "s", 1, 1, "x", 1), (2, t + " more", "b", "s", 2, 2, "y", 2), (None, t, "c", "s", 3, 3, "z", 3), (4, None, "d", None, 4, 4, "q", 4), (5, None, "d", None, 4, 4, "q", 4)]
    out = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.kept) for r in out) == [(1, "x"), (4, "q"), (5, "q")]


def test_quality_rules(docs, rows):
    from lodestar.llm.quality_rules import SYMBOLS, quality_rules

    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, text, *_ in rows:
        t = text or ""
        ws = WORD.findall(t)
        lines = Counter(x for x in t.split("\n") if WORD.search(x))
        windows = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        repeated = len({k + j for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for j in range(5)})
        long = Counter(tuple(ws[k : k + 10]) for k in range(len(ws) - 9))
        spans = len({k + j for k in range(len(ws) - 9) if long[tuple(ws[k : k + 10])] > 1 for j in range(10)})
        top = 0
        for n in range(1, len(ws)):
            if max(Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)).values()) < 2:
                break
            top = n
        failed = len(ws) < 10 or 100 * repeated > 20 * len(ws)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(ws), sum(map(len, ws)), sum(t.count(chr(c)) for c in SYMBOLS), sum(c - 1 for c in lines.values()))
        assert (r.n_repeat_words, r.base_failed, r.longest_repeat, r.repeat_words) == (repeated, failed, top, spans)
        assert r.kept == (not failed and 100 * spans <= 15 * len(ws) and top <= 60)


@pytest.mark.parametrize("passes", [1, 8])
def test_decontamination(spark, passes):
    from lodestar.llm.decontamination import Items, Pattern, match_items, normalised

    def distance(item: str, text: str) -> int:
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    r = random.Random(4)
    say = lambda k: "".join(r.choice("abcdefg hij") for _ in range(k))
    for _ in range(20):
        a, b = say(r.randint(1, 70)), say(r.randint(0, 90))
        assert Pattern(a.encode()).nearest(b.encode())[0] == distance(a, b)
    items = [(i, say(r.randint(40, 150))) for i in range(6)] + [(9, "short"), (None, "x" * 60), (10, None)]
    texts = []
    for k in range(40):
        t = list(items[k % 6][1])
        for _ in range(k // 4):
            t[r.randrange(len(t))] = r.choice("xyz")
        texts.append(say(80) + "".join(t) + say(50) + " A short, one!" * (k % 9 == 0) + " shortage" * (k % 5 == 0))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (0, texts[0])]
    found = match_items(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), lot_bytes=200, lots_a_pass=passes).collect()
    assert len(found) == len(rows)
    lot = Items([(i, normalised(t)) for i, t in items[:6]] + [(9, b"short")], 0.08, 8, 24)
    assert lot.errors == [len(t) * 8 // 100 for t in lot.texts[:6]] + [0]
    for f in found:
        text = normalised(dict(rows)[f.doc_id] or "").decode()
        near = {i: distance(t.decode(), text) for i, t in zip(lot.ids, lot.texts, strict=True)}
        near[9] = 0 if "short" in text.split() else 9
        want = [i for i, e in zip(lot.ids, lot.errors, strict=True) if near[i] <= e]
        assert f["items"] == want
        assert f.kept == (not want)
        assert f.distance == (min(near[i] for i in want) if want else None)


def test_main_text_of_a_page():
    from lodestar.llm.html_main import host_of, main_text as with_count, parse, subtree_hashes

    main_text = lambda html, template: with_count(html, template)[0]
    page = '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><header><h1>Site</h1></header><article><header class="article-header"><h1>Title &amp; more</h1></header><p>One<br>two&nbsp;  three<p><b>Four <i>five</b></i><ul><li>a<li>b</ul><aside>Side</aside><form>Form</form><div class="comments">Nice!</div><table><tr><td>x</td><td>y</td></tr></table></article><footer>&copy; x</footer></body></html>'
    assert main_text(page, set()) == "Title & more\n\nOne two three\n\nFour five\n\na\n\nb\n\nx\n\ny"
    assert main_text("", set()) == "" and main_text("plain text", set()) == "plain text"
    assert main_text("<p>cut &amp off <sp", set()) == "cut & off"
    bare = '<body><div><p>Subscribe to us</p></div><p>Real words here</p><div id="sidebar">no</div></body>'
    template = subtree_hashes('<body><div><p>Subscribe to us</p></div></body>')
    assert main_text(bare, template) == "Real words here"
    repeated = "<article><p>Same everywhere</p></article>"
    assert main_text(repeated, subtree_hashes("<body><p>Same everywhere</p></body>")) == "Same everywhere"
    assert host_of("https://User@WWW.Example.com:80/a?b") == "www.example.com" and host_of(None) == ""
    deep = "<div>" * 3000 + "x"
    assert main_text(deep, set()) == "x" and parse(deep).size == 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout no-sidebar"><p>All of it</p></div>', "All of it"),
        ('<div class="content has-nav"><p>All of it</p></div>', "All of it"),
        ('<div class="sidebar"><p>All of the page is here</p></div>', "All of the page is here"),
        ('<form id="page"><div class="site-footer">f</div><p>All of the words</p></form>', "All of the words"),
        ('<article><p>Story</p><section class="related-work"><p>Work</p></section><p class="social-history">Told</p></article>', "Story\n\nWork\n\nTold"),
        ('<article><p>Story</p></article><article class="comment"><p>Nice one</p></article>', "Story"),
        ('<article><p>Story</p><div id="comments"><p>A comment far longer than the story that it is about</p></div></article>', "Story"),
        ('<article><div class="header"><h1>Title</h1></div><p>Story of some words</p><div class="newsletter-box">Mail</div><p class="cookie-notice">C</p></article>', "Title\n\nStory of some words"),
        ('<div class="header">Site</div><p>Story of some words</p>', "Story of some words"),
    ],
)
def test_names_tell_only_as_whole_words(page, text):
    from lodestar.llm.html_main import main_text

    assert main_text(f"<html><body>{page}</body></html>", set())[0] == text


def brute_page(html: str) -> str:
    """The article's text by the parser of the standard library; for pages without names, inline or broken markup."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks, depth, skip = [""], 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("nav", "footer", "script", "style", "head") or dict(attrs).get("class") == "ad":
                self.skip += 1
            self.depth += tag == "article"
            if tag in ("article", "p", "h1", "li", "ul", "div"):
                self.blocks = [*self.blocks, ""]
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("nav", "footer", "script", "style", "head") or tag == "div" and self.skip:
                self.skip -= 1
            self.depth -= tag == "article"
            if tag in ("article", "p", "h1", "li", "ul", "div"):
                self.blocks = [*self.blocks, ""]

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in reader.blocks) if x)


def test_main_text_against_another_parser(spark):
    from lodestar.llm.html_main import extract_main_text

    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(folder)
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got == {r.page_id: brute_page(r.html or "") for r in pages.collect()}


@pytest.mark.parametrize("most_sent", [0, 1 << 20])
def test_templates_of_a_host(spark, most_sent):
    from lodestar.llm.html_main import extract_main_text

    pages = [(i, "http://a.com/x", f"<body><section><p>Notice of the site</p></section><p>Story {i}</p></body>") for i in range(30)]
    pages += [(100 + i, f"http://b{i}.com/x", "<body><section><p>Notice of the site</p></section><p>Story</p></body>") for i in range(3)] + [(200, None, None)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string"), most_sent=most_sent).collect()}
    assert got[7] == "Story 7" and got[100] == "Notice of the site\n\nStory" and got[200] == "" and len(got) == 34


def test_copies_of_a_page_are_no_template(spark):
    from lodestar.llm.html_main import extract_main_text

    copy = "<body><p>Told once</p><p>And copied</p></body>"
    pages = [(i, "http://a.com/x", copy) for i in range(12)] + [(20 + i, "http://a.com/y", f"<body><p>Story {i}</p></body>") for i in range(30)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == "Told once\n\nAnd copied" for i in range(12)) and got[25] == "Story 5"


def test_template_does_not_depend_on_the_size_of_the_host(spark):
    from lodestar.llm.html_main import extract_main_text

    advert = "<div><span>Advert of one section</span></div>"
    pages = [(i, "http://a.com/x", f"<body><article><p>Story {i}</p>{advert if i < 12 else ''}</article></body>") for i in range(400)]
    pages += [(1000 + i, "http://b.com/x", f"<body><article><p>Story {i}</p>{advert}</article></body>") for i in range(9)]
    got = {r.page_id: (r.text, r.n_template) for r in extract_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == (f"Story {i}", int(i < 12)) for i in range(400)) and got[1003] == ("Story 3\n\nAdvert of one section", 0)


def test_mix(docs, rows):
    from lodestar.llm.mixing import fill_targets, mix_to_weights, mixed

    out = mix_to_weights(docs).collect()
    assert len(out) == len(rows)
    by: dict = {}
    for r in out:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target, 0])
        s[0] += r["size"]
        s[1] += r.taken
        s[4] = max(s[4], r["size"])
    for total, taken, size, target, largest in by.values():
        assert total == size and target <= 2 * size + 1e-6 and abs(taken - target) <= largest / 2 + 1e-6
    assert abs(sum(x[3] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1e-3
    names = sorted((s for s in by if s), key=str) + [None]
    wanted = fill_targets([by[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    assert [round(w, 6) for w in wanted] == [by[s][3] for s in names]
    again = mixed(docs)
    assert again.columns == docs.columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in out if r.taken})
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed(docs.repartition(5)).collect()))


def test_scores_against_sql(docs):
    from lodestar.llm.lm_score import backoff_scores
    from lodestar.llm.queries import SQL_OP1

    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL
    want = {r[0]: r[1:] for r in duckdb.sql(SQL_OP1).fetchall()}
    for r in backoff_scores(docs).collect():
        n, full, score, mean = want[r.doc_id]
        assert (r.n_words, r.n_full) == (n, full) and abs(r.score - score) < 1e-3 and abs(r.mean_score - mean) < 1e-4


def test_scores_do_not_break_on_equal_codes(docs):
    """Codes of few bits agree all the time; a hit without a context as frequent counts as not found."""
    from lodestar.llm.lm_score import backoff_scores, ngrams
    from lodestar.llm.text import Texts
    import pyarrow as pa

    assert all(np.isfinite([r.score, r.mean_score]).all() for r in backoff_scores(docs, code_bits=11).collect())
    _, codes, _ = ngrams(Texts.of(pa.array([" ".join(f"w{i}" for i in range(500))])), 3, 64)
    for k, c in enumerate(codes):
        assert len(set((c[k:] & np.uint64(1)).tolist())) == 2 and len(set(c[k:].tolist())) == 500 - k


def test_wide_codes_travel():
    from lodestar.llm.blocks import pack_wide, unpack_wide

    r = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 1 << 63), (5, 3), (4000, 1 << 63), (4000, 9000)):
        codes = np.unique(np.append(r.integers(1, top, n, dtype=np.uint64) * np.uint64(2), np.array([1, (1 << 64) - 1][: 2 * (n == 4000)], np.uint64)))
        assert (unpack_wide(pack_wide(codes)) == codes).all()


def test_lines_against_sql(spark):
    from lodestar.llm.line_dedup import drop_recurring_lines
    from lodestar.llm.queries import SQL_OP2

    r = random.Random(9)
    rows = []
    for i in range(60):
        lines = [" ".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(3)]
        lines.insert(r.randrange(3), f"Posted on day {i} by user {i * 7}")
        if i % 3 == 0:
            lines.append("All rights are kept here always by " + r.choice(["Ann", "Bob", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"]))
        if i % 20 == 0:
            lines.append("rare line of text")
        rows.append((i, "\n".join(lines)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(x) for x in drop_recurring_lines(documents).select("doc_id", "n_lines", "n_dropped", "text").collect())
    documents = documents.toPandas()  # noqa: F841  read by the SQL
    assert got == sorted(duckdb.sql(SQL_OP2).fetchall(), key=lambda x: x[0])
    assert sum(x[2] for x in got) >= 59 + 19 and all("rare line" not in x[3] or x[2] <= 2 for x in got)


def test_templates_that_share_a_leaf(spark):
    from lodestar.llm.line_dedup import drop_recurring_lines

    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    kinds = ["Click here to read the whole story by {}", "Click here to win a great prize from {}", "Click here to see our newest pictures of {}"]
    rows = [(i, kinds[i % 3].format(name()) + f"\nown {name()}") for i in range(60)]
    rows.append((99, "\n".join("Click here to " + " ".join(name() for _ in range(5)) for _ in range(200))))  # dilutes the leaf
    got = {x.doc_id: x.n_dropped for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(3)] == [0, 0, 0] and all(got[i] == 1 for i in range(3, 60)) and got[99] == 0


def test_lines_edge_cases(spark):
    from lodestar.llm.line_dedup import drop_recurring_lines

    rows = [(i, "same line everywhere\n\nown " + "abcdefghijkl"[i]) for i in range(12)] + [(50, None), (51, ""), (None, "same line everywhere"), (0, "same line everywhere\n\nown a")]
    got = drop_recurring_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_lines int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[50].text is None and by[51].text == "" and by[50].n_lines == 0
    assert by[None].n_dropped == 0 and by[None].text == "same line everywhere"  # the null id comes first and keeps it
    assert by[3].text == "\nown d"


def test_classifier_learns(spark):
    from lodestar.llm.cotraining import score_quality

    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good, toxic = i % 4 != 0, i % 7 == 0
        words = [f"w{r.randrange(300)}" for _ in range(60)]
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[5] = "vile"
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 1))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 1)]
    labels += [(None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept int")
    known = spark.createDataFrame([(i, q, t) for i, q, t in labels] + [(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(0, 400, 4)], "doc_id bigint, quality int, toxic int")
    out = {x.doc_id: x for x in score_quality(docs, known).collect()}
    right = sum(out[i].kept == (i % 4 != 0 and i % 7 != 0) for i in range(400))
    assert right >= 390 and not out[900].kept and not out[901].kept and len(out) == 402
    empty = score_quality(docs, known.limit(0)).collect()
    assert all(x.kept == (x.doc_id < 900) for x in empty)


def test_empty_tables(spark):
    from lodestar.llm import cotraining, decontamination, html_main, line_dedup, lm_score, mixing, near_dedup, quality_rules, suffix_dedup, window_dedup

    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for out in (window_dedup.remove_repeated_windows(none), suffix_dedup.remove_repeated_strings(none), near_dedup.near_duplicates(none), quality_rules.quality_rules(none), lm_score.backoff_scores(none), line_dedup.drop_recurring_lines(none), mixing.mixed(none), decontamination.match_items(none, items), cotraining.score_quality(none, labels), html_main.extract_main_text(pages)):
        assert out.count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing like this is in any of the documents at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert 0 < now.count() <= 2 * docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == docs.columns


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_powers_of_a_base(spark):
    """Sums with powers of an odd base modulo 2**64 give both words one value."""
    from lodestar.llm.quality_rules import quality_rules
    from lodestar.llm.window_dedup import remove_repeated_windows

    word = thue_morse(4096)
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{word}\n{other}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.n_removed for r in remove_repeated_windows(docs).collect()] == [0, 0, 0]
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(docs).collect()}[3] == 0


def test_hashes_of_ranges_and_windows():
    from lodestar.llm.text import equal_ranges, gram_codes, range_hashes, window_hashes

    r = np.random.default_rng(1)
    data = r.integers(97, 99, 3000, dtype=np.uint8)
    starts = r.integers(0, 2000, 400)
    ends = starts + r.integers(0, 600, 400)
    codes, raw = range_hashes(data, starts, ends), data.tobytes()
    seen = {}
    for a, b, c in zip(starts.tolist(), ends.tolist(), codes.tolist(), strict=True):
        assert seen.setdefault(raw[a:b], c) == c
    assert len(set(seen.values())) == len(seen)
    for n in (1, 5, 20, 33):
        got = window_hashes(codes, n)
        assert len(got) == len(codes) - n + 1 and got[7] == window_hashes(codes[7 : 7 + n], n)[0]
    assert (gram_codes(data, 32)[50:60] == gram_codes(data[50:91], 32)).all()
    same = equal_ranges(data, starts, starts[::-1].copy(), np.full(400, 5))
    assert same.tolist() == [raw[a : a + 5] == raw[b : b + 5] for a, b in zip(starts.tolist(), starts[::-1].tolist(), strict=True)]


def test_long_strings(spark):
    """Lengths over a byte's range: no place or size wraps."""
    from lodestar.llm.suffix_dedup import remove_repeated_strings

    r = random.Random(8)
    say = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage = say(900)
    rows = [(i, say(300) + (passage if i % 3 else "") + say(200)) for i in range(12)]
    got = {x.doc_id: x.n_removed for x in remove_repeated_strings(spark.createDataFrame(rows, "doc_id bigint, text string"), length=400, gram=32).collect()}
    want = brute_windows([list(t) for _, t in rows], 400)
    assert [got[i] for i, _ in rows] == [len(x) for x in want]


def test_two_templates_in_a_leaf_and_fields_of_any_value(spark):
    from lodestar.llm.line_dedup import drop_recurring_lines

    r = random.Random(6)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows = []
    for i in range(60):
        kind = "Posted here by {} in the group {} now" if i % 2 else "Posted here by {} under old rules of {}"
        rows.append((i, kind.format(name(), name()) + f"\nWe all saw {name()} {name()}"))
    got = {x.doc_id: x.n_dropped for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got.values()) >= 60 + 60 - 3 and got[0] == 0
    rows = [(i, f"Go on now to {'ABCDE'[i % 5]} or to {'FGHIJ'[i // 5 % 5]} with us") for i in range(225)]  # fields with frequent values, and no line in 10 documents
    got = {x.doc_id: x.n_dropped for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got.values()) == 224


def test_components_of_long_paths(spark):
    from lodestar.llm.components import components

    n = 300
    ids = random.Random(2).sample(range(10_000), n)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u bigint, v bigint")
    got = components(links).collect()
    assert {r.root for r in got} == {min(ids)} and len(got) == n - 1


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, text_ string, id int, k int, score int, found int, key int, size bigint, kept string, _s int, _h int, _row int, block int, rank int, uid int"


def test_columns_of_any_name(spark):
    """Every operator that carries columns gives them back unchanged, whatever their names."""
    from lodestar.llm import cotraining, decontamination, line_dedup, mixing, near_dedup

    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) + "\nshared line of the site", "en", f"s{i % 3}", 5, *range(100 + i, 100 + i + 1), "t", *[i] * 5, i, "yes", *[i] * 6) for i in range(30)]
    docs = spark.createDataFrame(rows, CLASH)
    items = spark.createDataFrame([("a", "nothing of this is in there")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(20)], "doc_id bigint, quality int, toxic int")
    outs = [cotraining.drop_rejected(docs, labels), cotraining.score_quality(docs, labels, carry=True), decontamination.drop_contaminated(docs, items), decontamination.match_items(docs, items, carry=True), line_dedup.without_recurring_lines(docs), line_dedup.drop_recurring_lines(docs), mixing.mixed(docs), mixing.mix_to_weights(docs), near_dedup.drop_near_duplicates(docs)]
    for k, out in enumerate(outs):
        assert set(out.columns) >= set(names), k
        same = [c for c in names if c not in ("text", "size", "kept")]
        found = {tuple(x) for x in out.select(*same).collect()}
        assert found and found <= {tuple(x) for x in docs.select(*same).collect()}, k


def test_very_long_texts(spark):
    """A text of 10 MB, its copy and short ones."""
    from lodestar.llm import cotraining, decontamination, line_dedup, lm_score, near_dedup, quality_rules, suffix_dedup, window_dedup

    r = random.Random(12)
    words = [f"w{r.randrange(1 << 20)}" for _ in range(10_000)]
    long = "\n".join(" ".join(words[k] if r.random() < 0.5 else f"x{r.randrange(1 << 30)}" for k in range(a, a + 10)) for a in range(0, 10_000, 10) for _ in range(110))
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short text"), (4, None)], "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    items = spark.createDataFrame([(1, long[5000:5300])], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert len(long) > 10_000_000
    one = {x.doc_id: x for x in window_dedup.remove_repeated_windows(docs).collect()}
    assert one[1].n_removed == 0 and one[2].n_removed == one[2].n_words == 1_100_000
    two = {x.doc_id: x for x in suffix_dedup.remove_repeated_strings(docs).collect()}
    assert two[2].n_removed == two[2].n_bytes == len(long) and two[2].n_spans == 1
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x.doc_id: x.kept for x in decontamination.match_items(docs, items).collect()} == {1: False, 2: False, 3: True, 4: True}
    assert {x.doc_id: x.n_words for x in quality_rules.quality_rules(docs).collect()}[1] == 1_100_000
    assert {x.doc_id: x.n_lines for x in line_dedup.drop_recurring_lines(docs).collect()}[1] == 110_000
    assert lm_score.backoff_scores(docs).count() == 4 and cotraining.score_quality(docs, labels).count() == 4


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_classifier_on_labels_held_out(spark):
    from lodestar.llm.cotraining import score_quality

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = {r.doc_id: r for r in score_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels.where("doc_id % 2 = 0")).collect()}
    unseen = labels.where("doc_id % 2 = 1").collect()
    assert len(unseen) > 1000
    assert sum((out[r.doc_id].quality_score >= 0.5) == (r.quality == 1) for r in unseen) >= 0.95 * len(unseen)
    assert sum((out[r.doc_id].toxic_score >= 0.5) == (r.toxic == 1) for r in unseen) >= 0.95 * len(unseen)


def test_classifier_bounds_rows_not_ids(spark):
    """A document that is repeated is one row of the sample; labels may miss a value; all rows are scored."""
    from lodestar.llm.cotraining import score_quality

    rows = [(1, "good words here", "en", "s")] * 300 + [(i, f"text {i} of some kind", "en", None) for i in range(2, 40)] + [(None, "no id", None, None)] * 3
    labels = [(1, 1, None)] + [(i, i % 2, None) for i in range(2, 40)] + [(5, 0, 1), (7, None, None)]
    out = score_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), most_labelled=10)
    assert out.count() == len(rows) and len({(r.quality_score, r.toxic_score) for r in out.where("doc_id = 1").collect()}) == 1


def test_repeated_rows_and_null_ids(spark):
    """Each row gets an answer; of rows with one id and text the first counts, rows without an id come last."""
    from lodestar.llm import decontamination, html_main, lm_score, mixing, quality_rules, suffix_dedup, window_dedup

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (None, text, None), (None, None, None), (2, "", "s")], "doc_id bigint, text string, source string")
    gone = sorted((r.doc_id or 99, r.n_removed) for r in window_dedup.remove_repeated_windows(docs).collect())
    assert gone == [(1, 0), (1, 60), (2, 0), (99, 0), (99, 60)]
    gone = sorted((r.doc_id or 99, r.n_removed) for r in suffix_dedup.remove_repeated_strings(docs).collect())
    assert gone == [(1, 0), (1, len(text)), (2, 0), (99, 0), (99, len(text))]
    assert sorted(r.n_words for r in lm_score.backoff_scores(docs).collect()) == [0, 0, 60, 60, 60]
    assert sorted(r.n_words for r in quality_rules.quality_rules(docs).collect()) == [0, 0, 60, 60, 60]
    items = spark.createDataFrame([("x", text)], "item_id string, text string")
    assert sorted(r["items"] for r in decontamination.match_items(docs, items).collect()) == [[], [], ["x"], ["x"], ["x"]]
    assert sorted(r["size"] for r in mixing.mix_to_weights(docs).collect()) == [0, 0, 60, 60, 60]
    pages = spark.createDataFrame([(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "u", None)], "page_id bigint, url string, html string")
    assert sorted(r.text for r in html_main.extract_main_text(pages).collect()) == ["", "a", "a"]


def test_pipeline_stages_against_brute_force(spark, tmp_path, docs, rows):
    """Each stage alone, on its own input."""
    import corpus_pipeline
    from lodestar.llm import cotraining
    from lodestar.llm.queries import SQL_OP2, SQL_OP6

    stages = dict(corpus_pipeline.STAGES)
    labels = [(i, int(i % 2 == 0), int(i % 9 == 0)) for i, *_ in rows if i % 2 or i % 4 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = next(t for _, t, *_ in rows if t and len(t) > 150)[20:140]
    spark.createDataFrame([(0, item), (1, "nothing like this is in any of the documents at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    scored = {r.doc_id: r.kept for r in cotraining.score_quality(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), carry=False).collect()}
    assert {r.doc_id for r in run("quality classifier").collect()} == {i for i, k in scored.items() if k}

    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by the SQL
    want = {r[0]: r[3] for r in duckdb.sql(SQL_OP2).fetchall()}
    assert {r.doc_id: r.text or "" for r in run("line dedup").collect()} == want

    sets, root = {i: sets_of(t, 5) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r.doc_id for r in run("MinHash near-dedup").collect()} == {i for i in ids if find(i) == i}

    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    held = {i for i, t, *_ in rows if plain(item) in plain(t)}
    left = {r.doc_id for r in run("benchmark decontamination").collect()}
    assert held and not left & held and all(len(plain(t)) > 100 for i, t, *_ in rows if i not in left)

    took = {r[0]: r[4] // r[1] for r in duckdb.sql(SQL_OP6).fetchall() if r[4]}
    assert Counter(r.doc_id for r in run("source mix").collect()) == Counter(took)
