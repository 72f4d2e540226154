"""Main text: attributes, recurring stories, notices of any length, names and templates by a second parser, long pages."""

from __future__ import annotations

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

STORY = "The same story is told here in the same words on many pages of one site, and it is told at length. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article title="A hidden gem"><p>All of it</p></article>', "All of it"),
        ("<article><p>One</p><section aria-label='Our hidden history'><p>Two</p></section></article>", "One\n\nTwo"),
        ('<article data-class="sidebar" title="class=ad id=ad"><p>All of it</p></article>', "All of it"),
        ('<article><p>The story as it is told</p><div hidden><p>Gone</p></div><div HIDDEN=""><p>Gone</p></div></article>', "The story as it is told"),
        ("<article hidden><p>All there is</p></article>", "All there is"),
        ('<article><p>The story as told</p><div class=ad>Buy</div><div id = "ad">Buy</div></article>', "The story as told"),
        (f'<div class="cookie-consent"><p>{STORY}</p></div><p>Short story</p>', "Short story"),
        (f'<article><div id="gdpr-notice">{STORY}</div><p>Short</p></article>', "Short"),
        ('<div class="cookie-consent"><p>Nothing else here</p></div>', "Nothing else here"),
        (f'<div class="cookie-recipes"><p>{STORY}</p></div><p>Baked</p>', STORY.strip() + "\n\nBaked"),
    ],
)
def test_attributes_and_notices(page, text):
    from lodestar.llm.html_main import main_text

    assert main_text(f"<html><body>{page}</body></html>", set())[0] == text


SCHEMA = "page_id bigint, url string, html string"


def extracted(spark, pages):
    from lodestar.llm.html_main import extract_main_text

    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_a_story_on_many_pages_stays(spark):
    """Without article elements, beside a unique line; inside one, in any wrapper; and beside templates that go."""
    told = STORY.strip()
    bare = [(i, "http://a.com/", f"<body><div class='bar7'>Log out</div><div><h2>Head</h2><p>{told}</p><p>Short end.</p></div><p>Unique {i}</p></body>") for i in range(12)]
    within = [(100 + i, "http://b.com/", f'<body><article><h1>Seen {i}</h1><div class="text"><p>{told}</p><p>Short end.</p><div><span>Advert</span></div></div><div><span>Advert</span></div></article></body>') for i in range(12)]
    got = extracted(spark, bare + within)
    assert all(got[i] == f"Head\n\n{told}\n\nShort end.\n\nUnique {i}" for i in range(12))
    assert all(got[100 + i] == f"Seen {i}\n\n{told}\n\nShort end." for i in range(12))


def test_running_text_that_recurs_goes_where_an_article_is_left(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    pages = [(i, "http://a.com/", f"<body><article><p>{own(i)}</p><div class='k9'><p>{STORY}</p></div></article></body>") for i in range(12)]
    pages += [(100 + i, "http://b.com/", f"<body><div><p>{STORY}</p></div><div><p>{own(i)}</p></div></body>") for i in range(12)]
    got = extracted(spark, pages)
    assert all(got[i] == own(i) and got[100 + i] == own(i) for i in range(12))


class Outline(HTMLParser):
    """A tree by the parser of the standard library, for pages without broken markup."""

    def __init__(self):
        super().__init__()
        self.stack = [["#root", {}, []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in ("br", "img"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def tree(html):
    reader = Outline()
    reader.feed(html)
    reader.close()
    return reader.stack[0]


def size_of(node):
    return sum(len(re.sub(r"\s+", " ", p).strip()) if isinstance(p, str) else size_of(p) for p in node[2])


def flat(node):
    yield node
    for p in node[2]:
        if not isinstance(p, str):
            yield from flat(p)


def brute_text(html, recurring):
    """The article's blocks; outside menus, by the names that the made pages have and the subtrees that recur."""
    root = tree(html)
    articles = [x for x in flat(root) if x[0] == "article" and x[1].get("class") != "comment"]
    whole = sum(map(size_of, articles))
    blocks, run = [], []

    def flush():
        text = re.sub(r"\s+", " ", "".join(run)).strip()
        run.clear()
        if text:
            blocks.append(text)

    def walk(node, top):
        name = node[1].get("class", "")
        gone = name in ("comments", "cookie-consent") or name in ("sidebar", "newsletter-box") and 2 * size_of(node) <= whole or "hidden" in node[1] and 2 * size_of(node) <= whole
        if not top and (gone or node[0] in ("nav", "script", "form") or node[0] in ("div", "section") and repr(node) in recurring):
            flush()
            return
        inline = node[0] in ("b", "a", "span")
        if not inline:
            flush()
        for p in node[2]:
            if isinstance(p, str):
                run.append(p)
            elif p[0] == "br":
                run.append(" ")
            else:
                walk(p, False)
        if not inline:
            flush()

    for a in articles:
        walk(a, True)
        flush()
    return "\n\n".join(blocks)


def test_names_and_templates_against_another_parser(spark):
    r = random.Random(11)
    say = lambda k: " ".join(r.choice("alpha beta gamma delta kilo lima".split()) + str(r.randrange(999)) for _ in range(k))
    adverts = [f"<div class='z{k}'><span>Advert {k}</span> now</div>" for k in range(4)]
    pages = []
    for i in range(120):
        parts = [f"<p>{say(r.randint(30, 60))}</p>", f"<h2>{say(3)}</h2>", f"<p title='hidden {i}'>{say(9)}<br>{say(2)} <b>{say(1)}</b> &amp; <a href='x'>{say(2)}</a></p>", f"<section aria-label=\"no hidden\"><p>{say(8)}</p></section>", f"<div class='sidebar'>{say(3)}</div>", f"<div class='no-sidebar'><p>{say(4)}</p></div>", f"<div class='newsletter-box'>{say(3)}</div>", f"<div class='comments'><p>{say(100)}</p></div>", f"<div class=\"cookie-consent\">{say(90)}</div>", f"<div hidden><p>{say(2)}</p></div>", f"<ul><li>{say(2)}</li><li>{say(1)}</li></ul>", r.choice(adverts), r.choice(adverts), "<script>x()</script>"]
        lead, rest = parts[0], parts[1:]
        r.shuffle(rest)
        pages.append((i, f"http://h{i % 2}.com/{i}", f"<html><body><nav><a>Menu</a></nav>{r.choice(adverts)}<article>{lead}{''.join(rest)}</article><article class='comment'><p>{say(5)}</p></article></body></html>"))
    counts = Counter()
    for i, _, html in pages:
        for key in {repr(x) for x in flat(tree(html)) if x[0] in ("div", "section")}:
            counts[i % 2, key] += 1
    got = extracted(spark, pages)
    for i, _, html in pages:
        assert got[i] == brute_text(html, {k for (h, k), n in counts.items() if h == i % 2 and n >= 10}), html


def test_a_page_of_ten_megabytes(spark):
    body = "".join(f"<div class='c{i % 7}'><p>Paragraph {i} of a very long page</p></div>" for i in range(160_000))
    many = "".join(f"<article><p>Part {i}</p></article>" for i in range(30_000))
    pages = [(1, "http://a.com/", f"<article>{body}</article>"), (2, "http://a.com/", many), (3, None, "x" * 1_000_000)]
    got = extracted(spark, pages)
    assert len(pages[0][2]) > 10_000_000 and got[1].count("\n\n") == 159_999 and got[1].endswith("Paragraph 159999 of a very long page")
    assert got[2].startswith("Part 0\n\nPart 1\n\n") and got[2].count("\n\n") == 29_999 and len(got[3]) == 1_000_000
