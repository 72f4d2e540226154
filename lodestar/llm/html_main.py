"""Main text of web pages, with site templates removed.

Round 1 hashes the element subtrees of every page and counts, by host, on how
many pages of different content each occurs; copies of a page are one page here,
as they say nothing about what is template. Subtrees that occur on at least
``least_pages`` of them recur, however large the host is. Round 2 parses each
page again beside the recurring subtrees of its host, deletes these, deletes
elements that are no article text by kind (menus, headers, footers, forms,
adverts ...) and joins the blocks that are left.

The recurring subtrees are a table of hashes. Up to ``most_sent`` of them go to
all tasks and the pages are never shuffled; above that they are joined to the
subtrees of the pages, and each page gets its own.

Where a page has an article (or main) element, only what lies in it is text,
and its own paragraphs, headings, lists and tables are never deleted for
recurring: an article printed on many pages is still the article of each.
Elsewhere too, subtrees with running text (``PROSE`` letters in a row outside
links) are deleted for recurring only if an article's worth of other text
(``ENOUGH`` letters) is left; if not, they are the story, and they keep their
paragraphs and headings.
Names (class, id) tell a kind only as whole words or as compounds of known words,
so ``no-sidebar`` is no sidebar, and never on an element that holds over half of
the text that there is to choose from; neither does the attribute ``hidden``.
Reader comments and notices whose names say nothing else (``cookie-consent``) go
however long they are, as long as other text is left.

Defined cases: null html or url counts as empty; an empty html gives an empty
text; repeated rows each get a row; columns other than id, url and html are
ignored; tags that are not closed end where HTML says so or with the page; a tag
that the end of the page cuts off is no text; very long and very deep pages are
read whole, in time linear in their length; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored

# Names of HTML elements and of page regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg math canvas audio video map dialog menu noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
INLINE_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption a b i em strong span u s small sub sup code br q cite mark abbr time kbd samp var del ins font tt big figure hr img".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
LIST_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
REGIONS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar related recommended recommendations share sharing social nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead toolbar pagination pager login search searchbox widget widgets side-bar skip-link".split())
COMMENTS = frozenset("comment comments commentlist commentbox disqus respond reply replies".split())
HEADERS = frozenset("header site-header page-header main-header global-header top-header".split())
#: Words that may stand beside those above in a compound.
BESIDE = frozenset("site page main global top bottom left right primary secondary area box block list section container wrapper wrap inner item items bar panel button buttons link links icon icons form post posts article articles blog entry story stories unit slot zone reader readers user users thread count title body text footer header".split())
#: Words of names that, with nothing but each other, tell a notice of any length.
NOTICES = frozenset("cookie cookies consent gdpr".split())
BESIDE_NOTICES = NOTICES | frozenset("notice notices banner popup modal overlay alert bar box message".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/]?\Z", re.S)
#: An attribute: its name, and its value in quotes of either kind or none.
_ATTRIBUTE = re.compile(r"([^\s\"'/=>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Letters in a row, outside links, that are running text; letters that are an article's worth.
PROSE, ENOUGH = 40, 140
_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_SPACE = re.compile(r"\s+")


class Element:
    """An element of the page; parts are texts and elements in order."""

    __slots__ = ("attrs", "hash", "kind", "parts", "prose", "size", "tag")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.hash = self.size = self.prose = 0
        self.kind = self._kind()

    def _kind(self) -> str:
        """What the element is by its name: "no" text at all, or a "region", "header", "notice" or "comments" if its size allows it."""
        if self.tag in DROPPED:
            return "region" if self.tag in ("form", "aside") else "no"
        if not self.attrs or self.tag in ("#root", "html", "body"):
            return ""
        found = ""
        for name, a, b, c in _ATTRIBUTE.findall(self.attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role" and value in ROLES:
                return "no"
            if name == "hidden" or name == "aria-hidden" and value == "true":
                found = found or "region"
            if name in ("class", "id") and self.tag != "main":
                for word in value.split():
                    found = found or _named(word)
        return found if self.tag != "article" or found != "header" else ""


def _named(word: str) -> str:
    """The kind that a class or id word tells."""
    if word in HEADERS:
        return "header"
    if word in NOTICES:
        return "notice"
    if word in REGIONS or word in COMMENTS:
        return "comments" if word in COMMENTS else "region"
    parts = [x for x in re.split(r"[-_]+", word) if x]
    if any(x in NOTICES for x in parts) and all(x in BESIDE_NOTICES for x in parts):
        return "notice"
    if len(parts) > 1 and all(x in REGIONS or x in COMMENTS or x in BESIDE for x in parts):
        if any(x in COMMENTS for x in parts):
            return "comments"
        if any(x in REGIONS for x in parts):
            return "region"
    return ""


def parse(text: str) -> Element:
    root = Element("#root", "")
    stack, at = [root], 0
    open_: Counter[str] = Counter()

    def close(k: int) -> None:
        open_.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def implied(tag: str) -> None:
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        ends = LIST_ENDS.get(tag)
        if ends and any(open_[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in SCOPES[tag]:
                    break

    n = len(text)
    while at < n:
        m = _TAG.search(text, at)
        if not m:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].parts.append(Element("br", ""))
                continue
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not close these
            continue
        implied(tag)
        attrs = m[3] or m[6] or ""
        element = Element(tag, attrs)
        stack[-1].parts.append(element)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            stop = found.start() if found else n
            element.parts.append(text[at:stop])
            past = text.find(">", stop)
            at = n if past < 0 else past + 1
            continue
        stack.append(element)
        open_[tag] += 1
    _measure(root)
    return root


def _measure(root: Element) -> None:
    """Hash of each subtree, from those of its parts, its number of letters, and those of them in running text."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [p for p in e.parts if isinstance(p, Element)]
    for e in reversed(order):
        seen = [_SPACE.sub(" ", f"{e.tag} {e.attrs}").strip().encode("utf-8", "surrogatepass")]
        for p in e.parts:
            if isinstance(p, Element):
                seen.append(p.hash.to_bytes(8, "little", signed=True))
                e.size += p.size
                e.prose += p.prose if e.tag != "a" else 0
            elif x := _SPACE.sub(" ", p).strip():
                seen.append(b"t" + x.encode("utf-8", "surrogatepass"))
                e.size += len(x)
                e.prose += len(x) if len(x) >= PROSE and e.tag != "a" else 0
        if e.kind == "no":
            e.size = e.prose = 0
        e.hash = xxhash.xxh3_64_intdigest(b"\0".join(seen)) - (1 << 63)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def content_hash(text: str) -> int:
    raw = _SPACE.sub(" ", text).strip()
    return xxhash.xxh3_64_intdigest(raw.encode("utf-8", "surrogatepass")) - (1 << 63)


def of_host(host: str, subtree: int) -> int:
    """One hash for a subtree of a host."""
    return xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass") + subtree.to_bytes(8, "little", signed=True)) - (1 << 63)


def _unwanted(e: Element, whole: int, within: bool) -> bool:
    """Is it no article text? whole: letters of all that there is to choose from; within: an article."""
    if not e.kind or e.kind == "header" and within:
        return False
    return e.kind == "no" or (e.size < whole if e.kind in ("comments", "notice") else 2 * e.size <= whole)


def _main(root: Element) -> list[Element]:
    """The outermost article elements, else the main elements, else nothing."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if _unwanted(e, root.size, False):
                continue
            if e.tag == tag:
                found.append(e)
            else:
                todo += [p for p in reversed(e.parts) if isinstance(p, Element)]
        if found:
            return found
    return []


def _candidates(root: Element, roots: list[Element]) -> Iterator[Element]:
    """Elements that a template may hold: all outside the article, within it those that are not text."""
    inner = {id(e) for e in roots}
    todo = [(root, False)]
    while todo:
        e, within = todo.pop()
        within = within or id(e) in inner
        if e.tag not in ("#root", "html", "body", "head", "br") and id(e) not in inner and not (within and e.tag in INLINE_TEXT):
            yield e
        todo += [(p, within) for p in e.parts if isinstance(p, Element)]


def subtree_hashes(text: str) -> set[int]:
    root = parse(text)
    return {e.hash for e in _candidates(root, _main(root))}


def _dropped(e: Element, roots: set[int], gone: set[int], whole: int) -> bool:
    return id(e) in gone or id(e) not in roots and _unwanted(e, whole, bool(roots)) or e.tag == "header" and not roots and 2 * e.size <= whole


def _left(root: Element, roots: list[Element], gone: set[int], whole: int) -> int:
    """Letters that stay if all of ``gone`` is deleted."""
    n, todo, inner = 0, list(roots) or [root], {id(e) for e in roots}
    while todo:
        e = todo.pop()
        if not _dropped(e, inner, gone, whole):
            n += sum(len(_SPACE.sub(" ", p).strip()) for p in e.parts if isinstance(p, str))
            todo += [p for p in e.parts if isinstance(p, Element)]
    return n


def _told(stories: list[Element]) -> set[int]:
    """The stories, with the paragraphs, headings, lists and tables in them, and what in them holds running text."""
    told, todo = set(), list(stories)
    while todo:
        e = todo.pop()
        if id(e) not in told:
            told.add(id(e))
            todo += [p for p in e.parts if isinstance(p, Element) and (p.tag in INLINE_TEXT or p.prose)]
    return told


def main_text(text: str, template: Container[int], host: str | None = None) -> tuple[str, int]:
    """The text without the subtrees of the template (their hashes, with a host as ``of_host`` gives them), and how many it has."""
    root = parse(text)
    roots = _main(root)
    named = (lambda x: x) if host is None else (lambda x: of_host(host, x))
    found = [(e, named(e.hash)) for e in _candidates(root, roots)]
    found = [(e, x) for e, x in found if x in template]
    whole = sum(e.size for e in roots) if roots else root.size
    gone = {id(e) for e, _ in found}
    if any(e.prose for e, _ in found) and _left(root, roots, gone, whole) < ENOUGH:
        told = _told([e for e, _ in found if e.prose])
        gone -= told
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if block:
                blocks.append(block)
            run.clear()

    inner = {id(e) for e in roots}
    todo: list = list(reversed(roots)) if roots else [root]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            run.append(p)
        elif p is None:
            flush()
        elif p.tag == "br":
            run.append(" ")
        elif _dropped(p, inner, gone, whole):
            if p.tag in BLOCKS:
                flush()
        elif p.tag in BLOCKS:
            flush()
            todo.append(None)
            todo += reversed(p.parts)
        else:
            todo += reversed(p.parts)
    flush()
    return "\n\n".join(blocks), len({x for _, x in found})


class Sorted:
    """A sorted array of hashes to look up in."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values

    def __contains__(self, x: int) -> bool:
        at = int(np.searchsorted(self.values, x))
        return at < len(self.values) and int(self.values[at]) == x


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 10, most_sent: int = 1 << 20) -> DataFrame:
    """One row per page: id, url, text, n_chars, and n_template (recurring subtrees of the host that the page has)."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, bodies = [], [], []
            for key, url, text in zip(*(batch.column(c) for c in ("key", "url_", "html_")), strict=True):
                text = text.as_py() or ""
                found, host = subtree_hashes(text), host_of(url.as_py())
                keys += [key.as_py()] * len(found)
                hashes += [of_host(host, x) for x in found]
                bodies += [content_hash(text)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, hashes, bodies)], ["key", "hash", "body"])

    rows = pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("url_"), F.col(html_col).alias("html_"))
    keyed = rows.select(F.xxhash64(F.lit(3), "id_", "url_", "html_").alias("key"), "*")
    found = stored(keyed.select("key", "url_", "html_").mapInArrow(subtrees, "key long, hash long, body long"), "subtrees")
    often = found.select("hash", "body").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    often = stored(often.select("hash"), "recurring")
    sent = Sorted(np.sort(np.asarray(often.toArrow().column("hash")).astype(np.int64))) if often.count() <= most_sent else None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3) if sent is None else [None] * batch.num_rows
            texts = [main_text(text.as_py() or "", set(x.as_py() or ()) if sent is None else sent, host_of(url.as_py())) for url, text, x in zip(batch.column(1), batch.column(2), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())], ["id_", "url_", "text", "n_chars", "n_template"])

    if sent is None:
        template = found.join(often, "hash").groupBy("key").agg(F.collect_set("hash").alias("template"))
        rows = keyed.join(template, "key", "left").select("id_", "url_", "html_", "template")
    out = rows.mapInArrow(extract, f"id_ {id_type}, url_ {url_type}, text string, n_chars long, n_template long")
    return out.withColumnRenamed("id_", id_col).withColumnRenamed("url_", url_col)
