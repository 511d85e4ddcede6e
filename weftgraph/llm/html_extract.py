"""Main text of web pages by a site style tree.

The DOMs of a host are merged: nodes with the same path of tags, classes and ids are one
node of the tree, which counts the presentation styles (sequences of children) and the
contents seen there. The importance of a node is the entropy of those counts by its
largest possible value; what is much the same on every page has little. Branches of low
importance are removed from each page, as is what HTML itself marks as no main text.
A page that marks its article or main element, and has at least SHARE of the text that is
left there, keeps that element alone, without its own branches of low importance.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: A node seen at least SEEN times on a host with less importance than this is removed.
IMPORTANCE = 0.4
SEEN = 8
#: An article or main element with less of the text left than this is not the page's main text.
SHARE = 0.5
_HELD = 200_000

# The HTML standard's void and raw-text elements, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements and words of class, id and role that mark no main text.
NOISE_TAGS = frozenset("nav aside footer form menu button select input label dialog head search fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "discussion disqus disclaimer footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: What may stand beside such a word in one name (site-footer), unlike other words (has-sidebar, related-science).
PLACE_WORDS = frozenset(
    "area article articles bar block body bottom box container content entry first global group header inner item items last left list main outer page panel post posts primary right secondary section "
    "site top wrap wrapper".split()
)
MAIN_TAGS = frozenset(["article", "main"])
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^"'>]|"[^"]*"|'[^']*')*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


class _Element:
    __slots__ = ("children", "noise", "path", "tag", "text", "worded")

    def __init__(self, tag: str, path: int, noise: bool, worded: int) -> None:
        self.tag, self.path, self.noise, self.worded = tag, path, noise or worded > 0, worded
        self.children: list[str] = []
        self.text: list[str] = []


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_paths: dict[tuple[int, str], tuple[int, bool, int]] = {}


def _worded(mark: str) -> int:
    """2 if a class, id or role is a word for noise, 1 if it is made of such words and places, else 0."""
    words = [w.lower() for w in _WORD.findall(mark)]
    if not any(w in NOISE_WORDS for w in words) or not all(w in NOISE_WORDS or w in PLACE_WORDS for w in words):
        return 0
    return 2 if len(words) == 1 else 1


def _node(parent: int, tag: str, markup: str) -> tuple[int, bool, int]:
    """Path of a node, whether HTML marks it as no main text, and whether only its names do."""
    key = (parent, markup if len(markup) < 200 else _style(tag, markup))
    if key not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        style = _style(tag, markup)
        noise = tag in NOISE_TAGS or bool(_HIDDEN.search(markup))
        names = [] if noise or tag in MAIN_TAGS or tag in ("html", "body") else style.split(" ")[1:]
        _paths[key] = _hash(f"{parent} {style}"), noise, max(map(_worded, names), default=0)
    return _paths[key]


def _style(tag: str, markup: str) -> str:
    marks = [a or b or c for _, a, b, c in _MARKS.findall(markup)]
    return " ".join([tag, *sorted(re.sub(r"\d+", "0", w) for m in marks for w in m.split())])


def walk(page: str) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", element), ("text", string), ("close", element), with end tags filled in."""
    stack = [_Element("", 0, False, 0)]

    def leave(depth: int) -> Iterator[tuple[str, object]]:
        while len(stack) > depth:
            yield "close", stack.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        markup = m[0]
        if markup.startswith("<!") or markup.startswith("<?"):
            continue
        tag = _NAME.match(markup)[1].lower()
        if markup[1] == "/":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                yield from leave(depth)
            continue
        if tag in RAW:
            if not markup.endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in BLOCK), 0)
            if depth and stack[depth].tag == "p":
                yield from leave(depth)
        if tag in _CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SCOPE[tag]:
                    break
                if stack[i].tag in _CLOSES[tag]:
                    yield from leave(i)
                    break
        element = _Element(tag, *_node(stack[-1].path, tag, markup))
        children = stack[-1].children
        if not children or children[-1] != tag:
            children.append(tag)
        yield "open", element
        if tag in VOID:
            yield "close", element
        else:
            stack.append(element)
    yield from leave(1)


def settled(page: str) -> list[tuple[str, object]]:
    """The events of a page, in which names alone make no noise of what holds the main text.

    That is an element with all text of articles and main elements, and where there are
    none, one with more than half of all text, if its name is no single word for noise.
    If noise by name leaves no text at all, it is ignored.
    """
    events = list(walk(page))
    if not any(kind == "open" and x.worded for kind, x in events):
        return events
    size = marked = kept = inside = named = mains = 0
    open_at: list[tuple[int, int]] = []
    held: list[tuple[_Element, int, int]] = []
    for kind, x in events:
        if kind == "text":
            if not inside:
                n = len("".join(x.split()))
                size += n
                marked += n if mains else 0
                kept += 0 if named else n
            continue
        step = 1 if kind == "open" else -1
        inside += step * (x.noise and not x.worded)
        named += step * (x.worded > 0)
        if kind == "open":
            open_at.append((size, marked))
            mains += x.tag in MAIN_TAGS
        else:
            mains -= x.tag in MAIN_TAGS
            before = open_at.pop()
            if x.worded:
                held.append((x, size - before[0], 0 if mains else marked - before[1]))
    for x, n, main in held:
        if not kept and n or (main == marked if marked else x.worded == 1 and 2 * n > size):
            x.noise = False
    return events


def style_counts(page: str) -> Iterator[tuple[int, int, int]]:
    """(path, kind, value) for each node of a page: kind 0 a presentation style, 1 a content."""
    open_nodes: list[_Element] = []
    inside = 0
    for kind, x in settled(page):
        if kind == "text":
            if open_nodes and not inside:
                open_nodes[-1].text.append(x)
        elif kind == "open":
            open_nodes.append(x)
            inside += x.noise
        else:
            open_nodes.pop()
            if not inside and x.tag not in MAIN_TAGS and x.tag not in ("html", "body"):
                text = " ".join("".join(x.text).split())
                yield x.path, 0, _hash(" ".join(x.children))
                yield x.path, 1, _hash(text)
                if open_nodes:
                    open_nodes[-1].text.append(f" {text} ")
            inside -= x.noise


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of a page without marked noise and without the branches in `low`.

    Where articles, or else main elements, outside of noise have at least SHARE of that text, theirs alone.
    """
    whole: list[str] = []
    chosen: dict[str, list[str]] = {"article": [], "main": []}
    seen = dict.fromkeys(chosen, False)
    block: list[str] = []
    noisy = lows = 0
    depth = dict.fromkeys(chosen, 0)

    def flush() -> None:
        text = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if text and not lows:
            for tag, out in chosen.items():
                if depth[tag]:
                    out.append(text)
            whole.append(text)

    for kind, x in settled(page):
        if kind == "text":
            if not noisy:
                block.append(x)
            continue
        if x.tag in BLOCK or x.noise or x.path in low:
            flush()
        elif x.tag == "br" and kind == "open" and not noisy:
            block.append(" ")
        step = 1 if kind == "open" else -1
        top_header = x.tag == "header" and not (depth["article"] or depth["main"])
        if x.noise or top_header:
            noisy += step
        elif x.path in low:
            lows += step
        if x.tag in depth:
            depth[x.tag] += step
            seen[x.tag] |= not noisy
    flush()
    for tag in ("article", "main"):
        if seen[tag] and chosen[tag] and sum(map(len, chosen[tag])) >= SHARE * sum(map(len, whole)):
            return "\n".join(chosen[tag])
    return "\n".join(whole)


def _pairs(path: str = "html"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], t) for i, t in enumerate(kinds)), pa.array([n for _, n in rows], pa.int64())], names=["host", "path", "kind", "value", "n"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((host, *x) for x in style_counts(page or ""))
                if len(held) > _HELD:
                    yield out()
        yield out()

    return run


def site_style_trees(pages: DataFrame) -> DataFrame:
    """pages(host, html) to (host, path, seen, importance): the merged tree of every host.

    Equal pages of a host are one page, so that many copies of one do not make its main
    text look the same on every page.
    Importance is the larger of the entropies of a node's presentations and contents, each
    by the logarithm of how often the node was seen, from 0 to 1. Counts are summed in the
    map tasks first, so that a host with a third of the pages is no large group.
    """
    distinct = pages.where("html is not null").withColumn("digest", F.sha2(F.col("html"), 256)).dropDuplicates(["host", "digest"])
    counts = distinct.select("host", "html").mapInArrow(_pairs(), "host string, path long, kind int, value long, n long")
    values = counts.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    kinds = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("s"))
    share = F.when(F.col("seen") > 1, (F.log("seen") - F.col("s") / F.col("seen")) / F.log("seen")).otherwise(1.0)
    return kinds.withColumn("share", share).groupBy("host", "path").agg(F.max("seen").alias("seen"), F.max("share").alias("importance"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low: dict[tuple, frozenset[int]] = {}
    for batch in batches:
        texts = []
        for page, paths in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
            key = tuple(paths or ())
            if key not in low:
                low.clear()
                low[key] = frozenset(key)
            texts.append(main_text(page or "", low[key]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages(page_id, url, html).

    Blocks have their character references decoded and white space made one space, and
    are joined by newlines in page order. Null, empty and text-free pages give an empty
    text. The host is what the url has between // and the next / ? or #, lower-cased;
    rows with no url are one site. Other columns are not read; repeated rows are alike.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    trees = site_style_trees(rows.select("host", "html"))
    low = trees.where((F.col("seen") >= SEEN) & (F.col("importance") < IMPORTANCE)).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low"))
    joined = rows.join(stored(low, "trees"), "host", "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
