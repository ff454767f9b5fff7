"""Text: chunks, words, seeds and contexts for retrieval, HTML to text, signs of injection. Columns, but for long texts and the DOM."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph import vocab
from weftgraph.batches import bounded
from weftgraph.graph import Graph

CHUNK_CHARS, CHUNK_OVERLAP = 8000, 400


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def split_text(text: str, most: int, overlap: int) -> list[str]:
    """The chunks of one text; sentences are laid out once, and a chunk's last one is found by bisection of their ends."""
    if len(text) <= most:
        return [text]
    sentences = _SENTENCE_END.split(text.strip())
    flat, ends = " ".join(sentences), list(accumulate(len(x) + 1 for x in sentences))  # an end is where the next one starts
    out: list[str] = []
    now, at = "", 0
    while at < len(sentences):
        room = most - len(now) if now else most
        upto = bisect_right(ends, (ends[at - 1] if at else 0) + room)
        if not now.strip() or now[0].isspace():  # a first sentence takes no room for a space, or takes away the one before it
            upto = min(upto, at + 1)
        if upto > at:
            more = flat[ends[at - 1] if at else 0 : ends[upto - 1] - 1]
            now, at = f"{now} {more}".strip(), upto
            continue
        if now:
            out.append(now)
        now = f"{out[-1][-overlap:].strip() if out else ''} {sentences[at]}".strip()
        at += 1
        while len(now) > most:
            out.append(now[:most])
            now = now[most - overlap :]
    return out + ([now] if now else []) or [text]


def _chunker(kind: str, id_: str, most: int, overlap: int) -> type:
    """A table function from rows of an id and a long text to rows of its chunks."""

    class Chunks:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = split_text(text, most, overlap)
                n = len(parts)
                yield pa.table({id_: pa.concat_arrays([keys.slice(i, 1)] * n), "chunk": pa.array(range(1, n + 1), pa.int32()), "n_chunks": pa.array([n] * n, pa.int32()), "text": pa.array(parts, pa.string())})

    return F.arrow_udtf(Chunks, returnType=f"`{id_}` {kind}, chunk int, n_chunks int, text string")


def chunk_rows(docs: DataFrame, id_: str = "doc_id", most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """id, chunk (from 1), n_chunks, text for each chunk of each text; a null text has none.

    Chunks have at most `most` characters and are cut after sentences; a next chunk repeats the last one's end. A sentence that
    doesn't fit is cut at a fixed stride. A text that fits is one chunk as it is and doesn't reach Python; the others go to a table
    function that gives its chunks as rows, so no row holds all chunks of a text.
    """
    rows = bounded(docs).filter("text is not null").select(id_, "text")
    fits = F.length("text") <= most
    one = rows.filter(fits).select(id_, F.lit(1).alias("chunk"), F.lit(1).alias("n_chunks"), "text")
    cut = _chunker(docs.schema[id_].dataType.simpleString(), id_, most, overlap)
    return one.unionByName(cut(rows.filter(~fits).asTable()))


def name_words(text: Column) -> Column:
    """Distinct words in lower case without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: w != ""))


def query_words(text: Column) -> Column:
    return F.filter(name_words(text), lambda w: F.length(w) > 2)


def retrieval_seeds(g: Graph, queries: DataFrame) -> DataFrame:
    """query_id, id: vertices that share a word (of three or more letters) with a query (query_id, text)."""
    asked = queries.select("query_id", F.explode(query_words(F.col("text"))).alias("word"))
    words = g.v.select("id", F.explode(name_words(F.col("id"))).alias("word"))
    return asked.join(words, "word").select("query_id", "id").distinct()


def fuzzy_seed(g: Graph, query: str, least: float = 0.4) -> DataFrame:
    """The vertex most like any word of a query, where none shares a word; none below `least`."""
    from weftgraph.operators.matching import similarity

    words = [w for w in set(re.sub(r"[^\w\s]", "", query.lower()).split()) if len(w) > 2]

    @F.pandas_udf("double")
    def best(ids: pd.Series) -> pd.Series:
        return pd.Series([max((similarity(i, w) for w in words), default=0.0) for i in ids], dtype="float64")

    return g.v.select("id", "seq", best("id").alias("score")).filter(F.col("score") > least).orderBy(F.desc("score"), F.col("seq").asc_nulls_last(), "id").limit(1)


def context_text(g: Graph, query: str, hops: int = 2, edges: int = 20) -> str:
    """Lines `- a → label → b [confidence: 0.00]` of the edges near a query's vertices, at most `edges`."""
    from weftgraph.operators.paths import context_edges

    if g.v.isEmpty():
        return "The graph is currently empty."
    queries = g.spark.createDataFrame([(0, query)], "query_id int, text string")
    seeds = retrieval_seeds(g, queries).select("id")
    if seeds.isEmpty():
        seeds = fuzzy_seed(g, query).select("id")
    order = [F.col("seq").asc_nulls_last(), "src", "dst"]
    near = context_edges(g, seeds, hops).orderBy(*order).limit(edges).collect()
    if near:
        return "\n".join(f"- {r.src} → {r.label or 'is connected to'} → {r.dst}" + (f" [confidence: {r.confidence:.2f}]" if r.confidence is not None else "") for r in near)
    return "\n".join(f"- {r.src} → {r.label or 'connects to'} → {r.dst}" for r in g.e.orderBy(*order).limit(edges).collect())


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s{2,}", " "))


class _Texts(HTMLParser):
    """Text nodes outside dropped elements, for the whole page and for the containers that are preferred."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, dropped: frozenset[str]) -> None:
        super().__init__()
        self.dropped = dropped
        self.open: list[tuple[str, set[str]]] = []  # open elements, and the containers they are the first of
        self.texts: list[tuple[frozenset[str], str]] = []
        self.found: set[str] = set()

    def hidden(self) -> bool:
        return any(tag in self.dropped for tag, _ in self.open)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.VOID:
            return
        kinds: set[str] = set()
        if tag not in self.dropped and not self.hidden():
            id_ = dict(attrs).get("id") or ""
            kinds = {tag} & {"article", "main", "body"} | ({"id"} if re.search("content|article|main", id_, re.I) else set())
            kinds -= self.found
            self.found |= kinds
        self.open.append((tag, kinds))

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data) -> None:
        if data.strip() and not self.hidden():
            self.texts.append((frozenset().union(*(kinds for _, kinds in self.open)), data.strip()))


BOILERPLATE = frozenset(("script", "style", "nav", "header", "footer", "aside", "ads"))
ARTICLE_BOILERPLATE = frozenset(("script", "style", "nav", "footer"))


def dom_text(html: str, dropped: frozenset[str] = BOILERPLATE, containers: bool = True) -> str:
    """The text of the first article, else main, else an element whose id tells of content, else body, else the page."""
    p = _Texts(dropped)
    p.feed(html)
    p.close()
    for kind in ("article", "main", "id", "body") if containers else ():
        if kind in p.found:
            return re.sub(r"\s{2,}", " ", " ".join(t for kinds, t in p.texts if kind in kinds)).strip()
    return re.sub(r"\s{2,}", " ", " ".join(t for _, t in p.texts)).strip()


# -- the readable part of a page ------------------------------------------------------------------

# Fixed values of the published rule: what counts for and against an element by its class and id, and points by tag.
UNLIKELY = "combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter"
MAYBE = "and|article|body|column|main|shadow"
POSITIVE = "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
NEGATIVE = "combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"
TAG_POINTS = {"div": 5, "article": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
BLOCKS = frozenset(("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul", "section", "article", "main"))
LEAST_PARAGRAPH, LEAST_READABLE = 25, 200
_UNLIKELY, _MAYBE, _POSITIVE, _NEGATIVE = (re.compile(x, re.I) for x in (UNLIKELY, MAYBE, POSITIVE, NEGATIVE))
_SCRIPTS = BOILERPLATE | {"noscript", "template"}
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(("p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "header", "footer", "aside", "form", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"))


class _Page(HTMLParser):
    """The elements of a page in document order, as columns: tag, parent, class weight, own pieces of text."""

    def __init__(self) -> None:
        super().__init__()
        self.tag, self.parent, self.weight, self.block = ["#root"], [-1], [0], [False]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, whether in a link
        self.open, self.hidden, self.links = [0], 0, 0
        self.dropped: list[bool] = [False]

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _Texts.VOID:
            if tag == "br" and not self.hidden:
                self.pieces.append((self.open[-1], " ", self.links > 0))
            return
        if tag in _ENDS_P and self.tag[self.open[-1]] == "p":
            self._close(len(self.open) - 1)
        told = dict(attrs)
        names = [told.get("class") or "", told.get("id") or ""]
        both = " ".join(names)
        drop = tag in _SCRIPTS or tag not in ("html", "body") and bool(_UNLIKELY.search(both)) and not _MAYBE.search(both)
        up = self.open[-1]
        if tag in BLOCKS:
            self.block[up] = True
        self.tag.append(tag)
        self.parent.append(up)
        self.weight.append(sum(25 * bool(_POSITIVE.search(x)) - 25 * bool(_NEGATIVE.search(x)) for x in names if x))
        self.block.append(False)
        self.dropped.append(drop)
        self.open.append(len(self.tag) - 1)
        self.hidden += drop
        self.links += tag == "a"

    def _close(self, i: int) -> None:
        for e in self.open[i:]:
            self.hidden -= self.dropped[e]
            self.links -= self.tag[e] == "a"
        del self.open[i:]

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                self._close(i)
                return

    def handle_data(self, data) -> None:
        if not self.hidden and data:
            self.pieces.append((self.open[-1], data, self.links > 0))


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def readable_text(html: str) -> str:
    """The article of a page, without menus, or an empty text.

    Paragraphs of some length give points, by their commas and length, to the element that holds them and half of them to the one above;
    an element's points shrink by the share of its text that is links. The best element's text is taken, with those
    of its neighbours that have a fifth of its points, or are paragraphs of prose.
    """
    page = _Page()
    page.feed(html)
    page.close()
    n = len(page.tag)
    own: list[list[str]] = [[] for _ in range(n)]
    linked = [0] * n
    for e, text, link in page.pieces:
        own[e].append(text)
        linked[e] += link * len(_flat(text))
    # an element's text has all below it in document order; sizes are of collapsed text
    size = [sum(len(_flat(t)) for t in x) for x in own]
    commas = [sum(t.count(",") for t in x) for x in own]
    for e in range(n - 1, 0, -1):
        for column in (size, commas, linked):
            column[page.parent[e]] += column[e]
    density = lambda e: min(1.0, linked[e] / size[e]) if size[e] else 0.0
    points: dict[int, float] = {}
    for e in range(1, n):
        tag = page.tag[e]
        if tag in ("p", "pre", "td") or tag == "div" and not page.block[e]:
            up = page.parent[e]
            if size[e] < LEAST_PARAGRAPH or up <= 0:
                continue
            more = 1 + commas[e] + min(size[e] // 100, 3)
            for at, share in ((up, 1.0), (page.parent[up], 0.5)):
                if at > 0:
                    points[at] = points.get(at, TAG_POINTS.get(page.tag[at], 0) + page.weight[at]) + more * share
    final = {e: x * (1 - density(e)) for e, x in points.items()}
    if not final:
        return ""
    best = min(final, key=lambda e: (-final[e], e))
    least = max(10.0, final[best] * 0.2)
    chosen = []
    for e in range(1, n):
        if page.parent[e] != page.parent[best]:
            continue
        prose = page.tag[e] == "p" and (size[e] > 80 and density(e) < 0.25 or 0 < size[e] <= 80 and not linked[e] and bool(re.search(r"\.( |$)", _flat(" ".join(own[e])))))
        if e == best or final.get(e, 0.0) >= least or prose:
            chosen.append(e)
    inside = [False] * n
    for e in chosen:
        inside[e] = True
    for e in range(1, n):
        inside[e] = inside[e] or inside[page.parent[e]]
    return _flat(" ".join(t for e, t, _ in page.pieces if inside[e]))


def page_text(html: str | None, dropped: frozenset[str] = BOILERPLATE, containers: bool = True, least: int = 100) -> str | None:
    """The readable text if it is long enough, else the DOM's if that is, else None."""
    if html is None:
        return None
    try:
        text = readable_text(html)
    except (AssertionError, ValueError, RecursionError):  # pages that the parser gives up
        text = ""
    if len(text) > LEAST_READABLE:
        return text
    try:
        text = dom_text(html, dropped, containers)
    except (AssertionError, ValueError):
        return None
    return text if len(text) > least else None


@F.pandas_udf(StringType())
def page_text_udf(html: pd.Series) -> pd.Series:
    return html.map(page_text)


def html_text(html: Column, least: int = 100) -> Column:
    """Readable text of a page: its article, else by its DOM, else without tags; null where none is long enough."""
    plain = strip_tags(html)
    return F.coalesce(page_text_udf(html), F.when(F.length(plain) >= least, plain))


@F.pandas_udf(StringType())
def _article_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda x: page_text(x, ARTICLE_BOILERPLATE, False, 200))


def article_text(html: Column) -> Column:
    """The text of a news article: its readable part, else the page without scripts, styles, navigation and footer, else
    without tags only; the last may be short."""
    plain = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")
    return F.coalesce(_article_udf(html), plain)


def injection_signs(text: Column) -> Column:
    """How many of the patterns a text has."""
    low = F.lower(text)
    parts = [F.coalesce(low.rlike(p).cast("int"), F.lit(0)) for p in vocab.INJECTION]
    return sum(parts[1:], parts[0])


def injection_risk(text: Column) -> Column:
    n = injection_signs(text)
    return F.when(n > 2, "HIGH").when(n > 0, "MEDIUM").otherwise("NONE")


def safe_lines(text: Column) -> Column:
    """A text without the lines that look like instructions."""
    bad = "|".join(f"(?:{p})" for p in vocab.INJECTION[: vocab.LINE_PATTERNS])
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.lower(line).rlike(bad)), "\n")
