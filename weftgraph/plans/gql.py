"""The graph query language: text to a rule and its parameters, to a plan over a graph's frames.

Parsing is done on the driver; a query becomes one lazily built DataFrame, capped where the language caps.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import paths as P
from weftgraph.operators import relational as R
from weftgraph.stage import stage
from weftgraph.vocab import RESULT_CAP

HELP = (
    "path from A to B", "neighbors of A", "successors of A", "predecessors of A", "nodes with degree > N", "top N nodes by degree",
    "top N nodes by betweenness", "edges between A and B", "edges where label contains TEXT", "nodes with confidence >= X", "count GROUP",
    "isolated nodes", "hub nodes [with degree N]", "find GROUP [that VERB A]", "ego of A [hops N]", "count relationships between A and B",
)
_EDGES = "edge|edges"
_LINKS = "relationship|relationships|edge|edges"
_NODES = "node|nodes"
#: Kinds of queries, the more specific first, and their forms. A form is a row of items that the query's words must follow:
#: words parted by bars stand for one of them, before a question mark for one or none; `$a` is one or more words, as few as
#: the rest allows, `#n` a whole number, `~n` a number, `<op>n` a comparison with one, `@g` a word of letters and digits, and
#: a full stop the query's end. What follows a form that doesn't end is ignored.
FORMS: dict[str, tuple[str, ...]] = {
    "help": ("help|? .",),
    "path": ("show|find? path from $a to $b .",),
    "predecessors": ("predecessor|predecessors|incoming of $a .",),
    "successors": ("successor|successors|outgoing of $a .",),
    "neighbors": ("neighbor|neighbors|neighbour|neighbours of $a .",),
    "ego": ("ego of $a hops #n .", "ego of $a ."),
    "degree": (f"{_NODES} with degree <op>n",),
    "top_degree": (f"top #n {_NODES} by degree",),
    "top_betweenness": (f"top #n {_NODES} by betweenness",),
    "count_between": (f"count {_LINKS} between $a and $b .",),
    "edges_between": (f"list? {_EDGES} between|from $a and|to $b .",),
    "edges_label": (f"list? {_EDGES} where|with? label contains? $text .",),
    "confidence": (f"{_NODES} with confidence <op>~n",),
    "count": ("count @group",),
    "isolated": (f"isolated|disconnected|orphan {_NODES}",),
    "hubs": (f"hub {_NODES} with degree #n", f"hub {_NODES}"),
    "find_that": ("find @group that @verb $a .",),
    "find": ("find @group",),
}


class QueryError(ValueError):
    """A query that cannot be parsed or that names an unknown vertex."""


@dataclass(frozen=True)
class Query:
    kind: str
    params: dict[str, str] = field(default_factory=dict)
    raw: str = ""


def _follow(items: list[str], words: list[str]) -> dict[str, str] | None:
    """What the items' names stand for, if the words follow them; else None."""
    if not items:
        return {}
    item, rest = items[0], items[1:]
    if item == ".":
        return None if words else {}
    if item[0] == "$":
        for n in range(1, len(words) + 1):
            if (more := _follow(rest, words[n:])) is not None:
                return {item[1:]: " ".join(words[:n])} | more
        return None
    if item.startswith("<op>"):
        return _compared(item[4:].lstrip("~"), "~" in item, rest, words)
    if item[-1] == "?" and len(item) > 1 and not item.endswith("|?"):
        if words and words[0] in item[:-1].split("|") and (more := _follow(rest, words[1:])) is not None:
            return more
        return _follow(rest, words)
    if not words:
        return None
    word, name = words[0], item[1:]
    if item[0] in "#~@":
        found = {"#": r"[0-9]+", "~": r"[0-9.]+", "@": r"\w+"}[item[0]]
        if not (m := re.match(found, word)):
            return None
        more = _follow(rest, words[1:])
        return None if more is None else {name: m[0]} | more
    return _follow(rest, words[1:]) if word in item.split("|") else None


def _compared(name: str, fraction: bool, rest: list[str], words: list[str]) -> dict[str, str] | None:
    """A comparison at the words' start, whose number may be the next word."""
    sign = next((x for x in (">=", "<=", "!=", "==", "=", ">", "<") if words and words[0].startswith(x)), None)
    if sign is None:
        return None
    number = words[0][len(sign) :]
    left = words[1:] if number or len(words) < 2 else words[2:]
    number = number or (words[1] if len(words) > 1 else "")
    number = re.match(r"[0-9.]*" if fraction else r"[0-9]*", number)[0]
    more = _follow(rest, left)
    return {"op": sign, name: number} | more if number and more is not None else None


def parse(text: str) -> Query:
    words = text.lower().split()
    for kind, forms in FORMS.items():
        for form in forms:
            found = _follow(form.split(), words)
            if found is not None:
                return Query(kind, {k: v.strip("\"'") for k, v in found.items()}, text)
    raise QueryError(f"unknown query: {text!r}; try help")


def vertex(g: Graph, name: str) -> str:
    """The id that a name means: without regard to case, else the most similar one."""
    from weftgraph.operators.mutate import resolve

    row = R.named(g.v, name).first()
    if row is None:
        row = resolve(g.spark.createDataFrame([(name,)], "name string"), g.v).filter("id is not null").first()
    if row is None:
        raise QueryError(f"no vertex is called {name!r}")
    return row.id


def _between(g: Graph, q: dict[str, str]) -> DataFrame:
    try:
        a, b = vertex(g, q["a"]), vertex(g, q["b"])
    except QueryError:  # names that nothing has give an empty result here
        return R.edges_between(g, "", "").limit(0)
    return R.edges_between(g, a, b)


def _path(g: Graph, q: dict[str, str]) -> DataFrame:
    """Both names are looked up in one job, on the vertices as they were written once; the search writes the edges that it reads."""
    slim = Graph(stage(g.v.select("id", "seq"), "path-v"), g.e)
    found = {r.which: r.id for r in R.named(slim.v, q["a"]).select(F.lit("a").alias("which"), "id").unionByName(R.named(slim.v, q["b"]).select(F.lit("b").alias("which"), "id")).collect()}
    a, b = (found.get(x) or vertex(slim, q[x]) for x in "ab")
    return P.path_summary(P.shortest_path(slim, a, b, default_label=""), a, b)


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise QueryError(f"not a number: {text!r}") from None


_EDGE = ("src", "dst", "label", "confidence")


@dataclass(frozen=True)
class Rule:
    """A kind's whole result, the columns that it shows, and whether the language caps it (by degree, or in order of arrival)."""

    plan: Callable[[Graph, dict[str, str]], DataFrame]
    shows: tuple[str, ...] = ()
    capped: bool = True
    by_degree: bool = False

    def rows(self, whole: DataFrame) -> DataFrame:
        order = [F.desc("degree"), F.col("seq").asc_nulls_last(), "id"] if self.by_degree else None
        out = R.capped(whole, order) if self.capped else whole
        return out.select(*self.shows) if self.shows else out


RULES: dict[str, Rule] = {
    "help": Rule(lambda g, q: g.spark.createDataFrame([(x,) for x in HELP], "form string"), capped=False),
    "path": Rule(_path, capped=False),
    "predecessors": Rule(lambda g, q: R.predecessors(g, vertex(g, q["a"])), _EDGE),
    "successors": Rule(lambda g, q: R.successors(g, vertex(g, q["a"])), _EDGE),
    "neighbors": Rule(lambda g, q: R.neighbors(g, vertex(g, q["a"])), ("id", "direction", "grp")),
    "ego": Rule(lambda g, q: P.ego(g, vertex(g, q["a"]), int(q.get("n", 2))).v.select("id", R.shown_group().alias("grp"), "seq"), ("id", "grp")),
    "degree": Rule(lambda g, q: R.degree_filter(g, q["op"], int(q["n"])), ("id", "degree", "grp"), by_degree=True),
    "top_degree": Rule(lambda g, q: R.top_degree(g, int(q["n"])), ("id", "degree", "grp"), capped=False),
    "top_betweenness": Rule(lambda g, q: P.top_betweenness(g, int(q["n"])), capped=False),
    "count_between": Rule(lambda g, q: _between(g, q).agg(F.count(F.lit(1)).alias("n")), capped=False),
    "edges_between": Rule(_between, _EDGE),
    "edges_label": Rule(lambda g, q: R.edges_with_label(g, q["text"]), _EDGE),
    "confidence": Rule(lambda g, q: R.confidence_filter(g, q["op"], _number(q["n"])), ("id", "confidence", "grp")),
    "count": Rule(lambda g, q: R.count_group(g, q["group"]), capped=False),
    "isolated": Rule(lambda g, q: R.isolated(g), ("id", "grp")),
    "hubs": Rule(lambda g, q: R.hubs(g, int(q.get("n", 3))), ("id", "degree", "grp"), by_degree=True),
    "find_that": Rule(lambda g, q: R.find_nodes_that(g, q["group"], q["verb"], vertex(g, q["a"])), ("id", "grp", "confidence")),
    "find": Rule(lambda g, q: R.find_nodes(g, q["group"]), ("id", "grp", "confidence")),
}


def run(g: Graph, text: str) -> DataFrame:
    q = parse(text)
    rule = RULES[q.kind]
    return rule.rows(rule.plan(g, q.params))


@dataclass
class Answer:
    """rows: at most the cap. count: all that match. truncated: whether rows lack some of them."""

    kind: str
    rows: list
    count: int
    truncated: bool
    error: str | None = None


def answer(g: Graph, text: str) -> Answer:
    """A query's rows on the driver, at most the cap, and how many match; errors of the query are told, not raised."""
    try:
        q = parse(text)
        rule = RULES[q.kind]
        whole = rule.plan(g, q.params)
        rows = rule.rows(whole).take(RESULT_CAP)
    except QueryError as e:
        return Answer("error", [], 0, False, str(e))
    count = whole.count() if len(rows) == RESULT_CAP else len(rows)
    return Answer(q.kind, rows, count, count > len(rows))


def auto_queries(g: Graph, cycle: int) -> list[str]:
    """Three to five follow-up queries from the graph's state; the kind asked for turns with the cycle."""
    from weftgraph.operators.analytics import country_tension

    top = R.top_degree(g, 2).collect()
    if not top:
        return ["find countries", "find organizations", "find persons"]
    out = [f"neighbors of {top[0].id}", f"path from {top[0].id} to {top[1].id}" if len(top) > 1 else "find countries"]
    out.append("find " + ("countries", "persons", "organizations", "events", "technologies")[cycle % 5])
    out.append("hub nodes" if cycle % 3 == 0 else "top 5 nodes by degree")
    hottest = country_tension(g).orderBy(F.desc("score"), "id").first()
    if hottest:
        out.append(f"neighbors of {hottest.id}")
    return out[:5]
