"""Iterative graph algorithms: searches level by level, components, betweenness.

Each round is written to the shared folder, so lineage stays short and a lost executor repeats one round. Rounds stop when
a frontier is empty. Joins leave the choice of strategy to the optimizer, which sees the written tables' sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import components
from weftgraph.operators.relational import shown_group
from weftgraph.stage import stage


def arcs(g: Graph, directed: bool = True) -> DataFrame:
    """x, y for each step: along edges, or along and against them."""
    out = g.e.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return out if directed else out.unionByName(g.e.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()


class _Side:
    """One end of a search: vertices reached, and what was reached last."""

    def __init__(self, steps: DataFrame, start: str, name: str) -> None:
        self.steps, self.name, self.level = steps, name, 0
        self.front = steps.sparkSession.createDataFrame([(start, 0)], "id string, d int")
        self.seen, self.size = [self.front], 1

    def reached(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.seen)

    def forward(self, steps: DataFrame) -> DataFrame:
        """x, y of the steps from one level to the next."""
        levels = self.reached()
        near, far = levels.select(F.col("id").alias("x"), "d"), levels.select(F.col("id").alias("y"), (F.col("d") - 1).alias("d"))
        return steps.select("x", "y").join(near, "x").join(far, ["y", "d"]).select("x", "y")

    def grow(self) -> int:
        """One level further; how many vertices that adds."""
        self.level += 1
        step = self.front.join(self.steps, self.front["id"] == self.steps["x"]).select(F.col("y").alias("id")).distinct()
        step = step.join(self.reached().select("id"), "id", "left_anti").withColumn("d", F.lit(self.level))
        self.front = stage(step, f"path-{self.name}-{self.level}")
        self.size = self.front.count()
        self.seen.append(self.front)
        if len(self.seen) > 8:  # a plan of bounded size, however long the path
            self.seen = [stage(self.reached(), f"path-{self.name}-seen-{self.level}")]
        return self.size


def _search(steps: DataFrame, source: str, target: str) -> list[str] | None:
    """The smallest, as text, of the shortest paths, from both ends: the smaller front grows, until the two meet.

    Then the path is read from the source on: of the next vertices that are on a shortest path, the smallest.
    """
    if source == target:
        return [source]
    back_steps = steps.select(F.col("y").alias("x"), F.col("x").alias("y"))
    ahead, back = _Side(steps, source, "ahead"), _Side(back_steps, target, "back")
    while True:
        side, other = (ahead, back) if ahead.size <= back.size else (back, ahead)
        if not side.grow():
            return None
        # a path as long as both levels meets in the front that just grew
        meets = side.front.select("id").join(other.front.select("id"), "id")
        if not meets.isEmpty():
            break
    following = stage(ahead.forward(steps).unionByName(back.forward(back_steps).select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "path-following")
    few = following.limit(FOLLOWING + 1).collect()
    if len(few) <= FOLLOWING:
        return _read([(r.x, r.y) for r in few], source, target)
    return _read_far(steps, back_steps, ahead, back, meets, source)


#: Steps of the searched levels that are read on the driver; with more of them the path is read level by level.
FOLLOWING = 100_000


def _read(edges: list[tuple[str, str]], source: str, target: str) -> list[str]:
    """The smallest of the shortest paths over a few edges that have them all."""
    into: dict[str, list[str]] = {}
    out: dict[str, list[str]] = {}
    for x, y in edges:
        into.setdefault(y, []).append(x)
        out.setdefault(x, []).append(y)
    togo, front = {target: 0}, [target]
    while front and source not in togo:
        front = list({x for y in front for x in into.get(y, ()) if x not in togo})
        togo.update(dict.fromkeys(front, max(togo.values()) + 1))
    path = [source]
    while path[-1] != target:
        path.append(min(y for y in out[path[-1]] if togo.get(y) == togo[path[-1]] - 1))
    return path


def _read_far(steps: DataFrame, back_steps: DataFrame, ahead: _Side, back: _Side, meets: DataFrame, source: str) -> list[str]:
    """The smallest of the shortest paths, by the distances to the target of the vertices on them, step by step from the source."""
    left = back.reached().join(_towards(back, meets), ["id", "d"])
    right = left.select("id", F.col("d").alias("togo"))
    here = meets.select("id").withColumn("togo", F.lit(back.level))
    for level in range(ahead.level - 1, -1, -1):
        up = here.join(back_steps, here["id"] == back_steps["x"]).select(F.col("y").alias("id")).distinct()
        up = up.join(ahead.reached().filter(F.col("d") == level).select("id"), "id")
        here = stage(up.withColumn("togo", F.lit(back.level + ahead.level - level)), f"path-up-{level}")
        right = right.unionByName(here)
    right = stage(right.distinct(), "path-togo")
    path, at = [source], source
    for togo in range(ahead.level + back.level - 1, -1, -1):
        following = steps.filter(F.col("x") == at).select(F.col("y").alias("id")).join(right.filter(F.col("togo") == togo), "id")
        at = following.agg(F.min("id")).first()[0]
        path.append(at)
    return path


def _towards(back: _Side, meets: DataFrame) -> DataFrame:
    """id, d of what lies on shortest paths from the meeting to the target."""
    front, found = meets.select("id"), []
    forth = back.steps.select(F.col("y").alias("x"), F.col("x").alias("y"))
    for d in range(back.level, -1, -1):
        found.append(front.withColumn("d", F.lit(d)))
        if d:
            step = front.join(forth, front["id"] == forth["x"]).select(F.col("y").alias("id")).distinct()
            front = stage(step.join(back.reached().filter(F.col("d") == d - 1).select("id"), "id"), f"path-down-{d}")
    return reduce(DataFrame.unionByName, found)


def shortest_path(g: Graph, source: str, target: str, default_label: str = "connects to") -> DataFrame:
    """position, src, dst, label, reversed, directed for each step of a shortest path; empty where there is none.

    Edges are followed along their direction; only if that fails, in both directions, and a step against an edge is
    reversed. Of shortest paths the one with the smallest ids is taken. The search ends where no
    new vertex is reached, so a path of any length is found.
    """
    spark = g.spark
    e = stage(g.e.select("src", "dst", F.coalesce("label", F.lit(default_label)).alias("label")), "path-edges")
    both = g.v.filter(F.col("id").isin(source, target)).select("id").distinct().count()
    path, directed = None, True
    if both == len({source, target}):
        forth, back = e.select(F.col("src").alias("x"), F.col("dst").alias("y")), e.select(F.col("dst").alias("x"), F.col("src").alias("y"))
        path = _search(forth, source, target)
        if path is None:
            directed, path = False, _search(forth.unionByName(back), source, target)
    schema = "position int, src string, dst string, directed boolean"
    steps = spark.createDataFrame([(i, a, b, directed) for i, (a, b) in enumerate(zip(path or [], (path or [])[1:]))], schema)
    forth = steps.join(F.broadcast(steps.select("src", "dst").distinct()).join(e, ["src", "dst"]), ["src", "dst"], "left")  # steps: the rows of one path
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("label").alias("back"))
    return forth.join(back, ["src", "dst"], "left").select("position", "src", "dst", F.coalesce("label", "back").alias("label"), (F.col("label").isNull() & F.col("back").isNotNull()).alias("reversed"), "directed")


def path_summary(steps: DataFrame, source: str, target: str) -> DataFrame:
    """path (ids joined by `>`), length, directed, narrative: one row, or none where there is no path."""
    step = F.struct("position", "src", "dst", "label", "reversed")
    one = steps.groupBy().agg(F.array_sort(F.collect_list(step)).alias("s"), F.max("directed").alias("directed")).filter(F.size("s") > 0)
    ids = F.concat(F.array(F.col("s")[0]["src"]), F.transform("s", lambda x: x["dst"]))
    told = F.concat(F.col("s")[0]["src"], F.concat_ws("", F.transform("s", lambda x: F.concat(F.lit(" → ["), x["label"], F.lit("] → "), x["dst"]))))
    hops = F.concat(F.lit("  ("), F.size("s").cast("string"), F.lit(" hops, "), F.when(F.col("directed"), "directed").otherwise("undirected"), F.lit(")"))
    return one.select(F.concat_ws(">", ids).alias("path"), F.size("s").cast("bigint").alias("length"), "directed", F.concat(told, hops).alias("narrative"))


def all_simple_paths(g: Graph, source: str, target: str, hops: int = 4, most: int = 10) -> DataFrame:
    """path (ids joined by `>`), length: the shortest simple paths along edges, ties by text."""
    steps = stage(arcs(g).filter("x <> y"), "paths-arcs")
    front = g.spark.createDataFrame([(source, [source])], "id string, path array<string>")
    found = None
    for level in range(hops):
        front = front.join(steps, front["id"] == steps["x"]).filter(~F.array_contains("path", F.col("y"))).select(F.col("y").alias("id"), F.concat("path", F.array("y")).alias("path"))
        front = stage(front, f"paths-{level}")
        ended = front.filter(F.col("id") == target)
        found = ended if found is None else found.unionByName(ended)
        front = front.filter(F.col("id") != target)
        # no more than `most` are told, and longer ones come after shorter ones
        if front.isEmpty() or found.limit(most).count() >= most:
            break
    text = F.concat_ws(">", "path")
    return found.select(text.alias("path"), (F.size("path") - 1).cast("bigint").alias("length")).orderBy("length", "path").limit(most)


def ego(g: Graph, node: str, hops: int = 2) -> Graph:
    """The subgraph within `hops` (1 to 4) steps of node, direction ignored; the whole graph where node is missing."""
    if g.v.filter(F.col("id") == node).isEmpty():
        return g
    return g.induced(reach(g, g.spark.createDataFrame([(node,)], "id string"), max(1, min(4, hops))))


def reach(g: Graph, seeds: DataFrame, hops: int) -> DataFrame:
    """The ids within `hops` steps of seeds, direction ignored."""
    steps = stage(arcs(g, directed=False), "reach-arcs")
    seen = front = stage(seeds.select("id").distinct(), "reach-seeds")
    for level in range(hops):
        step = front.join(steps, front["id"] == steps["x"]).select(F.col("y").alias("id")).distinct()
        front = stage(step.join(seen, "id", "left_anti"), f"reach-{level}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def context_edges(g: Graph, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """The edges with an end within `hops` steps of seeds."""
    near = stage(reach(g, seeds, hops), "context-ids")
    return g.e.join(near.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(near.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left").filter("a or b").select(g.e.columns)


def wcc(g: Graph) -> DataFrame:
    """id, component: the smallest id of its weakly connected component."""
    found = components(g.e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.v.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def wcc_count(g: Graph) -> DataFrame:
    """components: vertices less the ones that hang on another one's component."""
    found = components(g.e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    hang = found.filter("id <> root").agg(F.count(F.lit(1)).alias("hang"))
    return g.v.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(hang)).select((F.col("n") - F.col("hang")).alias("components"))


#: Sources whose searches run together.
SOURCES = 4096


def _sets(steps: DataFrame) -> DataFrame:
    """s, stands: for each vertex with steps out one that has the same shortest paths, ends excluded.

    Vertices that nothing leads to and whose steps lead to the same vertices have them, and the smallest stands for all; every other
    one stands for itself. Sets of vertices are compared by their sizes, ends, and 128 bits of hashes.
    """
    own = steps.select(F.col("x").alias("s"), "y").distinct()
    set_ = [F.count(F.lit(1)), F.min("y"), F.max("y"), F.bit_xor(F.xxhash64("y")), F.bit_xor(F.xxhash64("y", F.lit(1)))]
    led = own.select(F.col("y").alias("s"), F.lit(True).alias("led")).distinct()
    sets = own.groupBy("s").agg(*(c.alias(f"k{i}") for i, c in enumerate(set_))).join(led, "s", "left")
    sets = stage(sets.withColumn("own", F.when(F.col("led"), F.col("s")).otherwise("")).withColumn("led", F.coalesce("led", F.lit(False))), "source-sets")
    keys = [c for c in sets.columns if c != "s"]
    return stage(sets.join(sets.groupBy(keys).agg(F.min("s").alias("stands")), keys).select("s", "stands"), "source-stands")


def dependencies(steps: DataFrame, sources: DataFrame, most: int = SOURCES) -> DataFrame:
    """id, share: how much of the shortest paths from sources (s) to all vertices goes through a vertex, ends excluded.

    Breadth-first search counts shortest paths level by level; then shares are summed from the last level back. One search does for
    all sources that share their paths, and counts as often. Levels hold a row for each source and vertex reached, so sources run at
    most about `most` at a time, and each batch adds to one sum.
    """
    sources = stage(sources.join(_sets(steps), "s").groupBy(F.col("stands").alias("s")).agg(F.count(F.lit(1)).alias("times")), "bc-sources")
    batches = max(1, -(-sources.count() // most))
    total = None
    for batch in range(batches):
        own = sources.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == batch)
        got = _dependencies(steps, own)
        if got is not None:
            total = got if total is None else stage(total.unionByName(got).groupBy("id").agg(F.sum("share").alias("share")), "bc-sums")
    return steps.sparkSession.createDataFrame([], "id string, share double") if total is None else total


def _dependencies(steps: DataFrame, sources: DataFrame) -> DataFrame | None:
    levels = [stage(sources.select("s", F.col("s").alias("id"), F.lit(1.0).alias("paths")), "bc-0")]
    seen = levels[0].select("s", "id")
    while True:
        nxt = levels[-1].join(steps, F.col("id") == F.col("x")).groupBy("s", "y").agg(F.sum("paths").alias("paths")).withColumnRenamed("y", "id")
        nxt = stage(nxt.join(seen, ["s", "id"], "left_anti"), f"bc-{len(levels)}")
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "id"))
    total, below = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k]
        if below is None:
            share = here.select("s", "id", "paths", F.lit(0.0).alias("share"))
        else:
            up = below.join(steps, F.col("id") == F.col("y")).select("s", F.col("x").alias("id"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            share = here.join(up.groupBy("s", "id").agg(F.sum("part").alias("part")), ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share"))
        below = stage(share, f"bc-share-{k}")
        total = below.select("s", "id", "share") if total is None else total.unionByName(below.select("s", "id", "share"))
    return None if total is None else stage(total.join(sources, "s").groupBy("id").agg(F.sum(F.col("share") * F.col("times")).alias("share")), "bc-total")


def _scale(n: int) -> float:
    return 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0


def _steps(g: Graph, name: str) -> DataFrame:
    return stage(arcs(g).filter("x <> y").distinct(), name)


def betweenness(g: Graph, most: int = SOURCES) -> DataFrame:
    """id, betweenness of every vertex: directed, unweighted, ends excluded, divided by (n - 1)(n - 2); 0 for n < 3."""
    steps = _steps(g, "bc-arcs")
    total = dependencies(steps, steps.select(F.col("x").alias("s")).distinct(), most)  # vertices without edges out are sources of nothing
    return g.v.select("id").join(total, "id", "left").select("id", (F.coalesce("share", F.lit(0.0)) * _scale(g.v.count())).alias("betweenness"))


def top_betweenness(g: Graph, k: int, between: DataFrame | None = None) -> DataFrame:
    """id, betweenness (4 places, ranked after rounding), grp; empty with fewer than 4 vertices."""
    b = betweenness(g) if between is None else between
    if len(g.v.limit(4).take(4)) < 4:
        b = b.limit(0)
    return b.join(g.v.select("id", shown_group().alias("grp")), "id").select("id", F.round("betweenness", 4).alias("betweenness"), "grp").orderBy(F.desc("betweenness"), "id").limit(max(1, k))


def without(g: Graph, node: str) -> Graph:
    return Graph(g.v.filter(F.col("id") != node), g.e.filter((F.col("src") != node) & (F.col("dst") != node)))


def orphaned(g: Graph, node: str) -> DataFrame:
    """id of vertices that have edges, but none without node."""
    from weftgraph.operators.relational import isolated

    return isolated(without(g, node)).select("id").join(isolated(g).select("id"), "id", "left_anti")


def node_removal(g: Graph, node: str) -> DataFrame:
    """What the removal of a vertex does: components before and after, and the vertices that are left without edges (ids joined by commas)."""
    before, after = wcc_count(g).select(F.col("components").alias("before")), wcc_count(without(g, node)).select(F.col("components").alias("after"))
    orphans = orphaned(g, node).agg(F.count(F.lit(1)).alias("orphans"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("orphan_ids"))
    row = before.join(F.broadcast(after)).join(F.broadcast(orphans))
    return row.select(F.lit(node).alias("removed"), "before", "after", (F.col("after") > F.col("before")).alias("fragments"), "orphans", F.when(F.col("orphans") > 0, F.col("orphan_ids")).alias("orphan_ids"))


def centrality_shift(g: Graph, node: str, between: DataFrame | None = None) -> DataFrame:
    """id, before, after, delta: betweenness of the other vertices with and without node.

    Only searches from vertices that reach node can change, so only these, and node's own, are made again, on both graphs; between
    is what betweenness(g) gives, if that is known.
    """
    n = g.v.count()
    steps = _steps(g, "shift-arcs")
    rest = stage(steps.filter((F.col("x") != node) & (F.col("y") != node)), "shift-rest")
    back = steps.select(F.col("y").alias("x"), F.col("x").alias("y"))
    front = seen = stage(g.spark.createDataFrame([(node,)], "s string"), "shift-0")
    level = 0
    while True:
        level += 1
        front = stage(front.join(back, front["s"] == back["x"]).select(F.col("y").alias("s")).distinct().join(seen, "s", "left_anti"), f"shift-{level}")
        if front.isEmpty():
            break
        seen = stage(seen.unionByName(front), f"shift-seen-{level}")
    old, new = dependencies(steps, seen), dependencies(rest, seen.filter(F.col("s") != node))
    whole = betweenness(g) if between is None else between
    change = old.select("id", (-F.col("share")).alias("d")).unionByName(new.select("id", F.col("share").alias("d"))).groupBy("id").agg(F.sum("d").alias("d"))
    before = F.col("betweenness")
    after = (before / (_scale(n) or 1.0) + F.coalesce("d", F.lit(0.0))) * _scale(n - 1)
    rows = whole.filter(F.col("id") != node).join(change, "id", "left")
    return rows.select("id", before.alias("before"), after.alias("after"), (after - before).alias("delta"))


def removal_effect(g: Graph, node: str, between: DataFrame | None = None, most: int = 10) -> DataFrame:
    """One row: removed, component_change, fragments, orphans, winners, losers (id and delta of betweenness; of the `most` that
    change most, those that gain and those that lose, five at most), tension_delta, tension_pct."""
    from weftgraph.operators.analytics import country_tension

    top = F.broadcast(centrality_shift(g, node, between).orderBy(F.desc(F.abs("delta")), "id").limit(most))
    pick = lambda c, ok: F.slice(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct((-F.abs("delta")).alias("k"), "id", "delta")))), lambda x: F.struct(x["id"].alias("id"), x["delta"].alias("delta"))), 1, 5).alias(c)
    moved = top.agg(pick("winners", F.col("delta") > 0), pick("losers", F.col("delta") < 0))
    tension = lambda graph, c: country_tension(graph).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias(c))
    row = node_removal(g, node).join(F.broadcast(moved)).join(F.broadcast(tension(g, "old"))).join(F.broadcast(tension(without(g, node), "new")))
    delta = F.col("new") - F.col("old")
    return row.select("removed", (F.col("after") - F.col("before")).alias("component_change"), "fragments", "orphans", "winners", "losers", delta.alias("tension_delta"), (delta / F.greatest("old", F.lit(1.0)) * 100).alias("tension_pct"))


def structural_features(g: Graph, between: DataFrame) -> DataFrame:
    """id, features: degree centrality, betweenness, hostile and cooperative shares of the degree, share of vertices reached."""
    from weftgraph import predicates
    from weftgraph.operators.analytics import degree_centrality
    from weftgraph.operators.relational import degree

    out = g.e.groupBy(F.col("src").alias("id")).agg(F.sum(predicates.hostile(F.col("label")).cast("int")).alias("h"), F.sum(predicates.cooperative(F.col("label")).cast("int")).alias("c"))
    n = g.v.count()
    steps = stage(arcs(g).filter("x <> y"), "features-arcs")
    sets = _sets(steps)  # vertices that share their paths out reach as many
    reached = _reached(steps, sets.select(F.col("stands").alias("s")).distinct()).groupBy(F.col("s").alias("stands")).agg(F.count(F.lit(1)).alias("reached"))
    reached = sets.join(reached, "stands").select(F.col("s").alias("id"), "reached")
    rows = degree_centrality(g).select("id", "centrality").join(degree(g).select("id", "degree"), "id").join(between, "id", "left").join(out, "id", "left").join(reached, "id", "left")
    total = F.greatest("degree", F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return rows.select("id", F.array("centrality", zero("betweenness"), zero("h") / total, zero("c") / total, zero("reached") / max(n, 1)).alias("features"))


def descendants(g: Graph) -> DataFrame:
    """s, id: every vertex that can be reached from s along edges, s excluded."""
    return _reached(stage(arcs(g).filter("x <> y"), "desc-arcs"))


def _reached(steps: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    own = steps.select(F.col("x").alias("s"), F.col("y").alias("id"))
    seen = front = stage((own if sources is None else own.join(sources, "s")).distinct(), "desc-1")
    level = 1
    while True:
        level += 1
        step = front.join(steps, F.col("id") == F.col("x")).select("s", F.col("y").alias("id")).filter("s <> id").distinct()
        front = stage(step.join(seen, ["s", "id"], "left_anti"), f"desc-{level}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
