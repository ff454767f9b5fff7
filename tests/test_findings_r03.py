"""What the findings of round 3 are about, on small inputs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.test_graph import brute_betweenness, g
from weftgraph import fixtures, live_queries, queries
from weftgraph.operators import matching, mutate, vectors
from weftgraph.operators import paths as P
from weftgraph.sources import pdf, sinks, web


def _stars(seed: int) -> tuple[list[tuple], list[str]]:
    """A random core, and many vertices that only lead to one or two of it."""
    r = random.Random(seed)
    core = [f"N{i}" for i in range(6)]
    edges = {(a, b) for a in core for b in core if a != b and r.random() < 0.35}
    edges |= {(f"S{i:02}", core[i % 3]) for i in range(24)} | {(f"S{i:02}", core[3]) for i in range(0, 24, 2)}
    return sorted(edges), [*core, *(f"S{i:02}" for i in range(24)), "alone"]


def test_sources_that_share_their_paths_are_searched_once(spark, monkeypatch):
    edges, ids = _stars(3)
    graph = g(spark, [(*e, "l") for e in edges], [(v, "x") for v in ids])
    asked, own = [], P._dependencies
    monkeypatch.setattr(P, "_dependencies", lambda steps, sources: asked.append(sources.count()) or own(steps, sources))
    assert {r.id: r.betweenness for r in P.betweenness(graph).collect()} == pytest.approx(brute_betweenness(edges, ids), abs=1e-12)
    assert sum(asked) <= 6 + 6  # the core, and a set of steps out each
    asked.clear()
    rest, without = [e for e in edges if "N0" not in e], [v for v in ids if v != "N0"]
    got = {r.id: r.after for r in P.centrality_shift(graph, "N0").collect()}
    assert got == pytest.approx(brute_betweenness(rest, without), abs=1e-12)
    assert sum(asked) <= 3 * 12


def test_vertices_reached_are_counted_for_every_source(spark):
    edges, ids = _stars(5)
    graph = g(spark, [(*e, "l") for e in edges], [(v, "x") for v in ids])
    every = {r.s: r.n for r in P.descendants(graph).groupBy("s").agg(F.count("*").alias("n")).collect()}
    between = P.betweenness(graph)
    got = {r.id: r.features[4] for r in P.structural_features(graph, between).collect()}
    assert got == pytest.approx({v: every.get(v, 0) / len(ids) for v in ids})


def test_removal_tells_every_orphan(spark):
    graph = g(spark, [("A", "X", "l"), ("X", "B", "l"), ("C", "X", "l"), ("C", "D", "l")], [(v, "x") for v in "ABCDX"])
    row = P.node_removal(graph, "X").first()
    assert (row.orphans, row.orphan_ids, row.fragments) == (2, "A,B", True)
    assert P.node_removal(graph, "D").first().orphan_ids is None


def test_url_of_two_feeds_keeps_the_reason_why_it_was_skipped(spark):
    rows = [("first", "u", "skipped", "Text too short"), ("first", "u", "skipped", None), ("first", "v", "ok", None), ("first", "v", "skipped", None), ("first", "w", "error", "Fetch: HTTP 404"), ("first", "w", "skipped", None), ("second", "v", "skipped", None)]
    got = live_queries._per_url(spark.createDataFrame(rows, "poll string, url string, status string, error string")).select("poll", "url", "x.status", "x.error").collect()
    assert sorted(map(tuple, got)) == [("first", "u", "skipped", "Text too short"), ("first", "v", "ok", None), ("first", "w", "error", "Fetch: HTTP 404"), ("second", "v", "skipped", None)]


def test_names_one_character_off_are_joined_not_compared_with_all(spark, monkeypatch):
    r = random.Random(7)
    ids = sorted({"".join(r.choice("abcX") for _ in range(r.randint(1, 9))) for _ in range(90)} | {"Customer#000000001", "Customer#000000012", "bcabcd", "abcabc" * 40})
    names = {"".join(r.choice("abcx") for _ in range(r.randint(0, 9))) for _ in range(60)} | {i.lower() + "x" for i in ids} | {i[1:] for i in ids} | {"abcabcd", "customer#00000012"}
    v = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, seq long")
    compared, own = [], mutate.alike
    monkeypatch.setattr(mutate, "alike", lambda names, *a, **k: compared.extend(x.name for x in names.collect()) or own(names, *a, **k))
    got = {x.name: x.id for x in mutate.resolve(spark.createDataFrame([(x,) for x in names], "name string"), v).collect()}
    lower = {x.lower() for x in ids}
    assert not {i.lower() + "x" for i in ids if len(i) > 4} & set(compared)
    for name in names:
        if name.lower() in lower:
            continue
        ratio, _, best = max((SequenceMatcher(None, x.lower(), name.lower()).ratio(), -i, x) for i, x in enumerate(ids))
        assert got[name] == (best if ratio >= 0.82 else None), name


def test_briefs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(sinks, "_FILES", 5)
    ids = [f"v{i:02}" for i in range(40)]
    graph = g(spark, [(a, b, "→ l") for a, b in zip(ids, ids[1:])], [(v, "x") for v in ids])
    files = sinks.pdf_briefs(graph, graph.v)
    assert files.rdd.getNumPartitions() == 8
    texts = {r.id: r.text for r in sinks.pdf_text(files).collect()}
    assert texts.keys() == set(ids) and "v00 → → l → v01" in texts["v00"]


def test_map_of_codes_is_read_once_for_all_files():
    pdf._told_again.cache_clear()
    texts = [pdf.read(pdf.write([f"{i} → é"], "t")) for i in range(5)]
    assert texts == [f"{i} → é" for i in range(5)] and pdf._told_again.cache_info().misses == 1


def test_archives_are_read_by_small_blocks(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(web, "BLOCK", 1 << 20)
    pages = spark.range(600).select(F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit(200).alias("status"), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.sha2(F.concat("id", F.lit(":"), i), 256))).alias("body"))
    web.archive(pages.coalesce(1), str(tmp_path / "a"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "a").glob("*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)) < 3 << 20
    got = dict(web.Folder(str(tmp_path / "a")).get(["https://a.example/7", "https://a.example/x", "https://a.example/599"]))
    assert [a.status for a in got.values()] == [200, 404, 200] and len(got["https://a.example/7"].body) == 150 * 64


def test_feeds_and_articles_of_a_task_are_fetched_together(spark, tmp_path, monkeypatch):
    import json

    from weftgraph.streaming import feeds

    urls = [f"https://f.example/{i}" for i in range(30)]
    rss = "<rss><channel><item><title>t</title><link>https://a.example/1</link></item></channel></rss>"
    web.archive(spark.createDataFrame([(u, 200, rss) for u in urls], "url string, status int, body string"), str(tmp_path / "a"))
    stream = web.FeedStream({"folder": str(tmp_path / "a"), "snapshots": str(tmp_path / "s"), "group": "10", "feeds": json.dumps([[u, u] for u in [*urls, "https://f.example/x"]])})
    asked, own = [], web.Folder.get
    monkeypatch.setattr(web.Folder, "get", lambda self, group: asked.append(group) or own(self, group))
    rows = [r for part in stream.partitions({"poll": 0}, {"poll": 1}) for r in stream.read(part)]
    assert sorted(r[0] for r in rows) == sorted([*urls, "https://f.example/x"]) and [r[-1] for r in rows if r[-1]] == ["HTTP 404"]
    assert [len(x) for x in asked] == [10, 10, 10, 1]
    again = [r for part in stream.partitions({"poll": 0}, {"poll": 1}) for r in stream.read(part)]
    assert again == rows and len(asked) == 4
    monkeypatch.setattr(feeds, "FETCHES", 1)
    monkeypatch.setattr(feeds, "GROUP", 5)
    got = feeds.fetch_articles(spark.createDataFrame([(u,) for u in urls], "url string"), {"folder": str(tmp_path / "a")})
    assert got.rdd.getNumPartitions() == 6 and {r.url for r in got.collect() if r.html == rss} == set(urls)


def test_names_of_a_block_are_matched_by_tables(monkeypatch):
    """Pairs of numbered names by what stands in the places that differ: few pairs are matched, none is lost, the ratio is the matcher's."""
    r = random.Random(9)
    ids = [f"Customer#{r.randrange(100_000):09}" for _ in range(300)] + [f"Supplier#{i:09}" for i in range(40)]
    ids += ["".join(r.choice("abAé1") for _ in range(r.randrange(0, 9))) for _ in range(80)] + ["x" * 70, "x" * 69 + "y", "\U0001f600" * 20, "", "ab" * 9, "ba" * 9]
    names = ids[::3] + ["Customer#1", "#customer000012345"]
    asked, own = [], matching.matched
    monkeypatch.setattr(matching, "matched", lambda *x: asked.append(len(x[0])) or own(*x))
    matching._Alike.tables.clear()
    for table in (matching.TABLE, 0):  # with tables, and without
        monkeypatch.setattr(matching, "TABLE", table)
        i, j, score = matching._pairs(matching.Names(names), matching.Names(ids), None, 0.7)
        want = {(p, q): matching.similarity(ids[q], names[p]) for p in range(len(names)) for q in range(len(ids))}
        assert dict(zip(zip(i.tolist(), j.tolist()), score.tolist())) == {k: s for k, s in want.items() if s >= 0.7}
        asked.append(0)
    block = [f"Customer#{i:09}" for i in range(20_000, 21_000)]
    monkeypatch.undo()
    monkeypatch.setattr(matching, "matched", lambda *x: asked.append(len(x[0])) or own(*x))
    asked.clear()
    i, _, _ = matching._pairs(matching.Names(block[::2]), matching.Names(block), None, 0.8)
    assert len(i) == 500 * 1000 and sum(asked) < 20_000


@pytest.mark.parametrize("upper", [False, True])
def test_ordered_blocks_meet_only_ids_before_the_name(spark, monkeypatch, upper):
    monkeypatch.setattr(matching, "TALL", 20)
    monkeypatch.setattr(matching, "WIDE", 30)
    r = random.Random(5)
    ids = sorted({(str.upper if upper and r.random() < 0.5 else str)("".join(r.choice("abc") for _ in range(r.randrange(4, 9)))) for _ in range(150)} | {f"Customer#{i:05}" for i in range(90)})
    vertices = spark.createDataFrame([(x,) for x in ids], "id string")
    got = {(x.a, x.b): x.score for x in mutate.similar_pairs(vertices).collect()}
    ratio = {(a, b): matching.similarity(a, b) for n, b in enumerate(ids) for a in ids[:n]}
    assert got == {k: s for k, s in ratio.items() if s > 0.8}


def test_scores_are_rounded_as_by_spark(spark):
    ratios = spark.createDataFrame(sorted({(2.0 * t / s,) for s in range(1, 400) for t in range(s // 2 + 1)}), "score double")
    ids = ratios.select(F.concat(F.lit("a"), F.col("score").cast("string")).alias("a"), F.lit("b").alias("b"), "score")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mutate, "similar_pairs", lambda *_: ids)
        patch.setattr(fixtures, "build", lambda *_: g(spark, [], [("a", "person")]))
        got = {r.a: r.score for r in queries.QUERIES["similar_names"](spark, "").collect()}
    assert got == {r.a: r.r for r in ids.select("a", F.round("score", 4).alias("r")).collect()}


def test_walks_fill_several_tasks(spark):
    ring = [f"n{i:03}" for i in range(300)]
    graph = g(spark, [(a, b, "l") for a, b in zip(ring, ring[1:] + ring[:1])], [(v, "x") for v in ring])
    got = vectors.walks(graph, 50, 3).select("path", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 15_000 and len({r.task for r in got}) > 3
    assert all(abs(int(a[1:]) - int(b[1:])) in (1, 299) for r in got for a, b in zip(r.path, r.path[1:]))


@pytest.mark.parametrize("positions", [1, 40, 1 << 20])
def test_meetings_of_numbered_walks_by_a_plain_loop(spark, monkeypatch, positions):
    """Each task counts before anything is dealt: a pair once for the walks held at once, in whatever pieces they come."""
    monkeypatch.setattr(vectors, "POSITIONS", positions)
    r = random.Random(8)
    walks = [[r.randrange(-3, 4) for _ in range(r.randrange(0, 12))] for _ in range(60)]
    got = {(x.x, x.y): x.n for x in vectors.co_visits(spark.createDataFrame([(w,) for w in walks], "path array<int>"), 4).collect()}
    want: dict = {}
    for w in walks:
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 5]:
                if a != b:
                    want[a, b], want[b, a] = (want.get(k, 0) + 1 for k in ((a, b), (b, a)))
    assert got == want
