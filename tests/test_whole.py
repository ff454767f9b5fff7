"""Registered queries that do the whole job, on small inputs."""

import json
import random
import re
from difflib import SequenceMatcher

import pytest

from tests.test_graph import brute_betweenness, g
from weftgraph import fixtures, queries
from weftgraph.operators import matching

EDGES = [("S1", "N1", "based in"), ("S2", "N2", "based in"), ("N1", "N2", "threatens"), ("N2", "N3", "monitors"), ("N3", "N1", "cooperates with"), ("N1", "R1", "member of"), ("N3", "R1", "member of"), ("NATION_6", "N1", "monitors")]
VERTICES = [*((n, "country") for n in ("N1", "N2", "N3", "NATION_6")), ("S1", "organization"), ("S2", "organization"), ("R1", "organization"), ("P1", "person")]


@pytest.fixture()
def small(spark, monkeypatch):
    graph = g(spark, EDGES, VERTICES)
    monkeypatch.setattr(fixtures, "build", lambda *_: graph)
    return lambda name: queries.QUERIES[name](spark, "").collect()


def test_betweenness_queries_take_the_whole_graph(small):
    ids = [v for v, _ in VERTICES]
    want = brute_betweenness([e[:2] for e in EDGES], ids)
    assert {r.id: r.betweenness for r in small("top_betweenness")} == pytest.approx(want, abs=1e-4)
    ends = [x for e in EDGES for x in e[:2]]
    influence = {v: 0.5 * ends.count(v) / (len(ids) - 1) + 0.5 * want[v] for v in ids}
    assert {r.id: r.influence for r in small("influence_rank")} == pytest.approx(influence, abs=1e-4)
    weight = {"threatens": 3.0, "cooperates with": -1.0}
    score = {v: sum(weight.get(x, 0.5) * ((a == v) + 0.6 * (b == v)) for a, b, x in EDGES) + want[v] / max(want.values()) * 15 for v in set(ends)}
    assert {r.id: r.score for r in small("hotspots")} == pytest.approx(score, abs=1e-4)
    risk = {r.id: r.risk for r in small("entity_risk")}
    assert set(risk) == set(ids) and risk["P1"] == 0.0
    (s,) = small("stability")
    assert s.risk == pytest.approx(sum(risk.values()) / len(ids) * 0.6 + 100 / len(EDGES) * 0.4, abs=0.06)


def test_features_and_embeddings_take_the_whole_graph(small):
    assert {"S1", "S2"} <= {r.id for r in small("structural_similarity")}
    assert {r.id: len(r.vector) for r in small("node_embeddings")} == {v: 64 for v, _ in VERTICES if v != "P1"}


def plain_parse(answer):
    """The text of the one item by a plain parser, or None where the answer is faulty."""
    raw = re.sub(r"```(?:json)?", "", answer, count=1).rsplit("```", 1)[0]
    depth, start = 0, raw.find("{")
    for i, c in enumerate(raw[start:], start):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            try:
                return json.loads(raw[start : i + 1])["extractions"][0]["extraction_text"].strip()
            except ValueError:
                return None
    return None


def test_extract_validate_reads_whole_turns(spark, tmp_path):
    texts = ["word " * 400 + "end", "twenty characters or more {braced} and more", 'says "yes" after\na line\tand \\ more', "an open { brace after twenty", "a closing } brace after twenty", "some text\n```json\nand more```\n```", "ends } and { begins", "short", "naïve – ünïcode text that goes on 🙂 and on"]
    spark.createDataFrame([(3 * i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.text, r.parse_error is None) for r in queries.QUERIES["extract_validate"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        item = {"extraction_class": "country", "extraction_text": t, "attributes": {"source": "a"}, "confidence": "0.9"}
        text = plain_parse("Here:\n```json\n" + json.dumps({"extractions": [item]}) + "\n```")
        want[3 * i] = (text, text is not None)
    assert got == want and len(got[0][0]) > 2000


def test_name_queries_take_all_names(spark, small):
    ids = [v for v, _ in VERTICES]
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    got = {r.name: r.id for r in small("fuzzy_resolve")}
    want = {}
    for name in [x for i in ids for x in (i.lower(), i.lower() + "x")]:
        best = max(ids, key=lambda i: (ratio(i, name), -ids.index(i)))
        want[name] = best if ratio(best, name) >= 0.82 else None
    assert got == want


def test_similar_pairs_by_brute_force(spark, monkeypatch):
    r = random.Random(6)
    ids = sorted({"".join(r.choice("abA1") for _ in range(r.randrange(1, 9))) for _ in range(120)} | {f"Customer#{i:05}" for i in range(40)})
    monkeypatch.setattr(matching, "TALL", 30)
    monkeypatch.setattr(matching, "WIDE", 50)
    monkeypatch.setattr(fixtures, "build", lambda *_: g(spark, [], [(i, "person") for i in ids]))
    got = {(x.a, x.b): x.score for x in queries.QUERIES["similar_names"](spark, "").collect()}
    want = {(a, b): SequenceMatcher(None, a.lower(), b.lower()).ratio() for a in ids for b in ids if a < b}
    assert got == pytest.approx({k: s for k, s in want.items() if s > 0.8}, abs=5.1e-5)


def test_html_text_is_whole(spark, tmp_path):
    long = "word " * 12_000 + "end"
    spark.createDataFrame([(1, "u", f"<body><p>{long}</p></body>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (r,) = queries.QUERIES["html_text"](spark, str(tmp_path)).collect()
    assert r.text == long
