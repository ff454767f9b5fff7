import json

from weftgraph.functions import scenario as S
from weftgraph.graph import Graph
from weftgraph.operators import analytics as A
from weftgraph.operators.paths import betweenness
from weftgraph.sources.fetch import fetch


def graph(spark):
    return Graph.literal(spark, [(x, "country") for x in "ABCD"], [("A", "B", "attacks"), ("B", "A", "sanctions"), ("B", "C", "trade"), ("C", "D", "visits")])


def test_forecasts_are_cleaned(spark):
    items = [{"title": f"t{i}", "probability": p, "severity": s} for i, (p, s) in enumerate([(2, "high"), ("x", "odd"), (-1, None), (0.3, "LOW"), (0.4, "critical"), (0.5, "LOW")])]
    g = graph(spark)
    asked = []
    got = S.forecast(g, betweenness(g), lambda p: asked.append(p) or f"Sure: {json.dumps({'forecasts': items})}")
    assert [(x["probability"], x["severity"]) for x in got["forecasts"]] == [(1, "HIGH"), (0.5, "MEDIUM"), (0, "MEDIUM"), (0.3, "LOW"), (0.4, "CRITICAL")]
    assert got["n_reciprocal"] == 1 and got["hotspots"] and "A -[attacks]-> B" in asked[0]
    assert S.clean_forecasts("nothing") == [] and S.clean_forecasts('[{"title": "a"}]')[0]["severity"] == "MEDIUM"
    assert S.forecast(Graph.literal(spark, [("A", "x")], []), g.v, str)["forecasts"] == []


def test_simulation_leaves_the_graph(spark):
    g = graph(spark)
    answer = {"risk_score": 130, "risk_label": "?", "added": [{"from": "A", "to": "D", "label": "bombs", "confidence": "x"}, {"from": "A"}], "removed": [{"from": "B", "to": "C"}]}
    r = S.simulate(g, "what if", lambda p: json.dumps(answer))
    assert (r.score, r.label, r.added, r.removed) == (100, "CRITICAL", [("A", "D", "bombs", 1.0)], [("B", "C")])
    assert g.e.count() == 4 and sorted((x.src, x.dst) for x in S.applied(g, r).e.collect()) == [("A", "B"), ("A", "D"), ("B", "A"), ("C", "D")]
    assert S.clean_simulation("s", "broken").label == "LOW"


def test_chat_and_narrative_use_the_graph(spark):
    g = graph(spark)
    assert "- A → attacks → B" in S.chat(g, "zzz?", lambda p: p) and "B trade C" in S.narrative(g, lambda p: p)


def test_fetch_isolates_failures(spark):
    page = "<body><p>" + "text " * 60 + "</p></body>"

    def fetcher(url):
        if "bad" in url:
            raise OSError("down")
        return page

    urls = spark.createDataFrame([("http://ok.example.com",), ("http://bad.example.com",), ("http://127.0.0.1/",)], "url string")
    got = {r.url: (bool(r.text), r.error) for r in fetch(urls, fetcher).collect()}
    assert got == {"http://ok.example.com": (True, None), "http://bad.example.com": (False, "down"), "http://127.0.0.1/": (False, "url not allowed")}


def test_health_by_sources_and_thresholds(spark):
    evidence = spark.createDataFrame([("A", "s1"), ("A", "s2"), ("B", "s1")], "id string, source string")
    r = A.health_by_sources(graph(spark), evidence, 0).first()
    assert r.source_diversity == 0.5 and r.score == round(25 / 7 + 25 + 12.5 + 25)
    t = A.with_threshold(spark.createDataFrame([("A", 75.0)], "id string, threshold double"), "A", 30)
    assert [tuple(x) for x in A.with_threshold(t, "B", 50).orderBy("id").collect()] == [("A", 30.0), ("B", 50.0)]
