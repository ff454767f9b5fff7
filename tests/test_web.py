"""Data sources against a stub server and archives, and the feed stream, ingest and cycle over restarts."""

import json
import threading
import time
import urllib.parse
from collections import Counter
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.extract import lexicon_extractor
from weftgraph.sources import web
from weftgraph.stage import new_path
from weftgraph.streaming.cycle import Cycle
from weftgraph.streaming.feeds import FeedIngest, totals
from weftgraph.streaming.store import GraphStore

LONG = "Iran sanctions Peru. " + "More words follow here. " * 20


@pytest.fixture()
def server():
    """Answers by url; what it was asked for is counted."""
    answers, asked = {}, Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)["url"][0]
            asked[url] += 1
            status, body = answers.get(url, (404, ""))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", answers, asked
    s.shutdown()


def test_pages_from_a_server(spark, server):
    gateway, answers, asked = server
    web.register(spark)
    urls = [f"http://host{i % 3}.example.com/{i}?q=é&x={i}" for i in range(25)]
    answers.update({u: (200, f"<p>page {u}</p>") for u in urls[:20]})
    answers[urls[20]] = (500, "broken")
    every = [*urls, urls[0], "http://127.0.0.1/private", "ftp://host.example.com/", "nothing"]
    df = spark.read.format("weft_pages").option("urls", json.dumps(every)).option("gateway", gateway).option("group", 4).load()
    assert df.rdd.getNumPartitions() == 7
    got = {r.url: (r.status, r.html, r.error) for r in df.collect()}
    assert len(got) == 28 and got[urls[1]] == (200, f"<p>page {urls[1]}</p>", None)
    assert got[urls[20]] == (500, None, "HTTP 500") and got[urls[24]] == (404, None, "HTTP 404")
    assert {got[u][2] for u in every[26:]} == {"url not allowed"}
    asked.clear()
    some = df.filter(F.col("url").isin(urls[2], urls[5], "unasked") & F.startswith("url", F.lit("http://host2")))
    assert sorted(r.url for r in some.collect()) == sorted([urls[2], urls[5]]) and set(asked) == {urls[2], urls[5]}
    assert df.filter(F.col("url") == "unasked").collect() == []


def test_pages_from_an_archive(spark):
    web.register(spark)
    pages = spark.createDataFrame([(f"http://a.example.com/{i}", 200 if i % 5 else 503, f"body {i}\n") for i in range(40)], "url string, status int, body string")
    folder, requests = new_path(spark, "archive"), new_path(spark, "requests")
    web.archive(pages, folder)
    web.write_requests(pages.select("url").unionByName(spark.createDataFrame([("http://a.example.com/none\n",), (None,)], "url string")), "url", requests, 7)
    df = spark.read.format("weft_pages").option("folder", folder).option("requests", requests).load()
    assert df.rdd.getNumPartitions() >= 6
    got = {r.url: (r.status, r.html, r.error) for r in df.collect()}
    assert len(got) == 41 and got["http://a.example.com/none\n"] == (404, None, "HTTP 404")
    assert all(got[f"http://a.example.com/{i}"] == ((200, f"body {i}\n", None) if i % 5 else (503, None, "HTTP 503")) for i in range(40))
    empty = new_path(spark, "none")
    web.write_requests(pages.limit(0), "url", empty)
    assert spark.read.format("weft_pages").option("folder", folder).option("requests", empty).load().collect() == []


def test_news(spark, server):
    gateway, answers, asked = server
    web.register(spark)
    articles = [{"title": f"t{i}", "url": f"http://n/{i}", "seendate": f"202401{30 - i:02}T000000Z"} for i in range(14)]
    for term, body in (("Côte d'Ivoire", json.dumps({"articles": articles})), ("odd", "<html>"), ("none", json.dumps({"articles": []}))):
        answers[web.news_url(term, 200)] = (200, body)
    told = spark.createDataFrame([("Côte d'Ivoire",), ("a b+c&d",)], "t string").select("t", web.news_url_column(F.col("t"), 200).alias("u")).collect()
    assert all(r.u == web.news_url(r.t, 200) for r in told) and "timespan=90d" in told[0].u
    df = spark.read.format("weft_news").option("terms", json.dumps(["Côte d'Ivoire", "odd", "none", "gone"])).option("days", 200).option("gateway", gateway).load()
    got = df.collect()
    assert [(r.place, r.title) for r in got if r.term[0] == "C"] == [(i + 1, f"t{i}") for i in range(10)]
    assert {r.term: r.error for r in got if r.error} == {"odd": "no articles in the answer", "gone": "HTTP 404"}
    asked.clear()
    late = df.filter((F.col("term") == "Côte d'Ivoire") & (F.col("ts") >= F.lit(datetime(2024, 1, 28, tzinfo=timezone.utc))))
    assert sorted(r.title for r in late.collect()) == ["t0", "t1", "t2"] and sum(asked.values()) == 1


def test_entries_of_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>a</title><link rel="self" href="s"/><link href="http://y"/><content>c</content><updated>u</updated></entry></feed>'
    assert web.entries(atom, 5) == [(1, "a", "http://y", "c", "u")]
    rss = "<rss><channel><item><title> t </title><link> http://x </link><description/></item><item/></channel></rss>"
    assert web.entries(rss, 5) == [(1, "t", "http://x", None, None), (2, None, None, None, None)] and len(web.entries(rss, 1)) == 1
    for bad in ("<html/>", "{}", ""):
        with pytest.raises(ValueError):
            web.entries(bad, 5)


def test_a_model_service_as_extractor(spark):
    from weftgraph.functions.extract import extract, service_extractor

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            told = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = told["prompt"].removeprefix("Extract: ")
            good = json.dumps({"extractions": [{"extraction_class": "country", "extraction_text": text, "attributes": {}, "confidence": 0.9}]})
            self.send_response(200 if text != "down" else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"response": "no idea" if text == "bad" else f"Sure: {good}", "model": told["model"]}).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    run = service_extractor(f"http://127.0.0.1:{s.server_port}/api", "m", "Extract: ")
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.doc_id, r.text, r.parse_error) for r in extract(docs("Peru", "bad"), run).collect()} == {(0, "Peru", None), (1, None, "no JSON object")}
    with pytest.raises(Exception, match="500"):
        extract(docs("down"), run).collect()
    s.shutdown()


def feed(*links):
    return "<rss><channel>" + "".join(f"<item><title>{x}</title><link>http://n.example.com/{x}</link></item>" for x in links) + "</channel></rss>"


def ingest_of(spark, gateway, root, **more):
    store = GraphStore(spark, f"{root}/store", buckets=4)
    run = lambda texts: ["no JSON" if "faulty" in t else a for t, a in zip(texts, lexicon_extractor({"Iran": "country", "Peru": "country", "Ann": "person"}, {"sanctions": "sanctions"})(texts))]
    feeds = json.dumps([["http://f.example.com/1", "One"], ["http://f.example.com/2", None], ["http://f.example.com/bad", "Bad"]])
    options = {"gateway": gateway, "feeds": feeds, "snapshots": f"{root}/snapshots", "every": "1", "entries": "4"} | more
    return FeedIngest(store, FeedIngest.statuses(store, f"{root}/status"), run, options)


def page(text):
    return 200, f"<html><body><p>{text}</p></body></html>"


def once(query):
    query.awaitTermination(240)
    assert query.exception() is None


def test_feeds_are_read_once_per_url_over_a_restart(spark, server):
    gateway, answers, asked = server
    n = lambda x: f"http://n.example.com/{x}"
    answers.update({"http://f.example.com/1": (200, feed("good", "short", "gone")), "http://f.example.com/2": (200, feed("good", "bad")), n("good"): page(LONG), n("short"): page("Too little."), n("bad"): page("faulty " * 80)})
    root = new_path(spark, "feeds")
    ingest = ingest_of(spark, gateway, root)
    real = ingest.log.write
    ingest.log.write = lambda *_: (_ for _ in ()).throw(RuntimeError("crash"))  # dies after the graph is written
    query = ingest.start(f"{root}/check", every=None)
    with pytest.raises(Exception, match="crash"):
        query.awaitTermination(240)
    ingest.log.write = real
    first = dict(asked)
    answers["http://f.example.com/1"] = (200, feed("other"))  # the batch that is run again keeps to what the feed said
    once(ingest_of(spark, gateway, root).start(f"{root}/check", every=None))
    log = {(r.url.rpartition("/")[2], r.status, r.error) for r in ingest.log.read().filter("batch = 0").collect()}
    assert log == {("good", "ok", None), ("good", "skipped", None), ("short", "skipped", "Text too short"), ("gone", "error", "Fetch: HTTP 404"), ("bad", "error", "Extract: no JSON object"), ("bad", "error", "HTTP 404")} - {("bad", "error", "HTTP 404")} | {("bad", "error", "HTTP 404")}
    assert asked["http://f.example.com/1"] >= first["http://f.example.com/1"]
    answers[n("other")] = page("Ann sanctions Iran. " + LONG)
    time.sleep(1.1)
    once(ingest_of(spark, gateway, root).start(f"{root}/check", every=None))
    every = ingest.log.read().collect()
    assert [r.url for r in every if r.status == "ok" and r.url == n("good")] == [n("good")]
    ok = {r.url: (r.entities, r.relations, r.new_nodes) for r in every if r.status == "ok"}
    assert ok == {n("good"): (2, 1, 2), n("other"): (3, 2, 1)}
    g, _ = ingest.store.load(ingest.store.newest())
    assert sorted(r.id for r in g.v.collect()) == ["Ann", "Iran", "Peru"]
    by_feed = {r.feed: (r.ok, r.errors) for r in totals(ingest.log.read()).collect()}
    assert sum(x[0] for x in by_feed.values()) == 2 and by_feed["Bad"][1] >= 2


def test_a_stream_of_feeds_needs_a_place_for_snapshots(spark):
    web.register(spark)
    with pytest.raises(Exception, match="snapshots"):
        spark.readStream.format("weft_feeds").option("feeds", "[]").load().writeStream.format("noop").trigger(once=True).start().awaitTermination(60)


def test_cycles_are_logged_once_over_a_restart(spark, server):
    gateway, answers, _ = server
    answers.update({"http://f.example.com/1": (200, feed("good")), "http://f.example.com/2": (200, feed("more")), "http://n.example.com/good": page(LONG), "http://n.example.com/more": page("Ann sanctions Peru. " + LONG)})
    root = new_path(spark, "cycle")
    cycle = Cycle(ingest_of(spark, gateway, root), f"{root}/check", root, interval_secs=5)
    assert cycle.interval == 60 and not cycle.active()
    with pytest.raises(ValueError):
        cycle.stop()
    query = cycle.start()
    with pytest.raises(ValueError):
        cycle.start()
    end = time.time() + 120
    while cycle.cycles.batches() < 0 and time.time() < end:
        time.sleep(0.5)
    assert cycle.status()["active"] and cycle.stop(60) == 1 and not query.isActive
    dies = Cycle(ingest_of(spark, gateway, root), f"{root}/check", root)
    dies.queries.write = lambda *_: (_ for _ in ()).throw(RuntimeError("crash"))
    time.sleep(1.1)
    with pytest.raises(Exception, match="crash"):
        dies.once().awaitTermination(240)
    failing = ingest_of(spark, gateway, root)
    failing.batch = lambda *_: (_ for _ in ()).throw(RuntimeError("no network"))
    for own in (ingest_of(spark, gateway, root), failing):  # the cycle that died again, then one that fails
        time.sleep(1.1)
        again = Cycle(own, f"{root}/check", root)
        once(again.once())
    status = again.status()
    assert [(c["cycle"], c["articles"], bool(c["error"])) for c in status["cycle_log"]] == [(3, 0, True), (2, 0, False), (1, 2, False)]
    assert (status["cycle"], status["total_articles"], status["nodes"], status["active"]) == (3, 2, 3, False)
    assert Counter(q["cycle"] for q in status["query_log"]) == {1: 5, 2: 5, 3: 5}
    with pytest.raises(ValueError):
        Cycle(ingest_of(spark, gateway, root, feeds="[]"), f"{root}/check", root).start()
