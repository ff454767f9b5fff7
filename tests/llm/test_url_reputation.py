import duckdb
import pytest

from weftgraph.llm import url_reputation as U

PAGES = [
    (1, "http://A.Example.NET/en/1"), (2, "https://b.example.com/de/2?x"), (3, "x://org/fr/"), (4, "http://sub.org/fr"), (5, "http://net"), (6, "http://a.net/x"), (7, None), (8, "no scheme"),
    (9, "://"), (14, "http://10.0.0.1/en/2"), (15, "http://[::1]:80/en/1"), (16, "http://u:p@x.com.au:8080/en/11"), (17, "http://y.com.au/" + "z" * 100_000), (18, "http://good.example.org./en/10"), (19, "http://" + "long." * 20_000 + "com/x"), (10, "http://good.example.org/en/10"), (11, "http://bad.example.org/en/11#a://b.net/"), (12, "http://ÄB.net/"), (13, "http://u@h.co.uk:80/a/b?c#d"), (None, "http://bad.example.org/en/12"), (11, "http://bad.example.org/en/11"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "<p>", "x") for r in rows], "page_id bigint, url string, html string, host string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "item bigint, bad int")


def test_parts_and_rules(spark):
    got = {(r.page_id, r.path): r for r in U.url_filter(pages(spark), outcomes(spark, [])).collect()}
    say = lambda i: next((r.host, r.path, r.rule, r.verdict) for (p, _), r in got.items() if p == i)
    assert say(1) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert say(2) == ("b.example.com", "/de/2", "example.com/de/", "block")
    assert say(3) == ("org", "/fr/", "org/fr/", "allow")
    assert say(4) == ("sub.org", "/fr", None, "allow")
    assert say(5) == ("net", "", None, "allow")
    assert say(6) == ("a.net", "/x", "net/", "block")
    assert say(7) == say(8) == say(9) == ("", "", None, "allow")
    assert say(12)[0] == "Äb.net"
    assert say(13)[:2] == ("u@h.co.uk:80", "/a/b")
    assert len(got) == len({(i, u) for i, u in PAGES}) - 1


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://{h}.example.org/en/{i}") for i in range(400) for h in (["bad", "good", "mixed", "few"][i % 4],)] + [(500, "http://new.example.org/en/500")]
    bad = [(i, int(i % 4 == 0 or i % 8 == 2)) for i in range(400) if i % 4 != 3] + [(3, 1), (3, 1), (None, 1)]
    rep = U.host_reputation(pages(spark, rows).selectExpr("regexp_extract(url, '://([^/]*)', 1) as host", "page_id as item"), outcomes(spark, bad))
    h = {r.host.split(".")[0]: r for r in rep.hosts.collect()}
    assert (h["bad"].n, h["bad"].k, h["few"].n, h["few"].k) == (100, 100, 1, 1)
    assert h["bad"].mean > 0.9 and h["good"].mean < 0.1 and 0.4 < h["mixed"].mean < 0.6
    assert h["few"].bound < h["few"].mean < h["bad"].mean and h["few"].bound < h["bad"].bound - 0.3  # one bad page proves less
    got = {r.host.split(".")[0]: r.verdict for r in U.url_filter(pages(spark, rows), outcomes(spark, bad)).collect()}
    assert got["bad"] == got["mixed"] == "block" and got["good"] == got["new"] == "allow"


def test_suffixes(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "u@b.co.uk:80": ("b.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "a.com:8080": ("a.com", "com"), "x.y.example.de": ("example.de", "de"), "a.gov.in": ("a.gov.in", "gov.in"), "a.com.": ("a.com", "com"), "x.b.co.uk.:80": ("b.co.uk", "co.uk"), ".": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    from pyspark.sql import functions as F

    assert {r[0]: (r[1], r[2]) for r in df.select("h", U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()} == want


def test_empty_and_sql(spark):
    assert U.url_filter(pages(spark, []), outcomes(spark, [])).collect() == []
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into pages values (?, ?, '')", PAGES)
    con.executemany("insert into labels values (?, ?, ?)", [(1, 0, 0), (2, 1, 0), (11, 0, 1), (10, 1, 0), (None, 0, 0)])
    sql = con.execute(U.SQL)
    names = [d[0] for d in sql.description]
    want = sorted((dict(zip(names, r)) for r in sql.fetchall()), key=str)
    lab = [(1, 1), (2, 0), (11, 1), (10, 0), (None, 1)]
    got = sorted((r.asDict() for r in U.url_filter(pages(spark), outcomes(spark, lab)).collect()), key=lambda d: str({k: d[k] for k in names}))
    assert [{k: d[k] for k in ("page_id", "host", "path", "rule", "verdict")} for d in got] == [{k: d[k] for k in ("page_id", "host", "path", "rule", "verdict")} for d in want]
    assert [d["bad_bound"] for d in got] == pytest.approx([d["bad_bound"] for d in want], abs=2e-6)
