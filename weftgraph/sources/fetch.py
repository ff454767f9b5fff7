"""Pages from the network: allowed urls only, texts cut at a length. The fetcher is a parameter; the default uses urllib."""

from __future__ import annotations

import ipaddress
import socket
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import html_text
from weftgraph.sources.documents import MAX_TEXT, blocked_address, blocked_host, url_allowed

Fetcher = Callable[[str], str]
TIMEOUT = 15


def check_url(url: str) -> None:
    """Raises where a url isn't http or https, or its host is, or resolves to, a private or reserved address."""
    parts = urllib.parse.urlsplit(url)
    host = parts.hostname or ""
    if parts.scheme not in ("http", "https") or not host or blocked_host(host):
        raise ValueError("url not allowed")
    for found in socket.getaddrinfo(host, parts.port or 80, proto=socket.IPPROTO_TCP):
        if blocked_address(ipaddress.ip_address(found[4][0].split("%")[0])):
            raise ValueError("url not allowed")


class _Checked(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        check_url(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def over_http(url: str) -> str:
    """A page's text. Its url and those that it redirects to are checked, with the addresses of their hosts."""
    check_url(url)
    with urllib.request.build_opener(_Checked).open(url, timeout=TIMEOUT) as r:
        return r.read(10 << 20).decode(r.headers.get_content_charset() or "utf-8", "ignore")


def fetch(urls: DataFrame, fetcher: Fetcher = over_http) -> DataFrame:
    """url, text, error for each url. Urls that may not be read, and pages that fail, have an error and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for url in x["url"]:
                try:
                    out.append((url, fetcher(url), None))
                except Exception as e:  # one page's failure is its own
                    out.append((url, None, str(e)[:300] or type(e).__name__))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    ok = url_allowed(F.col("url"))
    got = urls.filter(ok).select("url").mapInPandas(run, "url string, html string, error string")
    texts = got.select("url", F.substring(html_text(F.col("html")), 1, MAX_TEXT).alias("text"), "error")
    texts = texts.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), "no readable text")))
    refused = urls.filter(~ok).select("url", F.lit(None).cast("string").alias("text"), F.lit("url not allowed").alias("error"))
    return texts.unionByName(refused)
