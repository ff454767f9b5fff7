"""The readable part of pages: menus and footers go, the article stays; a plain model on trees."""

import random
import re
from xml.etree import ElementTree

import pytest

from weftgraph.functions import text as X

PROSE = "Officials met on Monday, after weeks of talks, to sign the treaty, and promised to publish it. "


def test_a_long_menu_and_a_short_article():
    menu = "".join(f'<li><a href="/{i}">Section number {i}, with a long name and more</a></li>' for i in range(200))
    article = "".join(f"<p>{PROSE}{i}</p>" for i in range(3))
    html = f'<html><head><title>t</title><script>var a = "x";</script></head><body><div class="wrap"><div id="box"><ul>{menu}</ul></div><div class="story">{article}</div><div class="comments"><p>{PROSE * 9}</p></div><div><p>Copyright, all rights reserved, by us.</p></div></div></body></html>'
    got = X.readable_text(html)
    assert got == X._flat("".join(f"{PROSE}{i} " for i in range(3))) and X.page_text(html) == got


@pytest.mark.parametrize("html", ["", "no tags at all", "<p>short</p>", "<div><p>" * 3000, "</div></p>", "<p>a<p>b<table><tr><td>c", "<!-- x --><![CDATA[y]]><a b='", "<br/><img><p class>x</p>"])
def test_odd_pages(html):
    assert isinstance(X.readable_text(html), str)
    assert X.page_text(html) is None or len(X.page_text(html)) > 100


def model(html):
    """The same rule by loops over an element tree."""
    root = ElementTree.fromstring(html)
    up = {c: p for p in root.iter() for c in p}

    def dropped(e):
        names = f"{e.get('class') or ''} {e.get('id') or ''}"
        return e.tag in X._SCRIPTS or e.tag not in ("html", "body") and re.search(X.UNLIKELY, names, re.I) and not re.search(X.MAYBE, names, re.I)

    def pieces(e, link=False):
        """(text, in a link) of an element in document order."""
        if dropped(e):
            return []
        link = link or e.tag == "a"
        out = [(e.text or "", link)]
        for c in e:
            out += pieces(c, link) + [(c.tail or "", link)]
        return out

    hidden = lambda e: dropped(e) or e in up and hidden(up[e])
    size = lambda e: 0 if hidden(e) else sum(len(X._flat(t)) for t, _ in pieces(e))
    density = lambda e: min(1.0, sum(len(X._flat(t)) for t, k in pieces(e) if k) / size(e)) if size(e) else 0.0
    weight = lambda e: sum(25 * bool(re.search(X.POSITIVE, e.get(k), re.I)) - 25 * bool(re.search(X.NEGATIVE, e.get(k), re.I)) for k in ("class", "id") if e.get(k))
    points = {}
    for e in root.iter():
        if e.tag in ("p", "pre", "td") or e.tag == "div" and not any(c.tag in X.BLOCKS for c in e):
            if size(e) >= X.LEAST_PARAGRAPH and e in up:
                more = 1 + sum(t.count(",") for t, _ in pieces(e)) + min(size(e) // 100, 3)
                for at, share in ((up[e], 1.0), (up.get(up[e]), 0.5)):
                    if at is not None:
                        points[at] = points.get(at, X.TAG_POINTS.get(at.tag, 0) + weight(at)) + more * share
    if not points:
        return ""
    order = list(root.iter())
    final = {e: x * (1 - density(e)) for e, x in points.items()}
    best = min(final, key=lambda e: (-final[e], order.index(e)))
    out = []
    for e in up[best] if best in up else [best]:
        flat = X._flat("".join(t for t, _ in [(e.text or "", 0)]))
        prose = e.tag == "p" and not hidden(e) and (size(e) > 80 and density(e) < 0.25 or 0 < size(e) <= 80 and not density(e) and re.search(r"\.( |$)", flat))
        if e is best or final.get(e, 0) >= max(10.0, final[best] * 0.2) or prose:
            out += [t for t, _ in pieces(e)] if not hidden(e) else []
    return X._flat(" ".join(out))


@pytest.mark.parametrize("seed", range(40))
def test_against_a_plain_model(seed):
    r = random.Random(seed)
    names = ["", "", "story", "sidebar", "menu", "content", "widget", "main-menu", "comment"]

    def element(depth):
        tag = r.choice(["div", "div", "section", "td", "ul"]) if depth else "p"
        attrs = "".join(f' {k}="{n}"' for k in ("class", "id") if (n := r.choice(names)))
        if not depth or tag == "td" and r.random() < 0.5:
            body = "".join(r.choice([PROSE, "Short one. ", "words, more words ", '<a href="x">a link of some length</a> ']) for _ in range(r.randrange(0, 6)))
            return f"<{tag}{attrs}>{body}</{tag}>"
        return f"<{tag}{attrs}>{''.join(element(depth - 1) for _ in range(r.randrange(0, 4)))}</{tag}>"

    html = f"<html><body>{''.join(element(3) for _ in range(3))}</body></html>"
    assert X.readable_text(html) == model(html)
