"""Operator 6 against plain Python."""

import re

from streetgrid.llm import url_filter as uf
from streetgrid.llm.common import table
from streetgrid.llm.queries import op6_url_filter


def parse(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def ranks(edges, seeds, hosts):
    """Dense propagation of one kind; edges: {(a, b): weight}."""
    out = {h: sum(w for (a, _), w in edges.items() if a == h) for h in hosts}
    total = sum(seeds.values()) or 1
    start = {h: seeds.get(h, 0) / total for h in hosts}
    rank = dict(start)
    for _ in range(uf.ROUNDS):
        got = {h: (0 if out[h] else rank[h]) for h in hosts}
        for (a, b), w in edges.items():
            got[b] += rank[a] * w / out[a]
        rank = {h: (1 - uf.DAMPING) * start[h] + uf.DAMPING * got[h] for h in hosts}
    return rank


def expected(rows):
    """rows: (page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust, score)"""
    edges, good, bad, read, pages = {}, {}, {}, [], {}

    def add(a, b):
        edges[a, b] = edges.get((a, b), 0) + 1.0

    for page, url, html in rows:
        host, path = parse(url)
        r = rule(host, path)
        read.append((page, host, path, r))
        if not host:
            continue
        pages[host] = pages.get(host, 0) + 1
        for link in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", html or "", re.I):
            if re.match(r"(?!(https?):)[a-z][a-z0-9+.-]*:(?!//)", link, re.I):
                continue
            named = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(.*)", link, re.I)
            if target := parse("://" + named[1])[0] if named else host:
                add(host, target)
        if r:
            seeds = good if r.verdict == "allow" else bad
            seeds[host] = seeds.get(host, 0) + 1
    outside = {h for a, b in edges if a != b for h in (a, b)}
    for host, n in pages.items():
        labels = re.sub(r":\d*$", "", host).split(".")
        if host in outside or len(labels) < 3 or all(x.isdigit() for x in labels):
            continue
        least = 3 if len(labels[-1]) == 2 and labels[-2] in uf.SHARED_LABELS else 2
        for i in range(len(labels) - least):
            a, b = ".".join(labels[i:]) if i else host, ".".join(labels[i + 1 :])
            for _ in range(n):
                add(a, b)
                add(b, a)
    hosts = {h for e in edges for h in e} | set(pages)
    trust, distrust = ranks(edges, good, hosts), ranks({(b, a): w for (a, b), w in edges.items()}, bad, hosts)
    out = []
    for p, h, path, r in read:
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        part = d / (t + d) if t + d else 0.0
        out.append((p, h, path, r and r.name, r.verdict if r else ("block" if part > uf.THRESHOLD else "allow"), t, d, part))
    return out


def same(found, want):
    found, want = sorted(map(tuple, found), key=str), sorted(want, key=str)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-9 for f, w in zip(found, want, strict=True) for a, b in zip(f[5:], w[5:], strict=True))


def test_op6_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf_dir, "pages").collect()]
    same(op6_url_filter(spark, sf_dir).collect(), expected(rows))


def test_odd_urls_links_and_clashing_columns(spark):
    link = '<A class=x HREF="https://Good.example.ORG/fr/x">y</a><a href=//evil.net/a>z</a><a href="/own">o</a>'
    rows = [
        (1, "HTTPS://WWW.Evil.NET", link), (2, "http://evil.net/", None), (3, "//no.scheme/x", ""), (4, None, link), (5, "", None),
        (6, "x://a.b.example.com?q=://z/de/", link), (7, "http://example.com/de", ""), (8, "http://deep.sub.example.com/de/1#f", link),
        (9, "http://notexample.net/en/", ""), (10, "ftp://example.net/en/../x", ""), (11, "http://good.example.org/fr/", ""), (11, "http://good.example.org/fr/", ""),
        (12, "http:///path", ""), (13, "http://lone.host/a", '<a href="http://other.lone/">'), (14, "http://é.ORG/fr/É", "\n<a\nhref='http://x.example.org'>"),
        (15, "http://one.shop.co.uk/", '<a href="mailto:a@b.net">'), (16, "http://two.shop.co.uk:8080/", None), (17, "http://other.co.uk/", None), (18, "http://10.0.0.1/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    same(uf.judge(pages).drop("url", "html").collect(), expected(rows))
    clash = pages.selectExpr("*", "1 AS trust", "'x' AS host", "'mine' AS said", "2 AS dst")
    assert uf.judge(clash).columns == ["page_id", "url", "html", "said", "dst", "host", "path", "rule", "verdict", "trust", "distrust", "host_score"]
    assert {r["said"] for r in uf.judge(clash).collect()} == {"mine"}
    strict, lax = (uf.judge(pages, threshold=x).filter("rule is null and verdict = 'block'").count() for x in (0.0, 1.0))
    assert strict > 0 and lax == 0
    assert uf.judge(pages.limit(0)).count() == 0
