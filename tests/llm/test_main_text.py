"""Operator 13 against the articles that pages were made of."""

import html
import random
import re

import pytest

from streetgrid.llm import main_text, queries


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_given_pages(spark):
    """The given pages hold one article element each, without any furniture inside."""
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op13_main_text(spark, sf_dir)
    assert set(found.columns) == {"page_id", "url", "text", "n_chars"}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"]).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        want[r["page_id"]] = "\n\n".join(b for b in (" ".join(html.unescape(p).split()) for p in parts) if b)
    assert texts(found) == want
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


def site(rnd, pages, opaque):
    """Pages of one site: a template around articles, with or without names that tell what is what."""
    say = lambda n: " ".join(rnd.choice("amber birch cedar dune ember flint grove heath inlet jetty".split()) + str(rnd.randrange(50)) for _ in range(n))
    name = {k: (f"x{i}" if opaque else k) for i, k in enumerate("page top menu main sidebar notice ads comments bottom".split())}
    menu = "".join(f'<li><a href="/{k}?s={{s}}">{say(2)}</a></li>' for k in range(6))
    side, bottom, notice, shared = say(12), say(9), say(8), "A passage that many articles share, " + say(40)
    made = []
    for k in range(pages):
        blocks = [say(5).title(), *(say(rnd.randint(20, 60)) + " &amp; more." for _ in range(rnd.randint(2, 5)))]
        if k % 2:
            blocks.insert(2, shared)
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}\n" if j % 2 else f"<p>{b}</p>" for j, b in enumerate(blocks[1:]))
        about = f'<div class="{name["notice"]}"><p>{notice}</p></div>'
        made.append(
            (
                f"<!doctype html><html><head><title>{blocks[0]}</title><style>p>a{{}}</style></head><body><div id={name['page']}>"
                f'<div class="{name["top"]}"><a href="/">Site</a> <span>{bottom[:9]}</span></div><ul class={name["menu"]}>{menu.replace("{s}", str(k))}</ul>{about}'
                f'<div class="{name["main"]}">{inner}<script>if (a < b) document.write("<p>no</p>")</script></div>'
                f'<div class="{name["sidebar"]}"><h3>{side}</h3><ul><li>{say(1) if not opaque else side}</li></ul></div>'
                f'<div class="{name["bottom"]}">{bottom} page {k} of {pages}</div></div></body></html>',
                "\n\n".join(html.unescape(b) for b in blocks),
            )
        )
    return made


@pytest.mark.parametrize("opaque", [False, True])
@pytest.mark.parametrize("broadcast_rows", [main_text.BROADCAST_ROWS, 0])
def test_site_templates(spark, opaque, broadcast_rows):
    rnd = random.Random(5)
    made = site(rnd, 40, opaque)
    made += made[:1] * 30
    rows = [(i, f"https://Site.example.com/{i}", h, "kept") for i, (h, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _site string")
    found = main_text.extract(pages, broadcast_rows=broadcast_rows)
    assert found.columns == ["page_id", "url", "html", "_site", "text", "n_chars"]
    got = texts(found)
    wrong = [(got[i], t) for i, (_, t) in enumerate(made) if got[i] != t]
    assert not wrong, (len(wrong), wrong[0])


PAGES = [
    ("<p>one<p>two &lt;b&gt; &eacute;&nbsp;&#33;</p> three <br> four", "one\n\ntwo <b> é !\n\nthree four"),
    ("", ""),
    (None, ""),
    ("<script>var a = '<p>x</p>'", ""),
    ("<nav>a</nav><article><header><h1>T</h1></header>a<b>b</b>c<aside>no</aside><form>no</form><p>d</article><footer>no</footer>", "T\n\nabc\n\nd"),
    ("<main><div class='cookie-notice'>no</div><p>yes</p><section id=comments><article><p>no</article></section></main>", "yes"),
    ("<article><p>yes<div class=\"share-bar\">no</div><table><tr><td>a</td><td>b</td></tr><tr><td>c</table></article>", "yes\n\na b\n\nc"),
    ("<div><div><div>deep</div></div>", "deep"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"),
    ("text < 3 and > 2 <3 <!-- no -- > no --> more <a title='x > y'>z</a><p", "text < 3 and > 2 <3 more z"),
    ("<div class=with-sidebar><h1>T</h1><p>yes</p><div class=sidebar>no</div></div>", "T\n\nyes"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("<div>" * 3000 + "x" + "</div>" * 3000, "x"),
    ("<article>" + "<p>long text</p>" * 20_000, "\n\n".join(["long text"] * 20_000)),
]


def test_odd_pages(spark):
    rows = [(i, None if i % 2 else f"http://h{i}.example.org/", h) for i, (h, _) in enumerate(PAGES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = main_text.extract(pages)
    assert found.count() == len(rows)
    for i, t in texts(found).items():
        assert t == PAGES[i][1], PAGES[i][0][:200]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_shared_passages_and_copies_stay(spark):
    """What recurs inside articles is prose; copies of one page do not make it a template."""
    shared = "<p>" + "a passage that every page of this site has " * 5 + "</p>"
    made = [f"<body><div class=k><b>Site of things</b></div><article><h1>n{'abcdefghij'[i % 10] * (i + 1)}</h1>{shared}</article></body>" for i in range(30)]
    made += ["<body><div id=z><p>one page, copied</p></div></body>"] * 50
    pages = spark.createDataFrame([(i, "http://s.example.net/", h) for i, h in enumerate(made)], "page_id long, url string, html string")
    got = texts(main_text.extract(pages))
    assert all("a passage that every" in got[i] and "Site of" not in got[i] for i in range(30))
    assert got[40] == "one page, copied"
