"""Main text of web pages by removal of site templates (operator 13).

Pages are read into blocks of text and a tree of block elements. Each element's subtree has a hash of its tag, its text and
its children's hashes, in which attributes do not count and digits are alike. Spark counts, host by host, in how many
different pages a subtree recurs; a page counts by its longest block, so copies of one page are one page. Subtrees that
recur in many pages of their host are the site's template and go, wherever they are not prose of the article itself.

The article is what ``article`` or ``main`` hold; where a page has neither, the innermost element, by its path of tags and
names, that holds most of the host's prose; else the whole page. What says by itself that it is no article (navigation,
forms, scripts, names such as ``sidebar`` or ``comments``) goes in any case, so hosts of one page are served too.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, slices
from .url_filter import host_of

#: A subtree is template in a host of p different pages where it recurs in ENOUGH of these, or, in small hosts, in
#: SHARE * p, but in LEAST at least.
LEAST, SHARE, ENOUGH = 3, 0.3, 20
#: The host's content element holds such a part of its prose.
MOST = 0.6
#: Templates that are broadcast, as rows of 16 bytes; more of them are joined page by page.
BROADCAST_ROWS = 1 << 20

_NEVER = set("script style noscript template iframe object svg math canvas audio video textarea select option button input label title head".split())
_FURNITURE = set("nav footer aside form dialog menu fieldset".split())
_BLOCKS = set("html body article main section div center header footer nav aside form dialog menu fieldset address blockquote details summary figure figcaption dl dt dd ul ol li table caption thead tbody tfoot tr p pre h1 h2 h3 h4 h5 h6 hgroup search legend".split())
_TREE = _BLOCKS | _NEVER
#: Elements whose own text is prose: inside the article, recurrence alone does not remove them.
_PROSE = set("p pre h1 h2 h3 h4 h5 h6 blockquote li dt dd figcaption caption tr table tbody ul ol dl".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
#: A start tag ends these open elements first, back to the elements that hold such items.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_ENDS_P = _BLOCKS - {"html", "body", "legend", "caption", "thead", "tbody", "tfoot", "tr"}
#: Names, as words of class, id and role, of what is no article.
_NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars sidenav rail nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar contentinfo complementary dialog comment comments commentlist disqus replies respond share sharing sharebar social related recommended recommendations newsletter subscribe subscription signup login search searchbox widget widgets pagination pager paging toolbar copyright skip skiplink".split())
_HEADERS = set("header banner".split())
#: What readers wrote, whatever elements it is in.
_REMARKS = set("comment comments commentlist disqus replies respond".split())
_TEASERS = set("teaser teasers card comment comments reply related promo sponsored ad advert".split())
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<(?=[!?/a-zA-Z])[^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """Blocks of a page in order, and its block elements, each over a range of blocks."""

    __slots__ = ("blocks", "tags", "names", "parents", "first", "last", "hashes", "links", "hidden")

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.links: list[int] = []
        self.tags, self.names, self.parents = ["#page"], [frozenset()], [-1]
        self.first, self.last, self.hashes, self.hidden = [0], [0], [0], [False]
        self._read(source)

    def _read(self, source: str) -> None:
        blocks, links, tags, parents = self.blocks, self.links, self.tags, self.parents
        items: list[list[bytes]] = [[]]
        open_nodes, open_tags = [0], {}
        text: list[str] = []
        linked, in_link, at = 0, False, 0

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(references.unescape("".join(text)).split())
                text.clear()
                if words:
                    blocks.append(words)
                    links.append(min(linked, len(words)))
                    items[-1].append(xxhash.xxh3_64_digest(_DIGITS.sub("0", words)))
                linked = 0

        def close() -> None:
            flush()
            node = open_nodes.pop()
            tag = tags[node]
            open_tags[tag] = open_tags.get(tag, 1) - 1
            self.last[node] = len(blocks)
            made = xxhash.xxh3_64(tag + ">")
            made.update(b"".join(items.pop()))
            self.hashes[node] = made.intdigest()
            if items and len(blocks) > self.first[node]:
                items[-1].append(made.digest())

        for token in _TOKEN.finditer(source):
            start = token.start()
            if start < at:
                continue
            if start > at:
                piece = source[at:start]
                text.append(piece)
                if in_link:
                    linked += len(piece)
            at = token.end()
            ends, tag, attributes = token.group(1, 2, 3)
            if tag is None:
                ends, tag, attributes = token.group(4, 5, 6)
                if tag is None:
                    continue
            tag = tag.lower()
            if not ends and tag in _RAW:
                stop = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])[^>]*>").search(source, at)
                at = stop.end() if stop else len(source)
                continue
            if tag == "a":
                in_link = not ends
            if tag not in _TREE:
                if tag in ("br", "td", "th", "img", "wbr"):
                    text.append("" if tag == "wbr" else " ")
                elif tag == "hr":
                    flush()
                continue
            if ends:
                if open_tags.get(tag, 0) > 0:
                    while tags[open_nodes[-1]] != tag:
                        close()
                    close()
                continue
            if tag in _ENDS_P and open_tags.get("p", 0) > 0:
                while tags[open_nodes[-1]] != "p":
                    close()
                close()
            if tag in _ENDS:
                these, holders = _ENDS[tag]
                for k in range(len(open_nodes) - 1, 0, -1):
                    name = tags[open_nodes[k]]
                    if name in these:
                        while len(open_nodes) > k:
                            close()
                        break
                    if name in holders or not holders and name not in these:
                        break
            if tag in _VOID:
                continue
            flush()
            in_link = False
            names, hidden = _names(attributes) if attributes and not attributes.isspace() else (frozenset(), False)
            open_nodes.append(len(tags))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            tags.append(tag)
            self.names.append(names)
            self.hidden.append(hidden)
            parents.append(open_nodes[-2])
            self.first.append(len(blocks))
            self.last.append(len(blocks))
            self.hashes.append(0)
            items.append([])
        if at < len(source):
            text.append(source[at:])
        while open_nodes:
            close()


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    names, hidden = set(), False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden":
            hidden = hidden or value != "until-found"
        elif key == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            names.update(_WORD.findall(value))
    return frozenset(names), hidden


def _plain(page: Page) -> tuple[list[bool], list[int]]:
    """Of every element: whether an article or main lies in it, and its highest heading up to the second, else 3."""
    article, heading = [False] * len(page.tags), [3] * len(page.tags)
    remark = [False] * len(page.tags)
    for k in range(1, len(page.tags)):
        remark[k] = remark[page.parents[k]] or page.tags[k] not in ("html", "body") and bool(page.names[k] & _REMARKS)
    for k in range(len(page.tags) - 1, -1, -1):
        article[k] = article[k] or (page.tags[k] in ("article", "main") and not remark[k] and not page.names[k] & _TEASERS)
        heading[k] = min(heading[k], {"h1": 1, "h2": 2}.get(page.tags[k], 3))
        if k:
            up = page.parents[k]
            article[up] = article[up] or article[k]
            heading[up] = min(heading[up], heading[k])
    return article, heading


def _furniture(page: Page) -> list[bool]:
    """Whether an element says by tag or name that it is no article."""
    article, heading = _plain(page)
    out = [False] * len(page.tags)
    inside = [False] * len(page.tags)
    for k in range(1, len(page.tags)):
        tag, up = page.tags[k], page.parents[k]
        inside[k] = inside[up] or tag in ("article", "main") and article[k]
        if tag in ("html", "body") or article[k]:
            continue
        teaser = tag == "article" and page.names[k] & _TEASERS
        named = page.names[k] & _NAMES and heading[k] > 1
        header = (tag == "header" or page.names[k] & _HEADERS) and not (inside[k] and heading[k] < 3)
        out[k] = tag in _NEVER or page.hidden[k] or tag in _FURNITURE or bool(teaser or named or header)
    return out


def _gone(page: Page, furniture: list[bool]) -> np.ndarray:
    gone = np.zeros(len(page.blocks), bool)
    for k in range(1, len(page.tags)):
        if furniture[k]:
            gone[page.first[k] : page.last[k]] = True
    return gone


def _paths(page: Page) -> list[int]:
    """A hash of the tags and names on the way to every element."""
    out = [0]
    for k in range(1, len(page.tags)):
        step = page.tags[k] + "." + ".".join(sorted(page.names[k]))
        out.append(xxhash.xxh3_64_intdigest(step, out[page.parents[k]]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Kinds of counted things: subtrees, paths of elements, and pages themselves.
SUBTREE, PATH, PAGE = 0, 1, 2


def _things(page: Page) -> Iterator[tuple[int, int, int, int, int]]:
    """(kind, hash, content, prose, depth) of a page, once for each kind and hash."""
    if not page.blocks:
        return
    content = _signed(xxhash.xxh3_64_intdigest(max(page.blocks, key=lambda b: (len(b), b))))
    gone = _gone(page, _furniture(page))
    prose = np.concatenate([[0], np.cumsum([0 if g else max(0, len(b) - 2 * n) for b, n, g in zip(page.blocks, page.links, gone, strict=True)])])
    yield PAGE, 0, content, int(prose[-1]), 0
    seen = set()
    paths, depth = _paths(page), [0] * len(page.tags)
    held: dict[int, list[int]] = {}
    for k in range(1, len(page.tags)):
        depth[k] = depth[page.parents[k]] + 1
        if page.last[k] > page.first[k]:
            if page.hashes[k] not in seen:
                seen.add(page.hashes[k])
                yield SUBTREE, _signed(page.hashes[k]), content, 0, 0
            if page.tags[k] not in _PROSE:
                held.setdefault(paths[k], [0, depth[k]])[0] += int(prose[page.last[k]] - prose[page.first[k]])
    for path, (chars, deep) in held.items():
        yield PATH, _signed(path), 0, chars, deep


def main_text(page: Page, marks: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by an empty line; ``marks`` are the host's template subtrees and content paths."""
    furniture, (article, _) = _furniture(page), _plain(page)
    n = len(page.tags)
    roots = []
    for tag in ("article", "main"):
        roots = roots or [k for k in range(1, n) if page.tags[k] == tag and article[k] and not page.names[k] & _TEASERS]
    if not roots and marks:
        paths = _paths(page)
        roots = [k for k in range(1, n) if _signed(paths[k]) in marks]
    inside = [False] * n
    for k in roots:
        inside[k] = True
    gone = _gone(page, furniture)
    for k in range(1, n):
        inside[k] = inside[k] or inside[page.parents[k]]
        prose = page.tags[k] in _PROSE and inside[k]
        if marks and not prose and not article[k] and _signed(page.hashes[k]) in marks:
            gone[page.first[k] : page.last[k]] = True
    if roots:
        kept = np.zeros(len(page.blocks), bool)
        for k in roots:
            kept[page.first[k] : page.last[k]] = True
        gone |= ~kept
    return "\n\n".join(b for b, g in zip(page.blocks, gone, strict=True) if not g)



_COUNTED = T.StructType([T.StructField("host", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("content", T.LongType()), T.StructField("prose", T.LongType()), T.StructField("depth", T.IntegerType())])


def _marks(pages: DataFrame) -> DataFrame:
    """(host, hash): template subtrees and content paths of every host, from pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(h, *t) for h, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for t in _things(Page(s))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=_COUNTED.names)

    each = pages.filter("host is not null").select("host", "html").mapInArrow(run, _COUNTED)
    once = each.groupBy("host", "kind", "hash", "content").agg(F.sum("prose").alias("prose"), F.max("depth").alias("depth"))
    things = once.groupBy("host", "kind", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("prose").alias("prose"), F.max("depth").alias("depth"))
    things = cut(things.filter((F.col("kind") > SUBTREE) | (F.col("n") >= LEAST)))
    hosts = things.filter(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"), F.col("prose").alias("total"))
    known = things.filter(F.col("kind") < PAGE).join(hosts, "host")
    many = F.greatest(F.lit(LEAST), F.least(F.lit(ENOUGH), F.ceil(SHARE * F.col("pages"))))
    template = known.filter((F.col("kind") == SUBTREE) & (F.col("n") >= many)).select("host", "hash")
    main = known.filter((F.col("kind") == PATH) & (F.col("pages") >= LEAST) & (F.col("prose") >= MOST * F.col("total")) & (F.col("total") > 0))
    main = main.groupBy("host").agg(F.max(F.struct("depth", "prose", "hash")).alias("best")).select("host", F.col("best.hash").alias("hash"))
    return template.unionByName(main)


def extract(pages: DataFrame, keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add text (the main text) and n_chars (its code points) to pages (url, html).

    Character references are decoded, white space inside a block is one space, and blocks are joined in page order by an
    empty line. A page without html, or without an article, has an empty text. Pages whose url names no host take part in
    no count. Rows may repeat; copies of a page count once. Columns of ``pages`` that are named text or n_chars are
    replaced; an empty table gives an empty one.

    Marks of hosts (template subtrees and content paths) are broadcast where there are no more than ``broadcast_rows``;
    otherwise they are joined to the elements of each page, so that no size of a site or number of hosts is a bound.
    """
    spark = pages.sparkSession
    host = host_of(F.col("url"))
    named = F.when(host != "", F.xxhash64(host))
    marks = cut(_marks(pages.select(named.alias("host"), F.coalesce("html", F.lit("")).alias("html"))))
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    kept = pages.columns if keep is None else keep
    at, page, found_marks = (_free(name, pages.columns) for name in ("_site", "_page", "_marks"))
    source = pages.select(*(pages[c] for c in pages.columns), named.alias(at))
    if marks.count() <= broadcast_rows:
        by_host: dict[int, set[int]] = {}
        for r in marks.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        given = spark.sparkContext.broadcast(by_host)

        def make() -> Callable[..., list]:
            sites = given.value
            nothing: frozenset[int] = frozenset()
            return lambda html, site: _texts(html, (sites.get(h, nothing) for h in site.to_pylist()))

        return add_columns(source, make, ["html", at], fields, kept)

    source = source.withColumn(page, F.when(F.col(at).isNotNull(), F.sha2(F.coalesce("html", F.lit("")), 256)))
    each = _elements(source.filter(F.col(at).isNotNull()).select(F.col(at).alias("host"), F.col(page).alias("page"), F.coalesce("html", F.lit("")).alias("html")))
    found = each.join(marks, ["host", "hash"]).groupBy(F.col("host").alias(at), F.col("page").alias(page)).agg(F.collect_set("hash").alias(found_marks))
    return add_columns(source.join(found, [at, page], "left"), lambda: lambda html, marked: _texts(html, (set(m or ()) for m in marked.to_pylist())), ["html", found_marks], fields, kept)


def _free(name: str, taken: list[str]) -> str:
    while name in (c.lower() for c in taken):
        name += "_"
    return name


def _texts(html: pa.Array, marks: Iterator[set[int]]) -> list[pa.Array]:
    made = [main_text(Page(s or ""), m) for s, m in zip(html.to_pylist(), marks, strict=True)]
    return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]


def _elements(pages: DataFrame) -> DataFrame:
    """(host, page, hash): subtrees and paths of every page."""
    schema = T.StructType([T.StructField("host", T.LongType()), T.StructField("page", T.StringType()), T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(h, p, t[1]) for h, p, s in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True) for t in _things(Page(s)) if t[0] != PAGE]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=schema.names)

    return pages.mapInArrow(run, schema).distinct()
