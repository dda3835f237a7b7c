"""URL filters: rules, and propagation of trust and distrust over the graph of hosts where no rule fits (operator 6).

Hosts of allowed pages are trusted seeds, hosts of blocked pages blocked seeds, each by its pages. Trust is the
personalised PageRank of the trusted seeds along host edges: whom the trusted link to is trusted. Distrust is that of the
blocked seeds along reversed edges: who links to the blocked is distrusted. A host whose score, the part of distrust in
both ranks, is above a threshold is blocked. Host edges are the pages' links: those to other hosts, and those inside a
host, relative ones too. Hosts that no link ties to others also pass rank to the domain that they belong to and get it
from there, by one link a page, unless that domain is an IP address or a public suffix of two labels such as ``co.uk``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Part of the rank that follows edges, and rounds of propagation (what is left after these is DAMPING ** ROUNDS).
DAMPING, ROUNDS = 0.85, 20
#: A host is blocked whose part of distrust in its trust and distrust is above this.
THRESHOLD = 0.5
#: Second-level labels under which strangers register names, where the last label has two letters; fixed values.
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Weight of the tie between a host and its domain, in links, for each page of the host.
DOMAIN_TIE = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of a page, and those that name a host.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_NAMED = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(.*)"
#: Links that lead to no page.
_NOWHERE = r"(?i)^(?!(?:https?):)[a-z][a-z0-9+.-]*:(?!//)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a beginning of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as its name; null where none does. A short list: it is part of the plan."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of pages with host and html: links by number, and ties to domains of hosts without outer links.

    A port does not tell hosts apart in a domain. A host without any link has a loop, which keeps its rank.
    """
    read = pages.filter("host <> ''")
    own = read.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"))
    links = read.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link")).filter(~F.col("link").rlike(_NOWHERE))
    named = F.regexp_extract("link", _NAMED, 1)
    links = links.select("src", F.when(F.col("link").rlike(_NAMED), host_of(F.concat(F.lit("://"), named))).otherwise(F.col("src")).alias("dst")).filter("dst <> ''")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    outer = links.filter("src <> dst")
    tied = own.join(outer.select(F.col("src").alias("host")).union(outer.select(F.col("dst").alias("host"))).distinct(), "host", "left_anti")
    # From a host upwards to the domain of the last two labels, or three under a public suffix of two.
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    shared = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SHARED_LABELS)
    steps = F.size(labels) - F.when(shared, 3).otherwise(2)
    chain = tied.filter(~F.col("host").rlike(r"^[\d.]+(:\d*)?$|^\[") & (F.size(labels) >= 3)).filter(steps > 0)
    chain = chain.withColumn("up", F.explode(F.sequence(F.lit(0), steps - 1)))
    name = lambda skip: F.concat_ws(".", F.slice(labels, F.col("up") + 1 + skip, F.size(labels)))
    ties = chain.select(F.when(F.col("up") == 0, F.col("host")).otherwise(name(0)).alias("a"), name(1).alias("b"), (F.col("n") * DOMAIN_TIE).alias("weight"))
    ties = ties.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = ties.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(ties.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, weight) and seeds (host, trusted, blocked), both not negative.

    Ranks of each kind add up to 1 where that kind has a seed, else they are 0. A host without outgoing edges keeps its
    rank. All rounds are joins on hosts and sums, which are made before anything is shuffled; the lineage is cut every
    five rounds.
    """
    ways = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    kinds = hosts.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    stuck = kinds.join(ways.select("kind", F.col("src").alias("host")).distinct(), ["kind", "host"], "left_anti")
    ways = ways.unionByName(stuck.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")))
    total = ways.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    ways = cut(ways.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    sums = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = kinds.join(seeds, "host", "left")
    share = F.when(F.col("kind") == 0, F.coalesce("trusted", F.lit(0.0)) / float(sums["t"] or 1)).otherwise(F.coalesce("blocked", F.lit(0.0)) / float(sums["b"] or 1))
    rank = start = cut(start.select("kind", "host", share.cast("double").alias("seed"), share.cast("double").alias("rank")))
    for i in range(rounds):
        sent = ways.join(rank.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        got = sent.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("part") * F.col("rank")).alias("got"))
        rank = start.select("kind", "host", "seed").join(got, ["kind", "host"], "left")
        rank = rank.select("kind", "host", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Add host, path, rule, verdict, trust, distrust and host_score to pages with url and html; columns of these names are replaced.

    A rule decides where one fits; else the host's score does, distrust / (trust + distrust): above the threshold it
    blocks. Hosts that nothing reaches score 0 and, like urls without host, are allowed. Null urls and texts count as
    empty; rows stay as they are, under any column names. A host of any size is one row in the graph; joining the score
    back deals a hot host's pages out by adaptive skew handling.
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust", "host_score")
    kept = {c: f"_page_{i}" for i, c in enumerate(pages.columns) if c.lower() not in added}
    url = F.coalesce(F.col("url"), F.lit(""))
    read = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in kept.items()), "html", host_of(url).alias("host"), path_of(url).alias("path"))
    read = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    of_rule = F.lit(None).cast("string")
    for r in rules:
        of_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(of_rule)
    read = read.withColumn("said", of_rule)
    votes = lambda v: F.sum((F.col("said") == v).cast("double"))
    seeds = read.filter("host <> ''").groupBy("host").agg(F.coalesce(votes("allow"), F.lit(0.0)).alias("trusted"), F.coalesce(votes("block"), F.lit(0.0)).alias("blocked"))
    ranks = cut(propagate(cut(host_edges(read.select("host", "html"))), cut(seeds)))
    both = F.col("trust") + F.col("distrust")
    ranks = ranks.withColumn("host_score", F.when(both > 0, F.col("distrust") / both).otherwise(0.0))
    found = read.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust", "host_score"])
    found = found.withColumn("verdict", F.coalesce("said", F.when(F.col("host_score") > threshold, "block").otherwise("allow")))
    return found.select(*(F.col(n).alias(c) for c, n in kept.items()), *added)
