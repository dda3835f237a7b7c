"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 10).

Blocks of equal words go to sources by highest quotients, then in each source to its shards, so that every shard has an
integer quota. A shard takes its quota in a seeded order of its documents: whole rounds first, then the blocks at the
beginning of that order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Words in a block.
BLOCK_WORDS = 64
#: Documents in a shard, about; a source has as many shards as it needs.
SHARD_DOCS = 4096
#: Weights by source in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source and no document is taken more often.
MOST_TIMES = 3
#: A word: what is not a blank, a tab or a line end.
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); ties go to the first. No votes, no seats."""
    votes = np.asarray(votes, dtype=np.float64)
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not votes.sum() > 0:
        return got
    low, high = 0.0, 2.0 * votes.max() + 1.0  # divisors: too many seats at low, none at high
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if np.floor(votes / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    got = np.floor(votes / high + 0.5).astype(np.int64)
    # What is left are ties at this divisor, to rounding: one seat each, by quotient.
    left = int(seats - got.sum())
    while left > 0:
        best = np.argsort(-votes / (2 * got + 1), kind="stable")[: min(left, int((votes > 0).sum()))]
        tied = best[votes[best] / (2 * got[best] + 1) >= votes[best[0]] / (2 * got[best[0]] + 1) * (1 - 1e-12)]
        got[tied] += 1
        left -= len(tied)
    return got


def targets(sizes: pd.DataFrame, weights: tuple[float, ...] = WEIGHTS) -> pd.DataFrame:
    """One row for each source (source, source_size, docs) with its target: by weight, at most MOST_TIMES its size, the rest reshared."""
    order = sizes.assign(_null=sizes["source"].isna(), _key=[(s or "").encode("utf-8", "surrogatepass") if isinstance(s, str) else b"" for s in sizes["source"]])
    order = order.sort_values(["_null", "_key"], kind="stable").drop(columns=["_null", "_key"]).reset_index(drop=True)
    size = order["source_size"].to_numpy(np.float64)
    weight = np.resize(np.asarray(weights, dtype=np.float64), len(order))
    most, total = MOST_TIMES * size, size.sum()
    target, full = np.zeros(len(order)), np.zeros(len(order), dtype=bool)
    while total > 0:
        target = np.where(full, most, 0.0)
        target[~full] = (total - most[full].sum()) * weight[~full] / weight[~full].sum()
        above = ~full & (target > most)
        if not above.any():
            break
        full |= above
    return order.assign(target=target)


def with_sizes(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """Add the number of words of the whole text; 0 for null and empty ones."""
    return docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, measured: DataFrame | None = None) -> DataFrame:
    """Add source_size, target and taken to documents with doc_id, source and size.

    A null source is a source, the last one. Documents without words, and sources without such documents, take nothing;
    repeated rows are documents of their own. An empty table stays empty. Columns that are called as an added one are
    replaced; others may have any name. ``measured`` may give (doc_id, source, size) of
    the same rows where these are cheaper to read. One row for each source and for each shard of some thousand documents
    is gathered; documents are only sorted inside their shards.
    """
    base = (docs if measured is None else measured).select("doc_id", "source", "size")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        out = targets(pdf, weights)
        out["seats"] = sainte_lague(out["target"].to_numpy(), int(round(out["target"].sum() / block_words)))
        out["shards"] = np.maximum(1, -(-out["docs"] // shard_docs))
        return out[["source", "source_size", "target", "seats", "shards"]]

    # All sources meet in one group: a row each.
    sources = cut(per_source.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(lambda pdf: shares(pdf), "source string, source_size long, target double, seats long, shards long"))

    def placed(df: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "_source")
        joined = df.join(s, df["source"].eqNullSafe(s["_source"]), "left").drop("_source")
        # Repeated and null ids are dealt out by their sizes as well.
        return joined.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("shards")))

    per_shard = placed(base).groupBy("source", "shard", "seats", "target", "source_size").agg(F.sum("size").alias("shard_size"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", kind="stable")
        size = pdf["shard_size"].to_numpy()
        most, seats = MOST_TIMES * size, int(pdf["seats"].iloc[0])
        quota, full = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        while True:
            # What a full shard cannot take is dealt to the others.
            quota[~full] = sainte_lague(size[~full], seats - int(-(-most[full].sum() // block_words))) * block_words
            over = ~full & (quota > most)
            quota[over], full = most[over], full | over
            if not over.any():
                break
        return pd.DataFrame({"_source": pdf["source"], "_shard": pdf["shard"], "shard_size": pdf["shard_size"], "quota": quota})

    by_shard = cut(per_shard.groupBy("source").applyInPandas(quotas, "_source string, _shard long, shard_size long, quota long"))
    # Under names of their own, whatever the documents' columns are called.
    given = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    rows = placed(docs.select("doc_id", "source", "size", *(F.col(f"`{c}`").alias(n) for c, n in given.items())))
    rows = rows.join(by_shard, rows["source"].eqNullSafe(by_shard["_source"]) & (rows["shard"] == by_shard["_shard"]), "left")
    order = Window.partitionBy("_source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = F.coalesce(F.floor(F.col("quota") / F.when(F.col("shard_size") > 0, F.col("shard_size"))), F.lit(0))
    rest = F.coalesce(F.col("quota"), F.lit(0)) - rounds * F.col("shard_size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    out = rows.withColumn("taken", (rounds * F.col("size") + part).cast("long"))
    added = ("source_size", "target", "taken")
    return out.select(*(F.col(n).alias(c) for c, n in given.items() if c.lower() not in added), *added)


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, rounded to whole copies. Columns stay."""
    sized = with_sizes(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c in ("size", "source_size", "target", "taken")}))
    measured = cut(sized.select("doc_id", "source", "size"))
    mixed = mix(sized, seed, measured=measured)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))
    rows = mixed.filter((F.col("size") > 0) & (copies > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return rows.select(*(F.col(f"_{c}" if c in ("size", "source_size", "target", "taken") else c).alias(c) for c in docs.columns))
