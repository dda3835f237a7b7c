"""Operator 10 against its definition, and the pipeline on small tables."""

import collections
import os
import sys

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from streetgrid.llm import mixing
from streetgrid.llm.common import table
from streetgrid.llm.queries import op10_mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.integers(0, 300))
def test_sainte_lague_gives_highest_quotients(votes, seats):
    got = mixing.sainte_lague(np.array(votes), seats)
    if not sum(votes):
        assert not got.any()
        return
    want = np.zeros(len(votes), int)
    for _ in range(seats):
        want[np.argmax(np.array(votes) / (2 * want + 1))] += 1
    assert got.sum() == seats and sorted(zip(votes, got)) == sorted(zip(votes, want)) or (got == want).all() or _tied(votes, got, want)


def _tied(votes, got, want):
    """Only seats of equal quotients may fall elsewhere."""
    moved = [(v / (2 * min(g, w) + 1)) for v, g, w in zip(votes, got, want, strict=True) if g != w]
    return max(moved) - min(moved) < 1e-6 * max(moved)


def test_targets_share_and_stop():
    sizes = pd.DataFrame({"source": ["b", None, "a", "c"], "source_size": [10, 1000, 100, 0]})
    t = mixing.targets(sizes)
    assert list(t["source"])[:3] == ["a", "b", "c"] and t["source"].isna().iloc[3]
    assert abs(t["target"].sum() - 1110) < 1e-6 and (t["target"] <= 3 * t["source_size"] + 1e-9).all()
    assert t["target"].iloc[0] == 300 and t["target"].iloc[1] == 30 and t["target"].iloc[2] == 0
    assert mixing.targets(sizes.assign(source_size=0))["target"].sum() == 0


def test_op10_query(spark, sf_dir):
    rows = op10_mixing(spark, sf_dir).toPandas()
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs)
    assert all(r.size_ == len((docs[r.doc_id]["text"] or "").encode().split()) for r in rows.rename(columns={"size": "size_"}).itertuples())
    assert (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] >= 0).all()
    rows["source"] = [docs[i]["source"] for i in rows["doc_id"]]
    by = rows.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["said"]).all() and ((by["taken"] - by["target"]).abs() <= mixing.BLOCK_WORDS).all()
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-3
    again = op10_mixing(spark, sf_dir).toPandas()
    assert dict(zip(rows["doc_id"], rows["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_odd_rows_and_small_shards(spark):
    rows = [(i, "w " * (i % 7), None if i % 3 == 0 else f"s{i % 3}") for i in range(200)] + [(5, "a b", "s2"), (5, "a b", "s2"), (None, "x y z", "s1"), (300, None, "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.with_sizes(docs)
    for shard in (16, 4096):
        out = mixing.mix(sized, shard_docs=shard, block_words=4).toPandas()
        assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
        by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
        assert ((by["taken"] - by["target"]).abs() <= 4 + 2).all()
    copies = mixing.mix_documents(docs.selectExpr("*", "1 AS taken"))
    assert copies.columns == ["doc_id", "text", "source", "taken"] and 0 < copies.count()
    clash = sized.selectExpr("*", "1 AS shards", "'q' AS quota", "7 AS shard", "2 AS seats", "3 AS Target", "'n' AS _source")
    mixed = mixing.mix(clash)
    assert mixed.columns == ["doc_id", "text", "source", "size", "shards", "quota", "shard", "seats", "_source", "source_size", "target", "taken"]
    assert mixed.select("shards", "quota", "shard", "seats", "_source").distinct().collect() == [(1, "q", 7, 2, "n")]
    assert mixing.mix(sized.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_pipeline_near_duplicates_and_mixing_by_brute_force(spark, sf_dir):
    """Kept are the documents that no chain of links leads to a smaller id; the mix copies each as often as rounding says."""
    sys.path.insert(0, os.path.dirname(__file__))
    from test_jaccard import brute

    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c, _ in brute(rows, 5, 80, 100) if i == c)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(mixing.with_sizes(docs)).collect()}
    copies = collections.Counter(r["doc_id"] for r in stages["mixing"](spark, docs, sf_dir).collect())
    assert copies == {i: int(t / n + 0.5) for i, (n, t) in taken.items() if n and int(t / n + 0.5)}


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 9000, "xx", None, -5), (None, "no id", "de", "s", 5), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs, sf_dir).count() <= 3 * len(odd)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(odd)


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        rows = out.cache()
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert all(before[r["doc_id"]] == r["text"] for r in rows.select("doc_id", "text").collect())
        docs = rows
    assert 0 < docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids.columns == ["doc_id", "source", "lang", "ids"] and ids.count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
