"""Operator 1: recall against brute force, exact scores, odd rows."""

import numpy as np

from pyspark.sql import functions as F
from streetgrid.llm import neighbours
from streetgrid.llm.common import table
from streetgrid.llm.queries import op1_neighbours


def test_op1_query(spark, sf_dir):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, sf_dir, "embeddings").collect()}
    ids, x = np.array(sorted(vectors)), np.array([vectors[i] for i in sorted(vectors)])
    rows = op1_neighbours(spark, sf_dir).collect()
    hits = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r["vec_id"] for r in own}
        s = x @ vectors[q]
        assert all(abs(r["score"] - vectors[r["vec_id"]] @ vectors[q]) < 1e-9 for r in own)
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        s[ids == q] = -np.inf
        hits += len({r["vec_id"] for r in own} & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hits >= 0.9 * len(rows)


def test_odd_vectors_copies_and_few_candidates(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0], 1), (40, [0.0, 2.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [3.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [1.0], 1), (60, [-1.0, -1.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    by = {q: [(r["vec_id"], round(r["score"], 6)) for r in got if r["query_id"] == q] for q in (20, 40, 60)}
    assert by[20] == [(3, 3.0), (1, 1.0), (2, 1.0), (40, 0.0)]
    assert by[40] == [(3, 2.0), (1, 0.0), (2, 0.0), (20, 0.0)]
    assert by[60] == [(1, -1.0), (2, -1.0), (20, -1.0), (40, -2.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = neighbours.nearest(df.filter("vec_id = 40"), F.lit(True))
    assert alone.count() == 0


def test_exact_copies_of_queries_are_found(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Group g of copies starts at id 20 * g, which is a query; the other ids of a group are never queries.
    sizes = [2, 3, 21, 60, 1000]
    vectors = {20 * g: x[g] for g in range(len(x))}
    other = iter(i for i in range(100_000) if i % 20)
    for g, size in enumerate(sizes):
        vectors |= {next(other): x[g] for _ in range(size - 1)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 20 * 40), k=20).collect()
    ids = np.array(sorted(vectors))
    all_x = np.array([vectors[i] for i in ids])
    hits = 0
    for g in range(40):
        own = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 20 * g), key=lambda r: r["rank"])]
        s = all_x @ x[g]
        s[ids == 20 * g] = -np.inf
        hits += len(set(own) & set(ids[np.lexsort((ids, -np.round(s, 12)))[:20]]))
        if g < len(sizes):
            copies = [i for i in ids if i != 20 * g and np.array_equal(vectors[i], x[g])]
            assert own[: len(copies)] == copies[:20]
    assert len(got) == 800 and hits >= 0.95 * 800
