"""Approximate nearest neighbours by inner product (operator 1).

NN-descent: every vector starts with the best of some random-projection blocks; then, round by round, each vector's
neighbours and the vectors it is a neighbour of meet at it (a join), are scored against each other, and each keeps the
best it has met. Vectors travel as bytes with a scale. Queries walk the finished graph, both ways of each edge, greedily.
They enter it at a few vectors on their side of the random planes, never at themselves, so that any vector may ask. In
every round a query's best vectors that were not visited yet are joined with their neighbours; a query ends when its best
EF vectors have all been visited. What it found is scored anew on the original vectors in double precision.

Inner product is made a likeness of equal-length vectors by one more component, which the queries have as 0.
Equal vectors are one node of the graph, whatever their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, new_path

#: Neighbours of a node, edges that are joined the other way in a round (a sample by hash), and rounds.
NEIGHBOURS, REVERSED, ROUNDS = 24, 24, 3
#: Best of a local join that a member takes along from there.
TAKEN = 10
#: Random-projection partitions to start from, and vectors in a block of these, about.
TREES, BLOCK = 6, 256
#: Edges the other way that the finished graph keeps of a node, best first.
BACK = 48
#: Vectors that a query visits at least, that it visits in a round, and that are scored anew.
EF, VISITS, RESCORED = 240, 120, 64
#: Vectors where a query enters the graph, in each of TREES ways, and those for queries that find none there.
ENTRIES, ANYWHERE = 4, 8
_SEED = 11

_LISTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.FloatType()))])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as doubles) of the vectors that take part: id and components known and finite, not zero, usual length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0)).dropDuplicates(["vec_id"])


def _arrays(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of ``by`` from sorted batches, one for each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(by).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            if b > a:
                piece = batch.slice(a, b - a)
                if held and held[0].column(by)[0].as_py() != piece.column(by)[0].as_py():
                    yield _joined(held)
                    held = []
                held.append(piece)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _lists(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]), pa.int32())
    ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[1] for r in rows]), pa.int64()))
    scores = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[2] for r in rows]).astype(np.float32), pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, scores], names=_LISTS.names)


def _packed(nodes: DataFrame, longest: float) -> DataFrame:
    """node, the vector with its further component as bytes, and their scale."""

    def make():
        def work(v):
            x = np.array(v.to_pylist(), np.float64)
            extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1, keepdims=True), 0))
            x = np.hstack([x, extra]) / longest
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            return [pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale.astype(np.float32), pa.float32())]

        return work

    return add_columns(nodes, make, ["v"], [T.StructField("q", T.BinaryType()), T.StructField("scale", T.FloatType())], keep=["node"])


def _local_joins(rows: DataFrame) -> DataFrame:
    """From (place, node, q, scale, least): in each place all nodes are scored, each takes its best above its least along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _arrays(batches, "place"):
            node = g.column("node").to_numpy()
            node, first = np.unique(node, return_index=True)
            if len(node) < 2:
                continue
            x = _bytes(g.column("q"))[first] * g.column("scale").to_numpy()[first, None]
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            least = g.column("least").to_numpy()[first]
            k = min(TAKEN, len(node) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            for i, top in enumerate(best):
                found = s[i, top]
                better = found > least[i]
                if better.any():
                    out.append((node[i], node[top[better]], found[better]))
            if len(out) > 5000:
                yield _lists(out)
                out = []
        if out:
            yield _lists(out)

    return rows.select("place", "node", "q", "scale", "least").repartition("place").sortWithinPartitions("place").mapInArrow(run, _LISTS)


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each node's lists; ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _arrays(batches, "node"):
            ids = g.column("ids").flatten().to_numpy()
            scores = g.column("scores").flatten().to_numpy()
            ids, first = np.unique(ids, return_index=True)
            order = np.lexsort((ids, -scores[first]))[:most]
            out.append((g.column("node")[0].as_py(), ids[order], scores[first][order]))
            if len(out) > 2000:
                yield _lists(out)
                out = []
        if out:
            yield _lists(out)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, _LISTS)


def _coded(rows: DataFrame, dim: int, total: int, kind: type, keep: list[str]) -> DataFrame:
    """Add tree and code: the sides of random planes that ``q`` (raw numbers of ``kind``) lies on, in each of TREES ways."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / BLOCK))))
    planes = np.random.default_rng(_SEED).normal(size=(dim, TREES, max(1, bits))).astype(np.float32)

    def make():
        def work(q):
            x = np.frombuffer(b"".join(q.to_pylist()), kind).reshape(len(q), -1).astype(np.float32)
            side = np.einsum("nd,dtb->ntb", x, planes) > 0
            codes = (side @ (1 << np.arange(max(1, bits)))) if bits else np.zeros((len(q), TREES), np.int64)
            return [pa.array(codes.tolist(), pa.list_(pa.int64()))]

        return work

    coded = add_columns(rows, make, ["q"], [T.StructField("codes", T.ArrayType(T.LongType()))])
    return coded.select(*keep, F.posexplode("codes").alias("tree", "code"))


def _first_places(packed: DataFrame, dim: int, total: int) -> DataFrame:
    """(place, node, q, scale, least) of blocks of vectors on one side of some random planes, in each of TREES ways."""
    coded = _coded(packed, dim, total, np.int8, ["node", "q", "scale"])
    sizes = coded.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("n"))
    # A code that many vectors share is split at random.
    split = coded.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (2 * BLOCK))))
    return split.select(F.xxhash64("tree", "code", "part").alias("place"), "node", "q", "scale", F.lit(float("-inf")).cast("float").alias("least"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.scores").alias("score"))


def _best_back(edges: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(node, to, score) of edges turned round, ``most`` of each node."""
    turned = edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "score")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(*order))
    return turned.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def build_graph(packed: DataFrame, dim: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, ids, scores): NN-descent on (node, q, scale)."""
    graph = cut(_merged(_local_joins(_first_places(packed, dim, total)), NEIGHBOURS))
    for i in range(rounds):
        edges = _edges(graph)
        back = _best_back(edges, [F.xxhash64("node", "to", F.lit(i))], REVERSED)
        meet = edges.select(F.col("node").alias("place"), F.col("to").alias("node")).unionByName(back.select(F.col("node").alias("place"), F.col("to").alias("node")))
        meet = meet.unionByName(graph.select(F.col("node").alias("place"), "node"))
        least = F.when(F.size("scores") >= NEIGHBOURS, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        carried = packed.join(graph.select("node", least.alias("least")), "node", "left").fillna(float("-inf"), ["least"])
        graph = cut(_merged(graph.unionByName(_local_joins(meet.join(carried, "node"))), NEIGHBOURS))
    return graph


def _with_vectors(graph: DataFrame, packed: DataFrame) -> DataFrame:
    """node, ids of its neighbours both ways, their bytes one after the other and their scales."""
    edges = _edges(graph)
    both = edges.unionByName(_best_back(edges, [F.desc("score"), F.col("to")], BACK)).select("node", "to").distinct()
    both = both.join(packed.withColumnRenamed("node", "to"), "to")
    lists = both.groupBy("node").agg(F.collect_list(F.struct("to", "q", "scale")).alias("l"))
    return lists.select("node", F.col("l.to").alias("ids"), F.col("l.q").alias("qs"), F.col("l.scale").alias("scales"))


_STATE = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("q", T.BinaryType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("scores", T.ArrayType(T.FloatType())),
        T.StructField("visited", T.ArrayType(T.BooleanType())),
    ]
)


def _visit(frontier: DataFrame, table: str) -> DataFrame:
    """From (query_id, q, least, node): the neighbours of each node that are better than the query's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            least = batch.column("least").to_numpy(zero_copy_only=False)
            for i, query in enumerate(batch.column("query_id").to_pylist()):
                q = np.frombuffer(batch.column("q")[i].as_py(), np.float32)
                x = _bytes(batch.column("qs")[i].values)
                s = (x @ q) * batch.column("scales")[i].values.to_numpy()
                better = s > least[i]
                if better.any():
                    out.append((query, batch.column("ids")[i].values.to_numpy()[better], s[better]))
            if out:
                yield _lists(out)

    joined = frontier.join(frontier.sparkSession.table(table), "node")
    return joined.select("query_id", "q", "least", "ids", "qs", "scales").mapInArrow(run, _LISTS).withColumnRenamed("node", "query_id")


def _gathered(state: DataFrame, found: DataFrame, ef: int) -> DataFrame:
    """The ``ef`` best of what each query had and has found, with what it has visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _arrays(batches, "query_id"):
            own = next(i for i, q in enumerate(g.column("q").to_pylist()) if q is not None)
            ids = g.column("ids").flatten().to_numpy()
            scores = g.column("scores").flatten().to_numpy()
            known = g.column("visited")
            visited = np.concatenate([np.array(v.as_py() or [False] * len(i), bool) for v, i in zip(known, g.column("ids"), strict=True)])
            order = np.lexsort((~visited, ids))
            ids, scores, visited = ids[order], scores[order], visited[order]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            ids, scores, visited = ids[first], scores[first], visited[first]
            top = np.lexsort((ids, -scores))[:ef]
            yield pa.RecordBatch.from_arrays([pa.array([g.column("query_id")[0].as_py()], pa.int64()), pa.array([g.column("q")[own].as_py()], pa.binary()), pa.array([ids[top]], pa.list_(pa.int64())), pa.array([scores[top]], pa.list_(pa.float32())), pa.array([visited[top]], pa.list_(pa.bool_()))], names=_STATE.names)

    both = state.unionByName(found.select("query_id", F.lit(None).cast("binary").alias("q"), "ids", "scores", F.lit(None).cast("array<boolean>").alias("visited")))
    return both.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, _STATE)


def _starts(asked: DataFrame, packed: DataFrame, dim: int, total: int) -> DataFrame:
    """The first state of queries (query_id, q, node): scored vectors of other nodes on their side of the planes."""
    coded = _coded(packed, dim, total, np.int8, ["node"])
    first = F.row_number().over(Window.partitionBy("tree", "code").orderBy(F.xxhash64("node", F.lit(_SEED))))
    doors = coded.withColumn("r", first).filter(F.col("r") <= ENTRIES).select("tree", "code", F.col("node").alias("door"))
    anywhere = [r["node"] for r in packed.select("node").orderBy(F.xxhash64("node"), "node").limit(ANYWHERE).collect()]
    near = _coded(asked, dim, total, np.float32, ["query_id", "node"]).join(doors, ["tree", "code"]).select("query_id", "node", "door")
    far = asked.select("query_id", "node", F.explode(F.array(*map(F.lit, anywhere))).alias("door"))
    chosen = near.unionByName(far).filter("door <> node").select("query_id", "door").distinct()
    met = chosen.join(packed.select(F.col("node").alias("door"), F.col("q").alias("x"), "scale"), "door").join(asked.select("query_id", "q"), "query_id")

    def make():
        def work(q, x, scale):
            own = np.frombuffer(b"".join(q.to_pylist()), np.float32).reshape(len(q), -1)
            return [pa.array((own * _bytes(x)).sum(axis=1) * scale.to_numpy(), pa.float32())]

        return work

    scored = add_columns(met, make, ["q", "x", "scale"], [T.StructField("score", T.FloatType())], keep=["query_id", "q", "door"])
    lists = scored.groupBy("query_id").agg(F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("score", "door")), asc=False).alias("l"))
    # A query that is alone has nothing to start from.
    return lists.select("query_id", "q", F.col("l.door").alias("ids"), F.col("l.score").alias("scores"), F.transform("l", lambda _: F.lit(False)).alias("visited"))


def _walk(state: DataFrame, table: str, ef: int, visits: int) -> DataFrame:
    """Greedy search from states as ``_starts`` gives: each query's best nodes, (query_id, ids)."""
    while True:
        # The best that were not visited yet; these are marked as visited before their neighbours are looked at.
        turn = F.slice(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.get("visited", i)), 1, visits)
        state = cut(state.withColumn("turn", turn))
        if state.filter(F.size("turn") > 0).isEmpty():
            return state.select("query_id", "ids")
        least = F.when(F.size("scores") >= ef, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        frontier = state.select("query_id", "q", least.alias("least"), F.explode(F.transform("turn", lambda i: F.get("ids", i))).alias("node"))
        marked = F.transform("visited", lambda v, i: v | F.array_contains("turn", i))
        state = _gathered(state.withColumn("visited", marked).drop("turn"), _visit(frontier, table), ef)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, ef: int = EF, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double precision) of the ``k`` nearest found.

    ``vectors`` has vec_id and embedding; those for which ``queries`` holds are also queries, never among their own
    results. Fewer than ``k`` candidates: all of them. Ties go to the smaller id. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part; rows repeated under one id count once; further
    columns are ignored. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors).withColumn("query", F.coalesce(queries, F.lit(False))))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("node"))
    nodes = cut(classes)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = nodes.agg(F.max(F.sqrt(norm)).alias("longest"), F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if shape["d"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = shape["longest"]
    packed = cut(_packed(nodes, longest))
    dim, total = shape["d"] + 1, shape["n"]
    asked = cut(rows.filter("query").join(nodes, "v").select(F.col("vec_id").alias("query_id"), "v", "node"))
    scaled = F.concat(F.transform("v", lambda x: (x / longest).cast("float")), F.array(F.lit(0.0).cast("float")))
    as_bytes = add_columns(asked.withColumn("f", scaled), lambda: lambda f: [pa.array([np.array(x, np.float32).tobytes() for x in f.to_pylist()], pa.binary())], ["f"], [T.StructField("q", T.BinaryType())], keep=["query_id", "node"])

    graph = build_graph(packed, dim, total, rounds)
    # The neighbours' vectors are dealt by node once, in the shared folder, so that a round of the walk only deals queries.
    name, parts = f"neighbours_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _with_vectors(graph, packed).repartition(parts, "node").write.bucketBy(parts, "node").sortBy("node")
    try:
        dealt.option("path", new_path(spark, name)).saveAsTable(name)
        found = _walk(_starts(as_bytes, packed, dim, total), name, ef, VISITS)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    # The query's own node holds its exact copies, so it is always scored anew.
    best = F.array_union(F.coalesce(F.slice("ids", 1, RESCORED + k), F.array().cast("array<long>")), F.array("node"))
    pairs = asked.select("query_id", "node").join(found, "query_id", "left").select("query_id", F.explode(best).alias("node"))
    pairs = pairs.join(nodes.withColumnRenamed("v", "x"), "node").join(asked.select("query_id", "v"), "query_id")
    product = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    scored = pairs.select("query_id", "node", product.alias("score"))
    # A node stands for equal vectors; of these the k + 1 smallest ids can be among the results.
    members = rows.withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r").join(nodes, "v").select("node", "vec_id")
    each = scored.join(members, "node").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
