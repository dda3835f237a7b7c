"""Operator 9 and components against brute force."""

import random
import re
import time

import pytest

from streetgrid.llm import components as graph
from streetgrid.llm import jaccard
from streetgrid.llm.common import table
from streetgrid.llm.components import components
from streetgrid.llm.queries import op9_ngram_jaccard


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), None if i is None else least[find(a)], links[a]) for a, (i, s) in enumerate(sets)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op9_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert found(op9_ngram_jaccard(spark, sf_dir)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("rare", [3, 32])
def test_random_edits_ties_and_blocks(spark, monkeypatch, rare):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "RARE", rare)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([3, 12, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(90):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i * 3, (" " * rnd.randint(1, 2)).join(text).upper() if i % 5 == 0 else "\t".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, num = (3, 90) if rare == 3 else (5, 80)
    assert found(jaccard.similarity_join(docs, words, num, 100)) == brute(rows, words, num, 100)


def test_few_long_texts_in_one_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    rows = []
    for pair in range(12):
        text = [f"p{pair}w{i}" for i in range(200)]
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join([*text, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.similarity_join(docs, 3, 90, 100)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("rare", [3, 32])
def test_one_percolated_part(spark, monkeypatch, rare):
    """Every text shares frequent lines with the next ones, so that frequent tokens reach from each text to all."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "RARE", rare)
    rnd = random.Random(3)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(24)]
    rows = []
    for i in range(120):
        k = i % 20
        text = " ".join(lines[k : k + rnd.choice([1, 2, 3, 4])])
        if rnd.random() < 0.5:
            text += f" own{rnd.randrange(40)}"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard._with_parts(jaccard._prefixes(jaccard._summaries(docs, 3, 90, 100).filter("key is not null"), 90, 100))
    assert rare > 3 or sets.filter("part0 is not null").select("part0").distinct().count() < 20
    words, num = (3, 90) if rare == 3 else (5, 80)
    assert found(jaccard.similarity_join(docs, words, num, 100)) == brute(rows, words, num, 100)


def test_odd_rows(spark):
    same = "a b c d e f g"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X"), (6, "x y"), (7, same), (7, same), (8, same + " h"), (None, same), (9, "é " * 50), (10, "w " * 4000)]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, component_id int, key string")
    assert found(jaccard.similarity_join(docs, 3, 90, 100)) == brute(rows, 3, 90, 100)
    kept = jaccard.keep_one(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)] + [(True, 0)]
    assert jaccard.similarity_join(docs.limit(0)).count() == 0


def test_components_leave_no_shuffle_files(spark):
    """Neither the files of earlier steps nor the setting that removes them outlive a call."""
    files = lambda: {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)], "u long, v long")
    before = files()
    out = components(edges)
    end = time.time() + 20
    while files() - before and time.time() < end:  # files are removed in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert out.count() == 41 and out.count() == 41


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (8, 7), (None, 4), *((i, i + 1) for i in range(100, 140)), *((500, i) for i in range(501, 540))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 540), 500)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_by_steps_and_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    edges = [(rng.randrange(3), rng.randrange(400), rng.randrange(400)) for _ in range(500)]
    root = {(k, i): i for k, u, v in edges for i in (u, v)}
    for _ in range(400):
        for k, u, v in edges:
            root[k, u] = root[k, v] = min(root[k, u], root[k, v])
    found = components(spark.createDataFrame(edges, "kind int, u long, v long"), by=("kind",))
    assert found.dtypes == [("kind", "int"), ("node", "bigint"), ("component", "bigint")]
    rows = [((r["kind"], r["node"]), r["component"]) for r in found.collect()]
    assert len(rows) == len(root) and dict(rows) == root


def test_few_edges_take_few_jobs(spark):
    """Each step is a plan and some jobs that the driver holds; a small graph needs no step."""
    spark.sparkContext.setJobGroup("few-edges", "few edges")
    try:
        assert components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")).count() == 301
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 6
    finally:
        spark.sparkContext._jsc.clearJobGroup()
