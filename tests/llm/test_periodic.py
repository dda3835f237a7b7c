"""Operator 11 against a brute-force search for runs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from streetgrid.llm import periodic, queries


def lyndon(x):
    n = len(x)
    return [max(j - i for j in range(i + 1, n + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(n)]


def runs(x, min_words, min_times):
    """All runs, period by period."""
    found = []
    for q in range(1, len(x) // min_times + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(x[k] == x[k + d] for k in range(s, s + length - d)) for d in range(1, q))
            if i > s and length >= max(min_words, min_times * q) and not smaller:
                found.append((s, length, q))
            i = max(i, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = runs(words, 24, 3)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(left))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_lyndon_lengths(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        x = [rnd.randrange(letters) for _ in range(rnd.randint(1, 30))]
        assert periodic.lyndon_lengths(x) == lyndon(x)


@pytest.mark.parametrize("bounds", [(24, 3), (4, 2), (7, 2), (9, 3), (12, 5)])
def test_runs_of(bounds):
    rnd = random.Random(7)
    for _ in range(200):
        x, letters = [], rnd.randint(1, 4)
        while len(x) < 70:
            part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
            x += part * rnd.choice([1, 1, 2, 3, 6])
        assert [tuple(r) for r in periodic.runs_of(np.array(x), *bounds).tolist()] == runs(x, *bounds)


def test_odd_rows(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (2, "", "x"),
        (None, "a b " * 20, "x"),
        (3, "  lone\tword\n", "x"),
        (4, "z z " * 30 + "end", "x"),
        (5, "a b c " * 9 + "q " + "d e " * 20, None),
        (6, "w " * 23, "x"),
        (7, "w " * 24, "x"),
        (8, " ".join(f"w{i}" for i in range(40_000)) + " r s t" * 3000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = {r["doc_id"]: r for r in periodic.collapse_runs(docs).collect()}
    assert periodic.collapse_runs(docs).count() == len(rows)
    assert [c for c in periodic.collapse_runs(docs).columns] == ["doc_id", "text", "runs", "collapsed"]
    assert found[1]["runs"] == [] and found[1]["collapsed"] == "" and found[3]["collapsed"] == "lone word"
    assert [tuple(r) for r in found[None]["runs"]] == [(0, 40, 2)] and found[None]["collapsed"] == "a b"
    assert found[4]["collapsed"] == "z z end"
    assert [tuple(r) for r in found[5]["runs"]] == [(0, 27, 3), (28, 40, 2)] and found[5]["collapsed"] == "a b c q d e"
    assert found[6]["runs"] == [] and [tuple(r) for r in found[7]["runs"]] == [(0, 24, 1)]
    assert [tuple(r) for r in found[8]["runs"]] == [(40_000, 9000, 3)]
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, 24, 1)


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 5, 30, 60, 150]))) for _ in range(900)]
    texts += ["a b c d e f g h " * 5 + "tail " * 30, None, "x y " * 30 + " ".join("pqrst") + " z" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: expected(i, t) for i, t in enumerate(texts)}
    assert found[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    assert sum(r["n_runs"] > 0 for r in found) > 15
