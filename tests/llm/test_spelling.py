"""Operator 12 against a brute-force comparison of all words."""

import re
import zlib
from collections import Counter

import pytest

from streetgrid.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near, form = {}, {}
    for w, n in words.items():
        near[w] = [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


ROWS = [
    (1, "Station " * 500 + "statiom " * 30 + "statioms statioms"),
    (2, "stations " * 40 + "stationss aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa aaaaaaaaa"),
    (2, "stations " * 40 + "Étation étation étation Étation shørter中station"),
    (3, None),
    (4, ""),
    (5, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999 + " naivély naïvely naïvely"),
    (9, "chainaaa " * 5000 + "chaincaa " * 400 + "chaincca " * 35 + "chainccc " * 3),
    (6, "bxxxxxx axxxxxx " * 30 + "cxxxxxx cxxxxxx"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "w") for i, t in ROWS], "doc_id long, text string, word string")
    assert found(spelling.variants(docs)) == expected(ROWS)
    rows = {r[0]: r for r in expected(ROWS)}
    assert rows["statiom"][1] == "station"
    assert rows["chainccc"][1:3] == ("chaincca", "chainaaa")
    assert rows["cxxxxxx"][1] == "axxxxxx"
    assert spelling.variants(docs.limit(0)).count() == 0
    assert found(spelling.variants(docs.filter("doc_id = 3"))) == []
    unnamed = spark.createDataFrame([(None, "letters letters")], "doc_id long, text string")
    assert [r[3] for r in found(spelling.variants(unnamed))] == [2]


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, sf_dir, monkeypatch, small):
    """With small filters, the vocabulary takes many broadcasts and has false positives."""
    if small:
        monkeypatch.setattr(spelling, "SLICES", 3)
        monkeypatch.setattr(spelling, "WORD_BITS", 4096)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(docs)
    assert found(queries.op12_spelling(spark, sf_dir)) == want
    assert len(want) > 1000 and sum(r[4] > 0 for r in want) > 100


def test_false_positives_end_in_the_join(spark, monkeypatch):
    monkeypatch.setattr(spelling.Filters, "holds", lambda self, h, length: h == h)
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string")
    assert found(spelling.variants(docs)) == expected(ROWS[:3])
