"""Operators 2 and 8 by held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.llm import quality, toxicity
from streetgrid.llm.common import table
from streetgrid.llm.labelled import first_of_each
from streetgrid.llm.queries import op2_quality, op8_toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 9000, "xx", None, -5), (None, "no id", "de", "s", 5), (2, "", "en", "s", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def labels(spark):
    return {r["doc_id"]: r for r in table(spark, LARGER, "labels").collect()}


def test_op2_query_on_held_out_rows(spark):
    known = labels(spark)
    rows = {r["doc_id"]: r for r in op2_quality(spark, LARGER).collect()}
    assert len(rows) == table(spark, LARGER, "documents").count()
    out = [i for i in known if i in rows and zlib.crc32(str(i).encode()) % 3 == 1]
    good = [rows[i]["kept"] for i in out if known[i]["quality"] == 1]
    bad = [rows[i]["kept"] for i in out if known[i]["quality"] == 0]
    assert len(bad) > 150 and np.mean(good) >= 0.98 and np.mean(bad) <= 0.02
    assert all(0 <= r[c] <= 1 for r in rows.values() for c in quality.SCORES)


def test_co_training_helps_a_weak_view_and_harms_none():
    rng = np.random.default_rng(0)
    y = (np.arange(2400) % 3 > 0).astype(int)
    strong = rng.normal(0, 0.3, (2400, 5)) + 2 * y[:, None]
    weak = rng.normal(0, 1, (2400, 40)) + 0.25 * y[:, None]
    work = quality.CoTraining((strong, weak), y, share=0.7)
    before = [work._loss(v, work.models[v]) for v in (0, 1)]
    assert work.cut(0, 1) is not None and work.cut(1, 0) is None  # the weak view gives nothing
    more = (np.arange(900) % 3 > 0).astype(int)
    work.add(1, rng.normal(0, 1, (900, 40)) + 0.25 * more[:, None], more)
    assert work._loss(1, work.models[1]) < before[1]
    work.add(0, rng.normal(0, 0.3, (900, 5)), more)  # labels that tell nothing
    assert work._loss(0, work.models[0]) == before[0]
    assert quality.CoTraining((strong, weak), y, share=0.7).finish().scores(strong[:6], weak[:6])[2].round().tolist() == y[:6].tolist()


def test_ids_that_repeat_with_other_texts(spark):
    """Where an id stands for several texts, the one with the least hash is learned, every time."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(30)], "doc_id long, text string").repartition(5)
    ids = spark.createDataFrame([(0,), (2,), (7,)], "doc_id long")
    first = sorted(first_of_each(docs, ids, ["text"]).collect())
    assert [r["doc_id"] for r in first] == [0, 2] and first == sorted(first_of_each(docs.repartition(2), ids, ["text"]).collect())


def test_quality_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(*r, 1.0) for r in ODD], SCHEMA + ", p_text double")
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert quality.score(docs, model).count() == len(ODD)
    assert quality.keep_good(docs, table(spark, SF, "labels").filter("quality = 1")).columns == docs.columns
    assert quality.keep_good(docs, table(spark, SF, "labels").limit(0)).count() == len(ODD)
    assert quality.score(docs.limit(0), model).count() == 0


def test_rounds_read_whole_texts_once(spark, monkeypatch):
    """A further round reads the documents that it fetches, not every text again."""
    monkeypatch.setattr(quality.CoTraining, "_loss", lambda *_: 0.0)  # what a view gets never makes it worse
    n, rng = 2400, np.random.default_rng(0)
    y = (np.arange(n) % 2).tolist()
    rows = [(i, ("good plain words " if y[i] else "BAD 123 !!! ") * 20 + f"w{i}", "en", ("s", "t")[y[i] ^ int(rng.random() < 0.2)], 100 + i % 7) for i in range(n)]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).withColumn("text", F.udf(seen, "string")("text"))
    marks = spark.createDataFrame([(i, y[i]) for i in range(1800)], "doc_id long, quality int")
    reads, models = [], []
    for rounds in (0, 1, 2):
        before = read.value
        models.append(quality.train(docs, marks, rounds=rounds))
        reads.append(read.value - before)
    weights = [m.metadata.weights.tolist() for m in models]
    assert weights[2] != weights[1] != weights[0]
    assert reads[1] > reads[0] and reads[2] - reads[1] <= n


def test_op8_query_on_held_out_rows(spark):
    """Of the toxic documents in these labels, 26 of 279 English ones hold none of the words that mark the others."""
    known = labels(spark)
    rows = {r["doc_id"]: r for r in op8_toxicity(spark, LARGER).collect()}
    assert len(rows) == table(spark, LARGER, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    out = [i for i in known if i in rows and rows[i]["held_out"]]
    toxic, clean = ([rows[i]["predicted"] for i in out if known[i]["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 100 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.025


def hashed(texts):
    words = toxicity.Words()
    return [words.units_of(n[n >= 0]) for n in words(texts)]


def scores(net, texts):
    words = toxicity.Words()
    rows = words(texts)
    return net.scores(net.logits(rows, words.units_of(np.arange(len(words._units)))), np.full(len(texts), len(toxicity.MARKERS)))


def test_toxicity_learns_words_and_generalises():
    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(300)]

    def text(bad):
        w = list(rng.choice(common, 60))
        if bad:
            w[int(rng.integers(60))] = "Zabadak" + rng.choice(["", "s", "en"])
        return " ".join(w)

    y = (np.arange(900) % 3 == 0).astype(int)
    made, other = hashed([text(b) for b in y]), np.full(900, len(toxicity.MARKERS))
    new = [text(True) for _ in range(100)], [text(False) for _ in range(100)]
    caught = lambda net: [(scores(net, t) >= 0.7).mean() for t in new]
    toxic, clean = caught(toxicity.fit(made, y, other))
    assert toxic > 0.95 and clean < 0.05
    toxic, clean = caught(toxicity.fit(made, y, other, soft=(), hard=0))  # not trained: the random net knows nothing
    assert toxic - clean < 0.3


def test_toxicity_one_class_and_odd_rows(spark):
    net = toxicity.fit(hashed(["a b", "c"]), np.array([0, 0]), np.array([4, 4]))
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS score")
    scored = toxicity.score(docs, net)
    assert scored.columns == [*docs.columns] and all(r["score"] < 0.7 for r in scored.collect())
    none = table(spark, SF, "labels").limit(0)
    assert toxicity.keep_clean(docs, none).count() == len(ODD)
    assert toxicity.fit([], np.zeros(0, int), np.zeros(0, int)).offset == -1.0
    assert len(scores(net, ["", " \n", "x " * 5000])) == 3


@pytest.mark.parametrize("text,expected", [("the cat and the dog", 0), ("der die das und", 1), ("", 4)])
def test_language(text, expected):
    words = toxicity.Words()
    assert words.language(words([text])[0]) == expected
