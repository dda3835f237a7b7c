"""Operator 7 against a plain walk and a plain pairing."""

import hashlib
import random

import numpy as np
import pytest

from streetgrid.llm import edit_fingerprint as ef
from streetgrid.llm.common import table
from streetgrid.llm.queries import near_fingerprints, op7_fingerprints


def one(text):
    return ef.fingerprints([ef._codes(text)])[0]


def plain_walk(classes):
    """Step by step, as the module's docstring has it."""
    steps = ef._steps().reshape(ef.PERIOD, ef.CLASSES) // ef.CLASSES
    at, out = 0, []
    for c in classes:
        at += steps[at % ef.PERIOD, c]
        out.append(at)
    return out


def test_walk_equals_plain_walk():
    rnd = random.Random(4)
    classes = [np.array([rnd.randrange(256) for _ in range(n)], dtype=np.int64) for n in (0, 1, 2, 3, 50, 50, 400, *range(5, 30))]
    assert [list(w) for w in ef.walk(classes)] == [plain_walk(c) for c in classes]
    assert ef.walk([]) == []


def test_positions_are_consistent():
    for p in ef._positions()[:8]:
        assert p[0] == 0 and (np.diff(p) > 0).all() and p[-1] >= 1 << 48


def test_likeness_falls_with_edits():
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(300))
    other = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(300))
    near = text[:700] + "x" + text[700:]
    like = [float((one(text) == one(t)).mean()) for t in (text, near, text[: len(text) // 2] + other[: len(text) // 2], other)]
    assert like[0] == 1 and like[1] > 0.6 and 0.2 < like[2] < 0.8 and like[3] < 0.2


def plain_groups(rows, least=52):
    """Every fingerprint against every other one."""
    ids, prints = [i for i, _ in rows], np.array([list(bytes.fromhex(p)) for _, p in rows])
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero((prints[i] == prints).sum(axis=1) >= least):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least_id = {g: min((i for i, h in zip(ids, group, strict=True) if h == g and i is not None), default=None) for g in set(group)}
    return {i: least_id[g] for i, g in zip(ids, group, strict=True) if i is not None}


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        t, u = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = one(t), one(e), one(u)
        out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=str)


def test_op7_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    want = expected(rows)
    assert sorted(map(tuple, op7_fingerprints(spark, sf_dir).collect()), key=str) == want
    assert dict(near_fingerprints(spark, sf_dir).collect()) == plain_groups([(r[0], r[3]) for r in want])


def test_odd_rows(spark):
    rows = [(5, "abc def"), (5, "abc"), (5, "abc"), (None, "no id"), (9, None), (-3, ""), (7, "é漢👩x" * 900), (8, "y")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, n_chars int")
    for partitions in (1, 3, 20):
        assert sorted(map(tuple, ef.against_next(docs, partitions).collect()), key=str) == expected(rows)
    assert ef.against_next(docs.limit(0)).count() == 0
    single = ef.against_next(docs.filter("doc_id = 8")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert ef.fingerprint(docs, name="n_chars").columns == ["text", "doc_id", "n_chars"]


def test_bands_link_near_and_equal_texts(spark):
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(200)) for _ in range(6)]
    rows = [*enumerate(texts), (10, texts[2]), (11, texts[3][:900] + "!" + texts[3][900:]), (12, None), (None, texts[0])]
    groups = {r["doc_id"]: r["group_id"] for r in ef.near_groups(ef.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert groups == {**{i: i for i in range(6)}, 10: 2, 11: 3, 12: 12}


def test_groups_lose_no_link_between_pages_of_a_template(spark):
    """Pages some 0.7 alike with pairs above 0.8 among them: most buckets hold fingerprints that are not near the least one."""
    rnd = random.Random(8)
    rows = []
    for _ in range(3):
        page = [rnd.randint(1, 128) for _ in range(64)]
        for _ in range(25):
            own = [x if rnd.random() < 0.8 else rnd.randint(1, 128) for x in page]
            for changed in (0, rnd.randint(8, 16)):
                at = set(rnd.sample(range(64), changed))
                rows.append((len(rows), bytes(rnd.randint(1, 128) if i in at else x for i, x in enumerate(own)).hex()))
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(None, rows[9][1]), (None, "00" * 64)]
    want = plain_groups(rows)
    assert 20 < len(set(want.values())) < 140
    frame = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for block in (2, 10_000):
        assert dict(ef.near_groups(frame, block=block).collect()) == want
    # Two fingerprints equal in 52 positions, with four others the least ones of the bands they share.
    a = bytes([5] * 52 + [7] * 12)
    b = bytes([5] * 52 + [9] * 12)
    least = [bytes([1] * (4 * k) + [5] * (52 - 4 * k) + [1] * 12) for k in range(10, 13)]
    pair = [(50, a.hex()), (40, b.hex()), *((i, p.hex()) for i, p in enumerate(least))]
    assert dict(ef.near_groups(spark.createDataFrame(pair, "doc_id long, fingerprint string")).collect()) == plain_groups(pair)


def test_groups_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "00" * 64), (3, None), (5, "05" * 64), (5, "06" * 64), (5, "05" * 64), (4, "05" * 64)], "doc_id long, fingerprint string")
    assert sorted(map(tuple, ef.near_groups(frame).collect())) == [(4, 4), (5, 4), (5, 4), (5, 5)]
    assert ef.near_groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ef.near_groups(frame, least=0.7)
