"""Operators 3 to 5 against the libraries' own results."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from streetgrid.llm import bpe, token_files, unigram
from streetgrid.llm.common import new_path, table
from streetgrid.llm.queries import PIECES, WORD_BPE, op3_bpe, op4_token_counts, op5_token_files

ODD = ["", " ", "don't STOP i'll we'RE", "a<|endoftext|>b <|startoftext|>", "İSTANBUL ΣΑΣ ß ﬁ é ́x 漢字 👩‍👩‍👧 ١٢٣ \x1c a b\tc\r\nd   e", "aaaaaaaaaa hahaha ...... 1234", "x" * 3000, None]
SCHEMA = "doc_id long, text string, ids string, IDS_CRC32 int, extra string"


def odd_docs(spark):
    rows = [(i, t, "clash", 7, None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[2], (None, "null id", None, None, None)], SCHEMA)


def library():
    return Tokenizer.from_file(WORD_BPE)


def test_prefix_bpe_equals_library_on_random_text():
    own, lib, rnd = bpe.PrefixBpe(bpe.read_spec(WORD_BPE)), library(), random.Random(1)
    texts = ["".join(rnd.choice("aabtheinrs'") for _ in range(60)) for _ in range(400)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 0x500), rnd.randrange(1, 0xD7FF)])) for _ in range(80)) for _ in range(100)]
    for text in [*texts, *filter(None, ODD)]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_op3_query(spark, sf_dir):
    lib = library()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_odd_rows(spark):
    docs, lib = odd_docs(spark), library()
    coded = bpe.encode(docs, WORD_BPE)
    assert coded.columns == ["doc_id", "text", "IDS_CRC32", "extra", "ids"]
    rows = bpe.decode(coded, WORD_BPE).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0), WORD_BPE).count() == 0


def test_op4_query_and_tie_rules(spark, sf_dir):
    vocab = list(unigram.read_pieces(PIECES))
    lib = Tokenizer(models.Unigram(vocab, 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = op4_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    for byte_fallback in (True, False):
        kept = [v for v in vocab if byte_fallback or not v[0].startswith("<0x")]
        lib = Tokenizer(models.Unigram(kept, 0, byte_fallback))
        lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
        own, rnd = unigram.UnigramCounter(kept, byte_fallback), random.Random(2)
        for text in [*filter(None, ODD), "▁a▁▁ b ", *("".join(rnd.choice("aabtheinrs 漢é") for _ in range(90)) for _ in range(200))]:
            assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    counted = unigram.count_tokens(odd_docs(spark), PIECES, n_tokens="extra")
    assert counted.columns == ["doc_id", "text", "ids", "IDS_CRC32", "extra"] and counted.count() == len(ODD) + 2


def test_addressable_codes_round_trip():
    rnd = np.random.default_rng(3)
    for ids in (np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), rnd.integers(0, 49408, 5000), np.zeros(0, np.uint32), rnd.integers(0, 300, 3000)):
        codes = token_files.AddressableCodes.pack(ids.astype(np.uint32))
        assert len(codes) == len(ids) and (codes.ids() == ids).all()
        assert all(codes[i] == ids[i] for i in range(0, len(ids), 7))


def test_op5_query(spark, sf_dir):
    lib, start = library(), 0
    rows = {r["doc_id"]: r for r in op5_token_files(spark, sf_dir).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_odd_rows_and_random_access(spark):
    path, lib = new_path(spark, "odd"), library()
    token_files.write(odd_docs(spark), WORD_BPE, path, end_id=1, partitions=3)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ODD) + 2 and rows[0]["doc_id"] is None
    every = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4")
    assert rows[-1]["n_tokens"] == 1  # the null text: the end id alone
    assert list(every[: rows[0]["n_tokens"]]) == [*lib.encode("null id", add_special_tokens=False).ids, 1]
    for i in (0, 5, len(every) - 1):
        assert token_files.token_at(spark, path, i) == every[i]
    assert token_files.token_at(spark, path, len(every)) is None
    empty = new_path(spark, "empty")
    token_files.write(odd_docs(spark).limit(0), WORD_BPE, empty, end_id=1)
    assert token_files.read(spark, empty).count() == 0 and token_files.token_at(spark, empty, 0) is None
