"""Queries of the numbered operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, edit_fingerprint, jaccard, main_text, mixing, neighbours, periodic, quality, spelling, token_files, toxicity, unigram, url_filter
from .common import cut, new_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from both views, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.withColumn("kept", (F.col("quality_score") >= quality.KEEP_FROM).cast("int"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text of these ids, as digests."""
    made = bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, keep=["doc_id"])
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram tokens of every whole text."""
    return unigram.count_tokens(table(spark, sf_dir, "documents"), PIECES, keep=["doc_id"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: place, length and checksum of each document's ids."""
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), WORD_BPE, path, end_id=1)
    return token_files.checksums(spark, path)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "html")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edit with the next document."""
    return edit_fingerprint.against_next(table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near fingerprints of every whole text; operator 7 as well, in a query of its own."""
    prints = cut(edit_fingerprint.fingerprint(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return edit_fingerprint.near_groups(prints)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have Jaccard similarity 0.9 or more."""
    return jaccard.similarity_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = cut(mixing.with_sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, every tenth with a tail that repeats, and what is left of it, as digests."""
    made = periodic.collapse_runs(periodic.with_periodic_tail(table(spark, sf_dir, "documents")), keep=["doc_id"])
    made = made.withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all whole texts, some with a letter deleted."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling": op12_spelling,
    "op13_main_text": op13_main_text,
    "near_fingerprints": near_fingerprints,
}

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], chr(9)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 90 * (p.n + q.n - common)
), e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x) l USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op9_ngram_jaccard": _OP9_SQL}
