"""From raw documents to token ids: quality, toxicity, near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streetgrid.llm import bpe, jaccard, mixing, quality, toxicity
from streetgrid.llm.common import new_path, table
from streetgrid.llm.queries import WORD_BPE


#: Rows of an Arrow batch; with Spark's 10,000, a batch of whole texts takes some 100 MB in each of a task's two processes.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of bounded rows where they are as large as Spark has them by itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(_bounded(spark), sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.keep_clean(docs, table(_bounded(spark), sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    _bounded(spark)
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with doc_id, source and lang."""
    _bounded(spark)
    return bpe.encode(docs, WORD_BPE, keep=["doc_id", "source", "lang"])


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifiers cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; between two of them, the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
