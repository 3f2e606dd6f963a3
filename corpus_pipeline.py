"""From documents to tokens in five stages, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of docs, whatever further
columns there are and whatever their names.

Defined cases: a null text is empty. quality keeps or drops it by the score of an empty text; the two
deduplications take empty texts for equal to each other (exact_dedup) and for linked with nothing
(near_dedup); mixing takes nothing of a text without words; tokens gives empty lists. Rows that repeat are one
after exact_dedup. Null doc_ids teach nothing, go where their group has an id, and
stay otherwise. Empty tables go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirel.llm import byte_bpe, compression_classifier, exact_dedup, minhash, mixing
from lumirel.llm.common import fresh_path, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good; it learns from the labels of documents that it isn't judged on."""
    labels = read_table(spark, sf_dir, "labels")
    model = compression_classifier.train(docs, labels, compression_classifier.remainder(F.col("doc_id")) != 0)
    return compression_classifier.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, with the words taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, offsets, n_tokens, decoded_sha256): token ids, where each starts, and a digest of the bytes that they decode to."""
    done = byte_bpe.encode_and_decode(docs)
    return done.select("doc_id", "ids", "offsets", F.size("ids").cast("long").alias("n_tokens"), F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("tokens", tokens)]

#: A trained classifier, MinHash, a pseudorandom mix and pair merging aren't SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
