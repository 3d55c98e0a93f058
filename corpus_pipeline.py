"""A training corpus from raw documents: good texts, one of each group of near copies, no secrets, mixed, packed.

Every stage but the last returns the columns of its documents, as they came and in their order, whatever they are called
(helper columns take names that are free); the last returns doc_id, piece, start, length, ids_crc32, sequence_id and
offset. Documents need doc_id and text, and source for the mix. An empty table passes through every stage empty.

| Stage | Null or blank text | Ties and repeated rows | Null doc_id or source |
| --- | --- | --- | --- |
| quality classifier | scores by the intercept | judged each | not learnt from; judged |
| simhash near-dedup | null and empty are one text; blank ones are like each other | one row of equal ones stays; of a group the least doc_id | after all others |
| secret scan | stays as it is | each is cleaned | cleaned as others |
| mix sources | has no words, is never taken | rows of a doc_id are taken together | an id of its own; a source of its own |
| best-fit packing | the end id alone | packed each | kept |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpool.llm import mixing, packing, quality, secrets, simhash
from quillpool.llm.tokens import vocabulary
from quillpool.session import shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the documents it is given."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    s = quality.Settings()
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", s, usable=fold != 0)
    return quality.keep_good(docs, weights, s)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=0, length=2048), length=2048)


STAGES = [("quality classifier", good), ("simhash near-dedup", distinct), ("secret scan", clean), ("mix sources", mix), ("best-fit packing", pack)]

#: Learnt weights, BK-trees and tokenizers have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written to the shared folder and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
