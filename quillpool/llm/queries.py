"""The queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import codes, licenses, matroska, mixing, packing, quality, rules, secrets, simhash, suffix, tokenbin, urls, variants
from .oracles import OP5_SQL, OP9_SQL, OP10_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from .tokens import vocabulary

#: (verdict, host, path) of the URL rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    s = quality.Settings()
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", s, usable=fold != 0)
    scored = quality.score(docs.select("doc_id", "text"), weights, s)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, length=2048), length=2048)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.media_column(table(spark, sf_dir, "documents")))


def op7_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, urls.labelled(spark))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedupe(table(spark, sf_dir, "documents"), length=50)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("lang", "source")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return codes.compress(vectors.select("vec_id", "label", F.col("embedding").alias("vec")), entries=256, parts=4, rounds=4, scale=1024)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.regroup(table(spark, sf_dir, "documents"), least_length=6, least_count=5, times=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_matroska": op6_matroska,
    "op7_tokenbin": op7_tokenbin,
    "op8_urls": op8_urls,
    "op9_suffix": op9_suffix,
    "op10_rules": op10_rules,
    "op11_codes": op11_codes,
    "op12_licenses": op12_licenses,
    "op13_variants": op13_variants,
}

ORACLE_SQL = {"op5_mixing": OP5_SQL, "op9_suffix": OP9_SQL, "op10_rules": OP10_SQL, "op11_codes": OP11_SQL, "op12_licenses": OP12_SQL, "op13_variants": OP13_SQL}
