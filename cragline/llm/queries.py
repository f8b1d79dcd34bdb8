"""Queries over the tables of a folder for the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm import sql
from cragline.llm.common import bucket_of, table
from cragline.llm.decontaminate import contamination
from cragline.llm.language_id import identify_language, train_prototypes
from cragline.llm.licenses import license_digests, scan_licenses
from cragline.llm.line_dedup import dedup_lines
from cragline.llm.mixing import mix
from cragline.llm.near_duplicates import near_duplicates
from cragline.llm.pii import find_pii
from cragline.llm.quality import score_quality, train_quality
from cragline.llm.topk import quantise, top_k
from cragline.llm.warc import archive_round_trip


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 5) == 0
    found = identify_language(docs, train_prototypes(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of("doc_id", 3) == 1
    model = train_quality(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), short_docs=3).select("doc_id", "text", "n_lines", "n_dropped")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), license_digests(spark))


#: Weights of the mix: sources fall into four domains by a digest of their name, which SQL has as well.
MIX_WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def mix_domain() -> Column:
    return F.concat(F.lit("d"), F.ascii(F.md5(F.col("source").cast("binary"))) % 4)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS).select("doc_id", "domain_name", "lang", "source", "tokens", "copies", "tokens_taken")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_top_k": op8_top_k,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": sql.license_sql(),
    "op7_mixing": sql.mixing_sql(MIX_WEIGHTS),
    "op8_top_k": sql.TOP_K,
    "op10_warc": sql.WARC,
}
