"""From documents to a training mix: quality, line deduplication, near duplicates, decontamination, mixing.

All stages take null and empty texts, null doc_ids, repeated rows, further columns and empty tables; what becomes of them
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm.common import bucket_of, materialize, table
from cragline.llm.decontaminate import clean_documents
from cragline.llm.line_dedup import dedup_lines
from cragline.llm.mixing import mix
from cragline.llm.near_duplicates import one_of_each
from cragline.llm.quality import score_quality, train_quality
from cragline.llm.queries import MIX_WEIGHTS, mix_domain


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the quality classifier accepts; labels of a third of the documents are not learned from.

    Null and empty texts get the score of a text without n-grams, like any other; repeated rows stay or go together.
    """
    labels = table(spark, sf_dir, "labels").filter(bucket_of("doc_id", 3) != 1)
    return score_quality(docs, train_quality(docs, labels)).filter("predicted = 1").select(docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without recurring lines. A document that only had such lines stays, with an empty text."""
    return dedup_lines(docs, short_docs=3).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Documents without words, and rows
    without a doc_id, stay; of repeated rows one stays."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of a benchmark item. Rows without a doc_id or a text stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their tokens, domain, number of whole copies, and, where a budget ends inside a
    document, the prefix drawn from it. Documents without a token are never drawn."""
    return mix(docs, mix_domain(), MIX_WEIGHTS)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can express neither the classifier nor the aligner; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
