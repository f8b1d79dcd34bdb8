"""License scan: canonical digests of whole texts joined with those of known license texts.

A text is put into lower case, loses its copyright lines, gets one spelling for equivalent words, and keeps
only its words; the SHA-256 of what remains is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm.license_texts import known_texts

#: Spellings that count as equal, as license matching guidelines list them, and some more.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "customised": "customized", "defence": "defense",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelled": "labeled", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organisations": "organizations", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "recognised": "recognized", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "wilfull": "willful",
}
#: The same for two words, after the single ones.
EQUIVALENT_PAIRS = {"copyright owner": "copyright holder", "copyright owners": "copyright holders", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[|by )|©|\(c\)[ \t]*(copyright|[0-9]{4}|<|\[)|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "\n")
    text = F.concat(F.lit("  "), F.regexp_replace(text, NOT_WORD, "  "), F.lit("  "))  # each word has blanks of its own
    for a, b in EQUIVALENT.items():
        text = F.replace(text, F.lit(f" {a} "), F.lit(f" {b} "))
    for a, b in EQUIVALENT_PAIRS.items():
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(text, " +", " "))


def license_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id (as SPDX names them), digest of the known texts; of texts with equal forms the smallest license_id stays."""
    rows = spark.createDataFrame(known_texts() if texts is None else list(texts.items()), "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, digests: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, digest, license_id (null where the text is no known license), for every row.

    Null texts count as empty. Repeated rows give repeated results; an empty table gives an empty result; other
    columns are not looked at. The digests are broadcast up to broadcast_rows of them, and joined by a shuffle
    beyond.
    """
    forms = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    known = digests.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if digests.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    return forms.join(known, "digest", "left").select("doc_id", "digest", "license_id")
