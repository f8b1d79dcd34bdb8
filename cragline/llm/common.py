"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.sources.scratch import cut as materialize
from cragline.sources.scratch import discard, scratch_dir

__all__ = ["bounded_sample", "bucket_of", "discard", "marked", "materialize", "scratch_dir", "table"]

WORD_BITS = 32_768  # fixed value: bits of a row that bitmap_construct_agg makes
MOST_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null keys give 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


def bounded_sample(rows: DataFrame, by: str, key: str, bound: int, seed: int, most_values: int = 10_000) -> DataFrame:
    """About bound rows of each value of `by`, chosen by a hash of key; all rows of smaller values.

    The counts are one aggregate row for each value, of which there may be most_values; a row is kept when its hash
    falls below bound / count, so the choice does not depend on how the input is partitioned.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().limit(most_values + 1).collect()}
    if len(counts) > most_values:
        raise ValueError(f"column {by} has more than {most_values} values to learn")
    if not counts:
        return rows
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, bound / n)))])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(draw < F.element_at(share, F.col(by)))


def marked(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """rows with a column that is true where the long `key` may be among wanted(key): where it is, and in few other rows.

    The filter is a bitmap of at most MOST_BITS bits, 16 for each wanted key, broadcast as rows of 4 kB. Where
    that bound is reached more rows are marked, which costs time and nothing else: an exact join has to follow.
    """
    n = wanted.count()
    bits = WORD_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    words = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    held = rows.withColumn("_place", place).withColumn("_word", F.bitmap_bucket_number("_place")).join(F.broadcast(words), "_word", "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.withColumn(name, F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))).select(*rows.columns, name)
