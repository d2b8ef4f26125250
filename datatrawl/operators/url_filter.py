"""A Bloom filter of URLs as a table of words, which can be kept by batch and merged.

A URL has one word, and PROBES bits within it, all from one hash. The filter is the table of the
words that have bits, (`word`, `bits`), of at most `words` rows; several are merged by "or".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20   # 64-bit words: about a million rows at most, whatever the number of URLs
PROBES = 4


def _place(url: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(words)).cast("long")


def _mask(url: Column) -> Column:
    """PROBES bits by pieces of a second hash."""
    hashed = F.xxhash64(F.lit("bits"), url)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(PROBES)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def build_filter(urls: DataFrame, words: int = WORDS) -> DataFrame:
    """The filter of the `url`s (null ones are left out)."""
    known = urls.filter(F.col("url").isNotNull())
    return known.select(_place(F.col("url"), words).alias("word"), _mask(F.col("url")).alias("bits")).groupBy(
        "word").agg(F.bit_or("bits").alias("bits"))


def merge_filters(parts: DataFrame) -> DataFrame:
    """One filter of the rows of several."""
    return parts.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_maybe(df: DataFrame, url_filter: DataFrame, words: int = WORDS) -> DataFrame:
    """Add `_maybe`: false only if no URL of the filter equals `url`.

    The filter is broadcast; it has at most `words` rows.
    """
    held = F.broadcast(url_filter.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    mask = _mask(F.col("url"))
    hit = F.col("_bits").bitwiseAND(mask) == mask
    return df.withColumn("_word", _place(F.col("url"), words)).join(held, "_word", "left").withColumn(
        "_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")
