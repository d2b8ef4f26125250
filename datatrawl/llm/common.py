"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datatrawl.session import stage

__all__ = [
    "ascii_lower", "by_share", "give_back", "held_out", "labelled_sample", "read_table", "release", "row_key", "stage", "unused", "words"]

# What separates words once A-Z are lower case: ASCII other than 0-9 and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case and every other character as it is.

    `lower` does just that on ASCII text, and is much faster there; elsewhere it would also
    change other letters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of `text` in order; of a null text, none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True for the rows that no model may learn labels from. A null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def row_key(key: Column, text: Column) -> Column:
    """Tells rows apart that share a key but not the text."""
    return F.struct(key.alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))


def by_share(key: Column, share: Column | float) -> Column:
    """True for about `share` of all `key`s (64-bit hashes)."""
    return F.pmod(key, F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def give_back() -> None:
    """Give memory that this process has freed back to the system.

    Python workers live on behind their task; what they hold then is missing to the next one.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def release(df: DataFrame) -> None:
    """Empty a staged table that nothing reads any more, which gives its disk back."""
    files = df.inputFiles()
    if files:
        nothing = df.sparkSession.range(0).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in df.schema))
        nothing.write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample_docs: int,
                    folds: int, fold: int) -> tuple[DataFrame | None, dict[int, int]]:
    """About `sample_docs` documents of each label (`text`, `label`), staged, and how many there are.

    Rows of one key and text are one document, however many there are, and the choice goes by a
    hash of both; so the bound holds whatever the keys. Held-out documents, null texts and labels
    but 0 and 1 are passed over; a document labelled twice counts with its larger label. Without
    documents of both labels there is no sample.
    """
    # Written, so that the join shuffles both sides and a key of many rows is split.
    known = stage(labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), folds, fold)).groupBy(
        F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("label")))
    own = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("key"), F.xxhash64(doc_id, text).alias("mark"), F.col(text).alias("text"))
    marked = stage(own.select("key", "mark").join(known, "key").groupBy("mark").agg(F.max("label").alias("label")))
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None, counts
    part = F.when(F.col("label") == 1, min(1.0, sample_docs / counts[1])).otherwise(min(1.0, sample_docs / counts[0]))
    # About two times `sample_docs` rows, however large the table.
    picked = marked.filter(by_share(F.col("mark"), part))
    return stage(own.select("mark", "text").join(F.broadcast(picked), "mark").dropDuplicates(["mark"]).select(
        "text", "label")), counts
