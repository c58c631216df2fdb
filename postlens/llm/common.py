"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows and bytes of an Arrow batch that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark hands to Python workers, whatever the length of the rows.
    Both are settings of the session; smaller ones that the user has made stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        said = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower())
        now = int(said[1]) << 10 * " kmgtp".index(said[2] or " ") if said else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


#: Rows of a small intermediate table that share a partition, and so a checkpoint file.
PART_ROWS = 50_000


def checkpoint_about(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint of about ``rows`` rows in as many files as they need (one a core at least), however
    many partitions the last shuffle has.  ``rows`` decides the number of files only."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))).checkpoint()


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: Column | str) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % m


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A long that tells apart rows of one doc_id that hold different texts."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def keep_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of df, those named in ``new`` replaced in place, the others of ``new`` added."""
    out = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return out + [v.alias(k) for k, v in new.items() if k not in df.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a filter of hashes (an array of longs, 2 MB whatever the data).
FILTER_BITS = 24


def hash_filter(keys: DataFrame, h: str, bits: int = FILTER_BITS) -> Column:
    """A bitmap of the trailing bits of the longs ``h`` as a scalar array, for :func:`may_hold`.
    Its size is fixed; with more keys it lets more through, and never holds one back."""
    at = F.col(h).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    every = keys.sparkSession.range(1 << (bits - 6)).join(words, "id", "left")
    whole = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("a"))
    return whole.select(F.transform("a", lambda x: x["w"])).scalar()


def may_hold(bitmap: Column, h: Column, bits: int = FILTER_BITS) -> Column:
    at = h.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(bitmap, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
