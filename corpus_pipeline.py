"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontam, line_dedup, mixing, simhash_groups, toxicity
from postlens.llm.common import crc_mod, read
from postlens.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return toxicity.score(docs, model).filter("score < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; so does a document that has lost all its words."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~emptied).withColumn("n_chars", F.when(
        F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest doc_id stays.

    Every group keeps exactly one row: rows without an id come after those with one, and
    rows of one id (or of none) go by a hash of the row.  Rows of different groups stay,
    whether or not they share an id.
    """
    # nulls leave a hash as it is, so the flags tell apart which columns are null
    columns = [F.col(c).isNull() for c in COLUMNS] + [F.col(c) for c in COLUMNS]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"))
    first = simhash_groups.keepers(docs, order).select(F.col("least.h1").alias("_1"), F.col("least.h2").alias("_2"), "n").checkpoint()
    keyed = docs.select(*COLUMNS, F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"))

    def stay(some):
        return keyed.join(some, (keyed["h1"] == some["_1"]) & (keyed["h2"] == some["_2"]), "left_semi").select(COLUMNS)

    # a row that stands more than once, in all its columns, stays once
    return stay(first.filter("n = 1")).unionByName(stay(first.filter("n > 1")).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.find_items(docs, read(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, copies numbered from 1."""
    return mixing.emit(mixing.with_copies(docs)).select(*COLUMNS, "copy_no")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", keep_one_of_group),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: Trees, MinHash and SimHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
