"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (map-side combined, so a hot source costs one row per
task), targets are filled up to a cap, and every document is emitted floor(rate)
times plus one Bernoulli copy whose probability is the fraction of the rate.  The
coin is a hash of the seed, the id and the text, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_columns, replace_columns, text_or_empty, word_count

#: Largest table of sources that is sent to every executor; beyond it the join is left to the planner.
MAX_BROADCAST_SOURCES = 100_000


def source_targets(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0,
                   source: str = "source", text: str = "text") -> DataFrame:
    """Per source: ``source_size``, ``target`` and ``rate``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.  The
    targets share the total size of all documents by weight; none exceeds ``cap`` times
    its source's size, and what a capped source leaves goes to the others by weight.
    With level x a source takes least(weight * x, cap * size): sources are capped in
    the order of cap * size / weight, so one running sum finds the level.
    The windows run over the table of sources (one row each), not over documents.
    """
    src = docs.groupBy(F.col(f"`{source}`").alias("_s")).agg(F.sum(word_count(F.col(f"`{text}`"))).alias("_z"))
    by_name = Window.orderBy(F.col("_s").cast("binary").asc_nulls_last())
    n = len(weights)
    w = F.array([F.lit(float(x)) for x in weights])
    src = src.withColumn("_w", F.get(w, ((F.row_number().over(by_name) - 1) % n).cast("int")))
    src = src.withColumn("_r", F.col("_z") * cap / F.col("_w"))
    before = Window.orderBy("_r", "_w", F.col("_s").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    src = (src.withColumn("_total", F.sum("_z").over(every).cast("double"))
              .withColumn("_left", F.col("_total") - F.coalesce(F.sum(F.col("_z") * cap).over(before), F.lit(0.0)))
              .withColumn("_wleft", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
              .withColumn("_level", F.col("_left") / F.col("_wleft")))
    # the first source in that order whose own cap is not reached fixes the level
    src = src.withColumn("_x", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(every)["_level"])
    target = F.least(F.col("_z") * F.lit(float(cap)), F.col("_w") * F.coalesce(F.col("_x"), F.lit(float("inf"))))
    return src.select(F.col("_s").alias("source"), F.col("_z").alias("source_size"),
                      target.alias("target"),
                      F.when(F.col("_z") > 0, F.least(target / F.col("_z"), F.lit(float(cap)))).otherwise(0.0).alias("rate"))


def coin(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed, the id and the text."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")),
                       F.md5(text_or_empty(F.col(f"`{text}`")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_copies(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 0,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each row of ``docs`` with size, source_size, target and copies (0 to ceil(cap)).

    Defined cases: null or empty text has size 0 and still follows its source's rate; a
    null source is a source of its own, ordered last; all sizes 0 gives rate 0; repeated
    rows (same id and text) share one coin and so one number of copies; an empty table
    gives no rows.  Columns named like the added ones are replaced.
    """
    targets = source_targets(docs, weights, cap, source, text)
    targets = targets.select([F.col(c).alias(f"_pl_{c}") for c in targets.columns]).checkpoint()
    if targets.count() <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = docs.join(targets, docs[f"`{source}`"].eqNullSafe(targets["_pl_source"]), "left")
    whole = F.floor("_pl_rate")
    copies = whole + F.when(coin(seed, doc_id, text) < F.col("_pl_rate") - whole, 1).otherwise(0)
    new = {"size": word_count(F.col(f"`{text}`")), "source_size": F.col("_pl_source_size"),
           "target": F.col("_pl_target"), "copies": copies.cast("int")}
    kept = joined.select(*keep_columns(docs), *[c.alias(f"_pl_{k}") for k, c in new.items()])
    return kept.select(replace_columns(docs, {k: F.col(f"_pl_{k}") for k in new}))


def emit(copies: DataFrame, n: str = "copies", number: str = "copy_no") -> DataFrame:
    """One row per copy, numbered from 1; rows with no copy go."""
    return (copies.filter(F.col(n) > 0)
            .withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n)))))
