"""Rank, running sums and previous-row lookup within a key, without a one-task
window per key.

``lag()`` or a running ``sum()`` over ``partitionBy(key).orderBy(ts)`` puts a
whole key into one task.  Here rows are range-partitioned by key and order, so
that a key of any size, even with all its rows at one time, is spread over many
tasks.  What each partition holds of a key is a small table (a row per key and
partition); a window over it gives the partitions' offsets, and a window over
key *and* partition the positions inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir


def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & x.eqNullSafe(y)
    return out


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (),
            rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` (1-based, by ``order``, nulls first) and ``run_<c>`` (inclusive running
    sum) for each column of ``sums``, within ``keys``.  Every row is kept: a null key is a
    key, and rows of it are ranked like others.

    The partitioning is written to the checkpoint folder, as it must not change between the
    two passes.
    """
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    d = df.repartitionByRange(*keys, *order).withColumn("_bk", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tot = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_bk").alias("_ok"),
                      F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"),
                      *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in sums])
    d = d.withColumn("_pos", F.row_number().over(w))
    for c in sums:
        d = d.withColumn(f"_in_{c}", F.sum(c).over(w))
    d = d.join(offs, same([F.col(k) for k in keys], [F.col(f"_o{i}") for i in range(len(keys))]) & (F.col("_bk") == F.col("_ok")))
    d = d.withColumn(rank_col, (F.col("_off") + F.col("_pos")).cast("long"))
    for c in sums:
        d = d.withColumn(f"run_{c}", F.col(f"_o_{c}") + F.coalesce(f"_in_{c}", F.lit(0)))
    return d.drop("_bk", "_ok", "_pos", "_off", *[f"_o{i}" for i in range(len(keys))], *[f"_in_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def previous(ranked: DataFrame, keys: Sequence[str], cols: Sequence[str], rank_col: str = "rank",
             prefix: str = "prev_") -> DataFrame:
    """Attach the previous row's ``cols`` (``rank - 1`` in the same key, null-safe) by an equi join."""
    keys = list(keys)
    prev = ranked.select(*[F.col(k).alias(f"_pk_{k}") for k in keys],
                         (F.col(rank_col) + 1).alias("_prank"), *[F.col(c).alias(prefix + c) for c in cols])
    cond = same([ranked[k] for k in keys], [prev[f"_pk_{k}"] for k in keys]) & (ranked[rank_col] == prev["_prank"])
    return ranked.join(prev, cond, "left").drop(*[f"_pk_{k}" for k in keys], "_prank")
