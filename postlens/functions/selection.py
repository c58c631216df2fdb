"""Exact medians of groups of any size.

``median()`` keeps a group's distinct values in one buffer.  Groups with more values than
that should hold are narrowed down instead: values become longs that order like them, and
digit by digit the counts of (group, prefix, digit), combined map-side, tell in which digit
the middle ranks lie.  Four passes of 16 bits leave the exact values, and no task ever sees
more of a group than 65,536 counts.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.ordering import same
from postlens.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Values of a group that one buffer may hold.
LIMIT = 100_000
_DIGIT = 16


def _ordered_bits(v: pd.Series) -> pd.Series:
    b = np.ascontiguousarray(v.to_numpy("float64")).view(np.int64)
    return pd.Series(np.where(b < 0, ~b, b ^ np.int64(-1 << 63)))  # as unsigned longs these order like the values


def _value(u: pd.Series) -> pd.Series:
    u = np.ascontiguousarray(u.to_numpy("int64"))
    return pd.Series(np.where(u < 0, u ^ np.int64(-1 << 63), ~u).view(np.float64))


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, out: str = "median", limit: int = LIMIT) -> DataFrame:
    """(keys, ``out``): the median of the non-null values of every group, the mean of the middle
    two if their number is even; a group without values has null.  Null keys are keys; NaN is
    the largest value."""
    checkpoint_dir(rows.sparkSession)
    keys = list(keys)
    d = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_v"))
    ks = [f"_k{i}" for i in range(len(keys))]

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], out)

    big = d.groupBy(*ks).agg(F.count("_v").alias("_n")).where(F.col("_n") > limit).checkpoint()
    if big.isEmpty():
        return named(d.groupBy(*ks).agg(F.median("_v").alias(out)))
    hot = F.broadcast(big.select(*[F.col(k).alias(f"{k}b") for k in ks]))  # at most rows / limit of them
    is_hot = same([F.col(k) for k in ks], [F.col(f"{k}b") for k in ks])
    small = d.join(hot, is_hot, "left_anti").groupBy(*ks).agg(F.median("_v").alias(out))
    bits = F.pandas_udf(_ordered_bits, "long")
    u = d.where(F.col("_v").isNotNull()).join(hot, is_hot, "left_semi").select(*ks, bits("_v").alias("_u"))
    at = big.select(*ks, F.explode(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))).alias("_r"),
                    F.lit(0).cast("long").alias("_p"))
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        prefix = F.shiftrightunsigned("_u", shift + _DIGIT) if shift + _DIGIT < 64 else F.lit(0).cast("long")
        near = F.broadcast(at.select(*[F.col(k).alias(f"{k}b") for k in ks], F.col("_p").alias("_pb")).distinct())
        counts = (u.withColumn("_p", prefix).join(near, is_hot & (F.col("_p") == F.col("_pb")), "left_semi")
                  .groupBy(*ks, "_p", F.shiftrightunsigned("_u", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_c")))
        # of one prefix there are at most 65,536 digits; shifted prefixes of one parent are in digit order
        w = Window.partitionBy(*ks, "_p").orderBy(F.col("_next").bitwiseAND(F.lit((1 << _DIGIT) - 1)))
        upto = counts.select(*[F.col(k).alias(f"{k}b") for k in ks], F.col("_p").alias("_pb"), "_next",
                             F.sum("_c").over(w).alias("_hi"), "_c")
        found = is_hot & (F.col("_p") == F.col("_pb")) & (F.col("_r") < F.col("_hi")) & (F.col("_r") >= F.col("_hi") - F.col("_c"))
        at = at.join(upto, found).select(*ks, (F.col("_r") - F.col("_hi") + F.col("_c")).alias("_r"), F.col("_next").alias("_p")).checkpoint()
    back = F.pandas_udf(_value, "double")
    large = at.select(*ks, back("_p").alias("_m")).groupBy(*ks).agg((F.sum("_m") / 2).alias(out))
    return named(small.unionByName(large))
