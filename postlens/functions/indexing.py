"""Dense numbering within groups without a one-task window per group.

``row_number().over(partitionBy(g))`` sends a whole group to one task; with a
hot group (a third of all rows) that task is the job.  ``dense_index`` splits
each group into ``salt`` sub-groups, numbers rows inside each sub-group, and
adds the sub-group's offset, taken from a small count table (groups x salts).
The result equals ``row_number() over (partition by g order by salt, order)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portable_uniform(c: Column, mult: int = 2654435761, add: int = 0, mod: int = 1000003) -> Column:
    """Reproducible uniform draw in [0, 1) from an integer id, identical in any SQL engine."""
    return ((c * F.lit(mult) + F.lit(add)) % F.lit(mod)).cast("double") / F.lit(float(mod))


def portable_uniform_sql(col: str, mult: int = 2654435761, add: int = 0, mod: int = 1000003) -> str:
    return f"(CAST(({col} * {mult} + {add}) % {mod} AS DOUBLE) / CAST({mod} AS DOUBLE))"


def dense_index(df: DataFrame, groups: Sequence[str], order: Sequence[str], salt: Column,
                out: str = "idx") -> DataFrame:
    """Add ``out`` = 1..n within ``groups`` ordered by ``(salt, *order)``."""
    groups = list(groups)
    d = df.withColumn("_salt", salt)
    w = Window.partitionBy(*groups, "_salt").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w))
    counts = d.groupBy(*groups, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*groups, "_salt", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"))
    return (d.join(offs, groups + ["_salt"], "inner")
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_salt", "_rn", "_off"))
