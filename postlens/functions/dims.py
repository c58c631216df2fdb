"""Small parameter tables (weights, aliases, quotas, lexicon overrides).

These are the only sides the library broadcasts by hint.  Their size is known
when they are built (they come from a Python literal or a job parameter), and
``param_table`` refuses to hint anything above ``max_rows``: bigger tables are
left to the planner, where AQE broadcasts only after it has measured them
against ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def param_table(spark: SparkSession, rows: Sequence, schema: str,
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A literal table; broadcast-hinted only when its row count is within ``max_rows``."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema=schema)
    return F.broadcast(df) if len(rows) <= max_rows else df


def bounded_broadcast(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint broadcast for a table whose row count is bounded by construction.

    ``n_rows`` is the bound the caller proves (for example the number of
    labels of a classifier).  Above ``max_rows`` the hint is dropped.
    """
    return F.broadcast(df) if n_rows <= max_rows else df
