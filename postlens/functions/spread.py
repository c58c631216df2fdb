"""Dealing a small scan over all cores before work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few partitions (or row groups) dealt evenly over the session's cores; a larger one as it is.

    For plain scans only: their partitions are known without running anything.  A table with
    several times as many splits as there are cores is never shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < 4 * cores else scan
