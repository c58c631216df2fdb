"""Reading the driver tables.

Tables are plain parquet; reading through ``spark.read.parquet`` keeps column
pruning and predicate pushdown in the scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Attribute access to the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            if name not in self._cache:
                self._cache[name] = table(self.spark, self.sf_dir, name)
            return self._cache[name]
        raise AttributeError(name)

    def fresh(self, name: str) -> DataFrame:
        """A second, independent scan of a table (for self joins)."""
        return table(self.spark, self.sf_dir, name)
