"""Session settings shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for timestamp parity with the oracle,
# AQE for runtime coalescing and skew splits, Arrow for the pandas paths.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "postlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    ``master`` and ``shuffle_partitions`` are only meant for local runs; on a
    cluster the submitter's values win because ``getOrCreate`` keeps them.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.driver.memory", os.environ.get("POSTLENS_DRIVER_MEM", "16g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is.  Only
    when it is unset (local tests) a scratch folder is created and set.
    """
    sc = spark.sparkContext
    cur = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not cur and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    if not cur:  # a local run, where one machine holds driver and executors
        cur = tempfile.mkdtemp(prefix="postlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cur)
    return sc.getCheckpointDir() or cur
