"""Structured Streaming forms of the feed operators.

Each function takes a streaming DataFrame and returns a streaming DataFrame;
``run_available`` drives a stream to completion with ``trigger(availableNow)``
into a parquet folder under the shared checkpoint directory (sink and
checkpoint both there), which is how the batch-equivalence tests run them.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import BASE_CONF, checkpoint_dir
from postlens.streaming.ordered import batch_fold, change_fold, in_order, throttle_fold


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """File stream over a folder; a single file is read as its folder filtered to that name."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if os.path.isfile(path):
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.parquet(path)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever store the session has (folds over list
    and value state, see :mod:`postlens.streaming.ordered`, run on no other); then the session's holds again."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, BASE_CONF[STATE_STORE])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream", base: str | None = None) -> DataFrame:
    """Run to completion (availableNow) and return what the sink received as a batch DataFrame.
    A run with the ``base`` folder of an earlier one goes on where that stopped."""
    spark = stream.sparkSession
    base = base or os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces what it has written
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    w = stream.writeStream.option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True)
    w = w.format("parquet").option("path", out) if mode == "append" else w.foreachBatch(sink)
    with state_store(spark):  # a query takes the settings of its start
        q = w.start()
    q.awaitTermination()
    return spark.read.parquet(out)


def item_stream(events: DataFrame, is_item) -> DataFrame:
    """Only true items pass; anything else in the feed is skipped."""
    return events.where(is_item)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast under the session time zone (UTC)."""
    return df.withColumn("event_time", F.col(ts).cast("timestamp"))


def dedup_url_stream(stream: DataFrame, url: str, delay: str | None = None) -> DataFrame:
    """Each URL once, whatever the order of the files; the state keeps every URL.  With a
    ``delay`` only repeats within the watermark delay are dropped (bounded state)."""
    if delay is None:
        return with_event_time(stream).dropDuplicates([url])
    return with_event_time(stream).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([url])


def sliding_count_stream(stream: DataFrame, key: str, length: str = "24 hours", slide: str = "1 hour",
                         delay: str = "1 hour") -> DataFrame:
    """Per key and sliding window, the number of events; late rows beyond the watermark are dropped.

    Panes of one slide are counted first, and a second stateful aggregate adds up the panes of
    each window: a row costs one update, whatever the number of windows that it lies in.
    Windows come out once the watermark has passed their end.
    """
    s = with_event_time(stream).withWatermark("event_time", delay)
    panes = s.groupBy(F.window("event_time", slide).alias("pane"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return panes.groupBy(F.window(F.window_time("pane"), length, slide), F.col(key)).agg(F.sum("n").alias("n"))


def throttle_stream(stream: DataFrame, key: str, ts: str, row_id: str, hours: float, delay: str = "1 hour") -> DataFrame:
    """Per key, emit an event only if ``hours`` passed since the last emitted one, in order of time.

    Columns key, row_id and late: rows that came after the watermark had passed them are flagged.
    The time of the last emitted event lives in state until no row can come that it holds back.
    """
    step = round(hours * 3600 * 1_000_000)
    return in_order(stream, key, ts, row_id, {}, throttle_fold(step), "last long", "", delay, keep_us=step)


def assemble_batches_stream(stream: DataFrame, feed: str, ts: str, row_id: str, tokens: str, batch_size: int,
                            max_tokens: int, gap_seconds: float, min_early: int = 5, delay: str = "1 hour") -> DataFrame:
    """Batch assembly on an unbounded feed, in order of time; state per feed: the open batch
    and the last arrival.  Late rows come out flagged, in no batch."""
    return in_order(stream, feed, ts, row_id, {"tok": F.col(tokens).cast("long")},
                    batch_fold(batch_size, max_tokens, gap_seconds * 1e6, min_early),
                    "batch_no long, n long, s long, last long",
                    "batch_no long, chunk_in_batch long, tokens_in_batch long, close_reason string", delay).withColumnRenamed("key", "feed")


def change_events_stream(stream: DataFrame, key: str, ts: str, row_id: str, col: str, delay: str = "1 hour",
                         keep_us: int | None = None) -> DataFrame:
    """Rows whose ``col`` differs from that of the key's row before, in order of time; the first
    counts.  Columns key, row_id, value, previous and late.  The last value of a key is kept for
    ever, or for ``keep_us`` microseconds of event time after its last row."""
    kind = stream.schema[col].dataType.simpleString()
    return in_order(stream, key, ts, row_id, {"value": F.col(col)}, change_fold(), f"value {kind}",
                    f"value {kind}, previous {kind}", delay, keep_us)
