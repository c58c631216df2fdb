"""Cutting a feed into bounded batches, and job analytics (§2.6).

Batch assembly: items arrive in order; after adding an item the batch closes
when the gap since the previous item exceeds ``gap_seconds`` and it holds at
least ``min_early`` chunks ("early"), when its tokens exceed ``max_tokens``
("tokens"), or when it holds ``batch_size`` chunks ("full").  Each reset
depends on the previous one; a long feed is cut into blocks of rows whose
functions from first start to next first start are composed, so no task takes
a whole feed.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.ordering import previous, running

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Batch limits of the reference.
EARLY_GAP_SECONDS = 90
EARLY_MIN_CHUNKS = 5
DEFAULT_MAX_TOKENS = 30000


def inter_arrival(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Seconds since the previous item of the same key; null for the first, and without a time.
    Every row is kept: a null key is a key, rows without a time come first."""
    r = running(df, [key], [ts, tie])
    r = previous(r, [key], [ts])
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_" + ts).cast("timestamp"))) / 1e6
    return r.withColumn("gap_seconds", gap).drop("prev_" + ts)


def running_tokens(df: DataFrame, keys: Sequence[str], ts: str, tie: str, tokens: str) -> DataFrame:
    """Cumulative tokens (a null counts 0) and chunk count since the start of each batch ``keys``;
    every row is kept, null keys and times too."""
    r = running(df, keys, [ts, tie], sums=[tokens], rank_col="chunks_so_far")
    return r.withColumnRenamed(f"run_{tokens}", "tokens_so_far")


def assemble_batches(df: DataFrame, feed: str, ts: str, row_id: str, tokens: str, batch_size: int,
                     max_tokens: int = DEFAULT_MAX_TOKENS, gap_seconds: float = EARLY_GAP_SECONDS,
                     min_early: int = EARLY_MIN_CHUNKS, block_rows: int = 100_000, fan: int = 1_000) -> DataFrame:
    """Assign ``batch_no``, ``chunk_in_batch``, ``tokens_in_batch`` and, on the
    row that closes a batch, ``close_reason``.  Token counts are not negative;
    a null one counts 0.

    A feed is cut into blocks of ``block_rows`` rows.  A batch holds at most
    ``batch_size`` rows, so all that a block passes on is the place of the first
    batch start among the next block's first ``batch_size`` rows: a block is a
    function of ``batch_size`` places.  The functions are composed in a tree of
    ``fan`` blocks a node, each block then learns its own first start, and cuts
    its rows (and the few rows of the next block that its last batch takes).
    """
    if block_rows < batch_size:
        raise ValueError("a block must hold a batch")
    sub = df.select(F.col(feed).alias("feed"), F.struct(F.col(feed).alias("k")).alias("key"), F.col(row_id).alias("row_id"),
                    F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"),
                    F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tok"))
    rules = _Rules(batch_size, max_tokens, gap_seconds * 1e6, min_early)

    def cut(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return rules.cut(key, pdf)

    def function(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return rules.function(key, pdf)

    schema = T.StructType([sub.schema["feed"], sub.schema["row_id"],
                           T.StructField("batch_no", T.LongType()), T.StructField("chunk_in_batch", T.LongType()),
                           T.StructField("tokens_in_batch", T.LongType()),
                           T.StructField("close_reason", T.StringType())])
    largest = sub.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block_rows:  # every feed is one block
        rows = sub.select("feed", "row_id", "t_us", "tok", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"),
                          F.lit(0).cast("long").alias("batch_no"))
        return rows.groupBy("feed").applyInPandas(cut, schema=schema)

    ranked = running(sub, ["key"], ["t_us", "row_id"])
    at, own = F.pmod(F.col("rank") - 1, F.lit(block_rows)), F.floor((F.col("rank") - 1) / block_rows).cast("long")
    copies = F.array(F.struct(own.alias("block"), F.lit(0).alias("part")),
                     F.when((at < batch_size) & (own > 0), F.struct((own - 1).alias("block"), F.lit(1).alias("part"))),
                     F.when(at == block_rows - 1, F.struct((own + 1).alias("block"), F.lit(-1).alias("part"))))
    rows = ranked.select("feed", "key", "row_id", "t_us", "tok", F.inline(F.filter(copies, lambda x: x.isNotNull()))).checkpoint()
    table = f"key {sub.schema['key'].dataType.simpleString()}, block long, `to` array<long>, n array<long>"
    levels = [rows.groupBy("key", "block").applyInPandas(function, schema=table).checkpoint()]
    blocks = -(-largest // block_rows)
    while blocks > fan:
        up = levels[-1].withColumn("up", F.floor(F.col("block") / fan).cast("long"))
        levels.append(up.groupBy("key", "up").applyInPandas(_compose, schema=table).checkpoint())
        blocks = -(-blocks // fan)
    starts = None  # (key, up, place, batch_no): where the node above begins
    place = f"key {sub.schema['key'].dataType.simpleString()}, block long, place long, batch_no long"
    for level in reversed(levels):
        up = level.withColumn("up", F.floor(F.col("block") / fan).cast("long"))
        if starts is None:
            up = up.withColumn("place", F.lit(0).cast("long")).withColumn("batch_no", F.lit(0).cast("long"))
        else:
            up = up.join(starts.withColumnRenamed("block", "up"), ["key", "up"])
        starts = up.groupBy("key", "up").applyInPandas(_walk, schema=place)
    return rows.join(starts, ["key", "block"]).groupBy("key", "block").applyInPandas(cut, schema=schema)


@dataclass(frozen=True)
class _Rules:
    """When a batch closes, over the rows of one block with numpy."""
    batch_size: int
    max_tokens: int
    gap_us: float
    min_early: int

    def _next(self, t: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a batch that starts at each row: the row that closes it (or the last one); gaps; running tokens."""
        n = len(t)
        gap = np.diff(t, prepend=t[:1])  # a feed's first row has none; a block's first row is the one before it
        total = np.concatenate([[0], np.cumsum(tok)])
        i = np.arange(n)
        long_gap = np.append(np.flatnonzero(gap > self.gap_us), n)
        early = long_gap[np.searchsorted(long_gap, np.minimum(i + max(self.min_early, 1) - 1, n))]
        tokens = np.searchsorted(total, total[:-1] + self.max_tokens, "right") - 1
        return np.minimum(np.minimum(early, tokens), i + self.batch_size - 1), gap, total

    @staticmethod
    def _rows(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["t_us", "row_id"], kind="mergesort", na_position="first")
        part = pdf["part"].to_numpy()
        t = pdf["t_us"].to_numpy()
        return pdf, t, pdf["tok"].to_numpy(), int((part < 0).sum()), int((part == 0).sum())

    def function(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a block: for each of its first places the next block's first start, and the batches begun."""
        pdf, t, tok, before, own = self._rows(pdf)
        close, _, _ = self._next(t, tok)
        to = close[before:before + own] + 1 - before
        n = np.ones(own, np.int64)
        while (inside := np.flatnonzero(to < own)).size:
            n[inside], to[inside] = n[inside] + n[to[inside]], to[to[inside]]
        k = min(own, self.batch_size)
        out = np.zeros(self.batch_size, np.int64), np.zeros(self.batch_size, np.int64)
        out[0][:k], out[1][:k] = np.minimum(to[:k] - own, self.batch_size - 1), n[:k]
        return pd.DataFrame({"key": [key[0]], "block": [key[1]], "to": [out[0]], "n": [out[1]]})

    def cut(self, _, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of the batches that start in a block."""
        place, b = int(pdf["place"].iloc[0]), int(pdf["batch_no"].iloc[0])
        pdf, t, tok, before, own = self._rows(pdf)
        close, gap, total = self._next(t, tok)
        starts, i, n = [], before + place, len(t)
        while i < before + own:
            starts.append(i)
            i = int(close[i]) + 1
        starts = np.array(starts, np.int64)
        last = np.minimum(close[starts], n - 1)
        size = last - starts + 1
        first = np.repeat(starts, size)
        row = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + first
        pos, run = row - first + 1, total[row + 1] - total[first]
        ends = row == np.repeat(last, size)
        why = np.select([ends & (gap[row] > self.gap_us) & (pos >= self.min_early), ends & (run > self.max_tokens),
                         ends & (pos >= self.batch_size)], ["early", "tokens", "full"], "")
        some = pdf.iloc[row]
        return pd.DataFrame({"feed": some["feed"].to_numpy(), "row_id": some["row_id"].to_numpy(),
                             "batch_no": np.repeat(b + np.arange(len(starts)), size), "chunk_in_batch": pos,
                             "tokens_in_batch": run, "close_reason": np.where(why == "", None, why)})


def _compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One function for the blocks of a node, in order."""
    pdf = pdf.sort_values("block")
    place, n = np.arange(len(pdf["to"].iloc[0])), 0
    for to, count in zip(pdf["to"], pdf["n"]):
        n, place = n + np.asarray(count)[place], np.asarray(to)[place]
    return pd.DataFrame({"key": [key[0]], "block": [key[1]], "to": [place], "n": [n]})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first start, and its batch number, of each block of a node."""
    pdf = pdf.sort_values("block")
    place, b, out = int(pdf["place"].iloc[0]), int(pdf["batch_no"].iloc[0]), []
    for key, block, to, n in zip(pdf["key"], pdf["block"], pdf["to"], pdf["n"]):
        out.append((key, block, place, b))
        place, b = int(to[place]), b + int(n[place])
    return pd.DataFrame(out, columns=["key", "block", "place", "batch_no"])


def batch_close_reason(assigned: DataFrame) -> DataFrame:
    """Per batch: chunks, tokens and why it closed (``open`` if still open)."""
    return assigned.groupBy("feed", "batch_no").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("tokens_in_batch").alias("tokens"),
        F.coalesce(F.max("close_reason"), F.lit("open")).alias("close_reason"))


def job_step_status(df: DataFrame, job: str, step: str, ts: str, failed: Column) -> DataFrame:
    """Per job and step: start, end, failed flag, status and duration in seconds."""
    g = df.groupBy(job, step).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"),
                                  F.bool_or(failed).alias("failed"))
    return g.withColumn("status", F.when(F.col("failed"), "failed").otherwise("done")).withColumn(
        "duration_s", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def attempt_rollup(df: DataFrame, job: Sequence[str], ts: str, tie: str, ok: Column, max_attempts: int = 5
                   ) -> DataFrame:
    """Per job: attempts made (up to the first success, at most ``max_attempts``),
    success flag, gave-up flag and the status of the last attempt made.  Only
    the first ``max_attempts`` rows of a job matter, so ``row_number() <= n``
    lets Catalyst cut each job map-side before the shuffle."""
    w = Window.partitionBy(*job).orderBy(ts, tie)
    a = df.withColumn("_ok", ok).withColumn("attempt_no", F.row_number().over(w)).where(
        F.col("attempt_no") <= max_attempts)
    g = a.groupBy(*job).agg(F.min(F.when(F.col("_ok"), F.col("attempt_no"))).alias("_first_ok"),
                            F.count(F.lit(1)).alias("_n"),
                            F.collect_list(F.struct("attempt_no", "_ok")).alias("_att"))
    made = F.coalesce(F.col("_first_ok"), F.col("_n"))
    last_ok = F.filter("_att", lambda x: x["attempt_no"] == made)[0]["_ok"]
    return g.select(*job, made.cast("long").alias("attempts"), F.col("_first_ok").isNotNull().alias("success"),
                    (F.col("_first_ok").isNull() & (F.col("_n") >= max_attempts)).alias("gave_up"),
                    F.when(last_ok, "ok").otherwise("failed").alias("last_status"))


def latest_jobs(df: DataFrame, job: str, ts: str, tie: str, k: int = 15) -> DataFrame:
    """Latest ``k`` items of every job, newest first (window group limit, skew-safe map-side cut)."""
    w = Window.partitionBy(job).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("item_rank", F.row_number().over(w)).where(F.col("item_rank") <= k)
