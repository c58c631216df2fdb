"""Folds over an unbounded feed in order of event time, whatever the order of arrival.

The rows of a key wait in list state until the watermark has passed them.  An event-time
timer at the first waiting row then hands all rows up to the watermark, in order of (time,
id), to a fold that carries a small memory in value state.  So results don't depend on how
rows are dealt over files and micro-batches, as long as they come within the delay.  A row at
or before the watermark on arrival is late: it changes nothing and comes out flagged, for a
sink of its own.  Memory that can't matter any more is dropped by a second timer.

A task holds the waiting rows of one key (bounded by the delay, not by the feed), as arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: fold(memory or None, times in microseconds, rows) -> (memory, output rows)
Fold = Callable[[Any, np.ndarray, list], tuple]


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``fold`` in order of time, each once the watermark has passed it."""

    def __init__(self, rows: T.StructType, memory: T.StructType, columns: list[str], fold: Fold, keep_us: int | None):
        self.rows_schema, self.memory_schema = rows, T.StructType([*memory.fields, T.StructField("last_us", T.LongType()),
                                                                   T.StructField("timer", T.LongType())])
        self.size, self.columns, self.fold, self.keep_us = len(memory.fields), columns, fold, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows_schema)
        self.memory = handle.getValueState("memory", self.memory_schema)

    def _state(self) -> tuple:
        found = self.memory.get() if self.memory.exists() else None
        if found is None:
            return None, None, None
        *memory, last, timer = found
        return (tuple(memory) if last is not None else None), last, timer

    def _save(self, memory, last, timer) -> None:
        self.memory.update((*(memory if memory is not None else [None] * self.size), last, timer))

    def _frame(self, key, rows: list, late: bool) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *self.columns], dtype=object)
        out["late"] = late
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first, late = None, []
        for pdf in rows:
            new = [tuple(None if x is pd.NA or x is None or x != x else x for x in r) for r in pdf.itertuples(index=False, name=None)]
            new = [tuple(x.item() if hasattr(x, "item") else x for x in r[1:]) for r in new]
            late += [r for r in new if r[0] <= passed]
            new = [r for r in new if r[0] > passed]
            if new:
                self.waiting.appendList(new)
                first = min([r[0] for r in new] + ([first] if first is not None else []))
        if first is not None:
            memory, last, timer = self._state()
            due = -(-first // 1000)
            if timer is None or due < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                self._save(memory, last, due)
        if late:
            yield self._frame(key, [(r[1], *[None] * (len(self.columns) - 1)) for r in late], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        memory, last, _ = self._state()
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] > passed]
        out = []
        if ready:
            memory, out = self.fold(memory, np.array([r[0] for r in ready], np.int64), ready)
            last = int(ready[-1][0])
        if rest:
            self.waiting.put(rest)
            timer = -(-min(r[0] for r in rest) // 1000)
        else:
            self.waiting.clear()
            timer = None if self.keep_us is None else -(-(last + self.keep_us) // 1000)
            if timer is not None and timer * 1000 <= passed:  # nothing that comes can meet this memory
                self.memory.clear()
                if out:
                    yield self._frame(key, out, False)
                return
        if timer is not None:
            self.handle.registerTimer(timer)
        self._save(memory, last, timer)
        if out:
            yield self._frame(key, out, False)


def in_order(stream: DataFrame, key: str, ts: str, row_id: str, values: dict[str, Column], fold: Fold, memory: str,
             out: str, delay: str, keep_us: int | None = None) -> DataFrame:
    """``fold`` over each key of a stream; columns ``key``, ``row_id``, those of ``out``, and ``late``.

    ``values`` are the columns that a fold sees after time and id.  ``memory`` and ``out`` are schemas
    (``out`` without key and id; the fold's output rows begin with the id).  Rows without a time
    are left out; a null key is a key.
    """
    event_time = F.col(ts).cast("timestamp")
    # the column that carries the watermark is not passed on, so that late rows reach the fold's guard
    timed = stream.where(F.col(ts).isNotNull()).withColumn("event_time", event_time).withWatermark("event_time", delay)
    sub = timed.select(F.col(key).alias("key"), F.unix_micros("event_time").alias("t_us"), F.col(row_id).alias("row_id"),
                       *[c.alias(n) for n, c in values.items()])
    extra = T.StructType.fromDDL(out)
    schema = T.StructType([sub.schema["key"], sub.schema["row_id"], *extra.fields, T.StructField("late", T.BooleanType())])
    rows = T.StructType([sub.schema[c] for c in sub.columns if c != "key"])
    p = InOrder(rows, T.StructType.fromDDL(memory), ["row_id", *extra.names], fold, keep_us)
    return sub.groupBy("key").transformWithStateInPandas(p, schema, "Append", "EventTime")


def throttle_fold(step: int) -> Fold:
    """Keep a row only if ``step`` microseconds have passed since the last kept one."""
    def fold(memory, t, rows):
        last = None if memory is None else memory[0]
        i = 0 if last is None else int(np.searchsorted(t, last + step))
        out = []
        while i < len(t):
            last = int(t[i])
            out.append((rows[i][1],))
            i = max(i + 1, int(np.searchsorted(t, last + step)))  # one step per kept row
        return (last,), out
    return fold


def batch_fold(batch_size: int, max_tokens: int, gap_us: float, min_early: int) -> Fold:
    """Cut rows (time, id, tokens) into batches; memory: number, rows and tokens of the open batch, last time."""
    def fold(memory, t, rows):
        no, n, s, before = memory if memory is not None else (0, 0, 0, None)
        tokens = np.array([r[2] or 0 for r in rows], np.int64)
        total = np.concatenate([[0], np.cumsum(tokens)])
        wide = np.flatnonzero(np.diff(t, prepend=t[0] if before is None else before) > gap_us)  # rows after a long gap
        out, i = [], 0
        while i < len(t):
            ends = []  # the first row at which each rule closes the open batch, in the order of precedence
            k = np.searchsorted(wide, i + max(0, min_early - 1 - n))
            ends.append((int(wide[k]) if k < len(wide) else len(t), "early"))
            ends.append((int(np.searchsorted(total[i + 1:], max_tokens - s + total[i], "right")) + i, "tokens"))
            ends.append((i + batch_size - n - 1, "full"))
            end, why = min(ends, key=lambda e: e[0])
            stop = min(end + 1, len(t))
            out += [(rows[j][1], no, n + j - i + 1, int(s + total[j + 1] - total[i]), why if j == end else None) for j in range(i, stop)]
            n, s = n + stop - i, int(s + total[stop] - total[i])
            if end < len(t):
                no, n, s = no + 1, 0, 0
            i = stop
        return (no, n, s, int(t[-1])), out
    return fold


def change_fold():
    """Rows whose value differs from the one before; the first counts.  Memory: the last value."""
    def fold(memory, t, rows):
        out, last, seen = [], None if memory is None else memory[0], memory is not None
        for r in rows:
            if not seen or r[2] != last:
                out.append((r[1], r[2], last))
            last, seen = r[2], True
        return (last,), out
    return fold
