"""Event-log folding, alert throttles and change detection (§2.9).

``fold_state`` turns an append-only log of nested JSON updates into the
current state without replaying it on one machine: each update is flattened
to leaves ``(path, value, seq)`` and a leaf survives unless a later leaf
overwrites it (the deep-merge rule written as equi joins on path prefixes).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.ordering import previous, running
from postlens.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Objects are merged down to this depth; what lies deeper is one leaf of JSON text.
MAX_DEPTH = 500
_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:])|(\"(?:[^\"\\]|\\.)*\"|[^\s{}\[\],:\"]+))", re.S)
_LONE = re.compile("[\ud800-\udfff]")


class _Raw(str):
    """JSON text that is written as it is: a number in the spelling of its document, or punctuation."""


def _scalar(js: str):
    return json.loads(js, parse_float=_Raw, parse_int=_Raw, parse_constant=_Raw)


def _nested(js: str):
    """What ``_scalar`` gives, for a document nested deeper than Python's own parser goes."""
    top, at, want = [], 0, "value"  # want: first (of a container), value, key, colon, next
    open_, keys = [top], [None]
    while m := _TOKEN.match(js, at):
        at, sign, token = m.end(), m[1], m[2]
        inside = isinstance(open_[-1], dict)
        if token and inside and want in ("first", "key"):
            if token[0] != '"':
                raise ValueError("a key is no string")
            keys[-1], want = _scalar(token), "colon"
        elif (token or sign in ("{", "[")) and (want == "value" or want == "first" and not inside):
            v = _scalar(token) if token else {} if sign == "{" else []
            if inside:
                open_[-1][keys[-1]] = v
            else:
                open_[-1].append(v)
            want = "next"
            if sign:
                open_.append(v)
                keys.append(None)
                want = "first"
        elif sign in ("}", "]") and len(open_) > 1 and inside == (sign == "}") and want in ("first", "next"):
            open_.pop()
            keys.pop()
            want = "next"
        elif sign == "," and want == "next" and len(open_) > 1:
            want = "key" if inside else "value"
        elif sign == ":" and want == "colon":
            want = "value"
        else:
            raise ValueError(f"unexpected {m[0]!r}")
    if js[at:].strip(" \t\n\r") or want != "next" or len(open_) > 1:
        raise ValueError("the document does not end here")
    return top[0]


def _parse(js: str):
    try:
        return _scalar(js)
    except RecursionError:
        return _nested(js)


def _leaves(js: str | None) -> list[dict]:
    """Leaves of one JSON object: path, value as text, and whether it is an empty object."""
    out, stack = [], []
    try:
        stack = [((), _parse(js))] if js else []
    except ValueError:
        return []
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict) and v and len(path) < MAX_DEPTH:
            stack.extend(((*path, _utf8(k)), x) for k, x in v.items())
        elif path:
            out.append({"path": list(path), "value": _text(v), "empty": v == {} and isinstance(v, dict)})
    return out


def _utf8(s: str) -> str:
    """Lone surrogates, which no UTF-8 text can hold, become U+FFFD."""
    return str(s) if s.isascii() else _LONE.sub("\ufffd", s)


def _text(v) -> str | None:
    """Scalars as they are, null as null, lists and objects as compact JSON."""
    if v is None or isinstance(v, str):
        return None if v is None else _utf8(v)
    return _utf8(_json(v))


def _json(v) -> str:
    """Compact JSON of a value of any depth."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            stack.append(_Raw("}"))
            for i, (k, y) in reversed(list(enumerate(x.items()))):
                stack += [y, _Raw(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
            stack.append(_Raw("{"))
        elif isinstance(x, list):
            stack.append(_Raw("]"))
            for i, y in reversed(list(enumerate(x))):
                stack += [y, _Raw("," if i else "")]
            stack.append(_Raw("["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def json_leaves(df: DataFrame, key: str, seq: str, js: str) -> DataFrame:
    """Flatten JSON objects to leaves ``(key, seq, path array<string>, value, empty)``.

    A leaf is a scalar, a list (kept as JSON text) or an empty object ``{}``; a string that
    looks like JSON stays a string.  Documents may be nested to any depth; an object at depth
    ``MAX_DEPTH`` is one leaf, its JSON text.  Null and invalid documents have no leaves; a
    lone surrogate becomes U+FFFD.
    """
    def parse(s: pd.Series) -> pd.Series:
        return pd.Series([_leaves(x) for x in s], dtype=object)

    leaves = F.pandas_udf(parse, "array<struct<path:array<string>,value:string,empty:boolean>>", F.PandasUDFType.SCALAR)
    return df.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.inline(leaves(F.col(js))))


def path_text(path: Column) -> Column:
    """Dotted path; dots and backslashes inside a key are escaped by a backslash."""
    return F.array_join(F.transform(path, lambda k: F.regexp_replace(k, r"([.\\])", r"\\$1")), ".")


def _strict_prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.slice(path, F.lit(1), i))


def fold_leaves(updates: DataFrame, key: str = "key", seq: str = "seq", js: str = "json",
                snapshot: DataFrame | None = None) -> DataFrame:
    """Surviving leaves ``(key, path array<string>, value, empty, seq)`` after the updates in ``seq``
    order with the deep-merge rule (dict into dict merges, anything else replaces).

    ``snapshot`` is the result of an earlier fold: the updates (all of them later than it) go
    on from there, so that the log before it need not be read again.  Only the last leaf of a
    ``(key, path)`` can survive, so one aggregate (combined before the shuffle, so a hot key or
    counter costs a row per task) reduces the log to the size of the state; the tests below run
    on that.  A leaf written at ``s`` is dead when a later leaf extends its path, or sits at a
    strict prefix of its path and is not ``{}``; a surviving ``{}`` with a surviving extension
    is dropped.  A null key is a key like any other; of one ``seq`` given twice the greater
    value stands.
    """
    log = json_leaves(updates, key, seq, js)
    if snapshot is not None:
        log = log.unionByName(snapshot.select("key", "seq", "path", "value", "empty"))
    # a struct, so that null keys meet in the joins
    last = log.withColumn("key", F.struct("key")).groupBy("key", "path").agg(
        F.max(F.struct("seq", "value", "empty")).alias("leaf"),
        F.max(F.when(~F.col("empty"), F.col("seq"))).alias("full_seq"))
    last = last.select("key", "path", "leaf.value", "leaf.empty", "leaf.seq", "full_seq")
    deep = last.where(F.size("path") > 1).select("key", "path", "seq", F.explode(_strict_prefixes(F.col("path"))).alias("up"))
    below = deep.groupBy("key", F.col("up").alias("path")).agg(F.max("seq").alias("below_seq"))
    above = (deep.join(last.where("full_seq is not null").select("key", F.col("path").alias("up"), "full_seq"), ["key", "up"])
             .groupBy("key", "path").agg(F.max("full_seq").alias("above_seq")))
    alive = (last.drop("full_seq").join(below, ["key", "path"], "left").join(above, ["key", "path"], "left")
             .where(~F.coalesce(F.col("below_seq") > F.col("seq"), F.lit(False))
                    & ~F.coalesce(F.col("above_seq") > F.col("seq"), F.lit(False))))
    inner = (alive.where(F.size("path") > 1).select("key", F.explode(_strict_prefixes(F.col("path"))).alias("path")).distinct()
             .withColumn("inner", F.lit(True)))
    return (alive.join(inner, ["key", "path"], "left").where(~(F.col("empty") & F.col("inner").isNotNull()))
            .select("key.key", "path", "value", "empty", "seq"))


def fold_state(updates: DataFrame, key: str = "key", seq: str = "seq", js: str = "json",
               snapshot: DataFrame | None = None) -> DataFrame:
    """Current state per key (:func:`fold_leaves`) as ``(key, path, value)``, ``path`` as ``path_text``."""
    return fold_leaves(updates, key, seq, js, snapshot).select("key", path_text(F.col("path")).alias("path"), "value")


def compact_state(updates: DataFrame, folder: str, key: str = "key", seq: str = "seq", js: str = "json") -> DataFrame:
    """Fold what the log holds beyond the last snapshot of ``folder`` into a new one, and return it.

    Snapshots are Parquet folders named by the greatest ``seq`` that they cover; a scan of the log needs
    only the updates after it (a filter that reaches the scan).  Without new updates the last
    snapshot is returned as it is.  A job that dies before its snapshot is complete leaves none.
    """
    spark = updates.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    done = max((int(n[4:]) for n in have if n.startswith("seq=") and files.exists(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))), default=None)
    new = updates if done is None else updates.where(F.col(seq) > done)
    upto = new.agg(F.max(seq)).first()[0]
    if upto is None:
        return spark.read.parquet(f"{folder}/seq={done}") if done is not None else fold_leaves(new, key, seq, js)
    old = None if done is None else spark.read.parquet(f"{folder}/seq={done}")
    # what arrives while this runs belongs to the next snapshot
    fold_leaves(new.where(F.col(seq) <= upto), key, seq, js, old).write.mode("overwrite").parquet(f"{folder}/seq={upto}")
    return spark.read.parquet(f"{folder}/seq={upto}")


def state_path(df: DataFrame, js: str, path: str, out: str | None = None) -> DataFrame:
    """Value at a dotted path of a JSON document, or null."""
    return df.withColumn(out or path, F.get_json_object(F.col(js), "$." + path))


def error_fingerprint(df: DataFrame, lines: str = "traceback", out: str = "error_id") -> DataFrame:
    """SHA-256 of the traceback lines joined by newlines."""
    return df.withColumn(out, F.sha2(F.array_join(F.col(lines), "\n"), 256))


def error_rollup(errors: DataFrame, error_id: str = "error_id", module: str = "module",
                 intent: str = "intent_id", ts: str = "ts") -> DataFrame:
    """Per fingerprint: module, occurrences, distinct intents, first/last seen."""
    return errors.groupBy(error_id).agg(
        F.min(module).alias("module"), F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(intent).alias("intents"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def throttle(df: DataFrame, key: str, ts: str, row_id: str, hours: float, bucket_seconds: float = 60) -> DataFrame:
    """Per key, keep an event only if at least ``hours`` passed since the last
    **kept** event (the first event always passes).

    Every event has one successor, the first event at least ``hours`` later, and the
    kept events are the chain of successors from the key's first event.  Successors are
    found in time buckets (a bucket's probes meet its events; else the next bucket that
    has events, from a table bounded by the time span), and the chain by pointer
    doubling: ``log2(time span / hours)`` equi joins on key and time, so a hot key is
    spread over all tasks.  Events without a time are left out.
    """
    step = int(round(hours * 3600 * 1_000_000))
    timed = df.where(F.col(ts).isNotNull())
    if step <= 0:
        return timed
    checkpoint_dir(df.sparkSession)
    # a struct, so that a null key is a key like any other; of events at one time only the first can be kept
    sub = timed.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(row_id).alias("row_id"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    ev = sub.groupBy("key", "t").agg(F.min("row_id").alias("row_id")).checkpoint()
    low, high = ev.agg(F.min("t"), F.max("t")).first()
    rounds = ((high - low) // step).bit_length() if low is not None else 0  # a chain has at most (high - low) / step + 1 events
    bucket = F.floor(F.col("x") / F.lit(max(1, int(bucket_seconds * 1_000_000)))).cast("long")
    real = ev.select("key", F.col("t").alias("x"), F.lit(None).cast("long").alias("t"))
    points = real.unionByName(ev.select("key", (F.col("t") + step).alias("x"), "t")).withColumn("b", bucket)
    found = F.min(F.when(F.col("t").isNull(), F.col("x")))
    # from the end backwards: a frame that grows costs one step a row, one that shrinks is summed up anew for each
    here = Window.partitionBy("key", "b").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("key").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    after = points.groupBy("key", "b").agg(found.alias("head")).select("key", "b", F.min("head").over(later).alias("after"))
    jump = (points.withColumn("to", found.over(here)).where("t is not null").join(after, ["key", "b"])
            .select("key", "t", F.coalesce("to", "after").alias("to")).where("`to` is not null").checkpoint())
    chain = ev.groupBy("key").agg(F.min("t").alias("t"))
    for k in range(rounds):
        chain = chain.unionByName(chain.join(jump, ["key", "t"]).select("key", F.col("to").alias("t"))).checkpoint()
        if k + 1 < rounds:
            jump = (jump.join(jump.select("key", F.col("t").alias("to"), F.col("to").alias("to2")), ["key", "to"])
                    .select("key", "t", F.col("to2").alias("to")).checkpoint())
    kept = ev.join(chain, ["key", "t"]).select(F.col("row_id").alias("_rid"))
    return timed.join(kept, F.col(row_id) == F.col("_rid"), "left_semi")


def change_events(df: DataFrame, key: str, ts: str, tie: str, col: str) -> DataFrame:
    """Rows whose ``col`` differs from the previous row of the same key (the
    first row of a key always counts).  The previous row is found by rank
    (skew-safe :func:`running`) and an equi join, not a window over the key."""
    r = running(df, [key], [ts, tie])
    r = previous(r, [key], [col])
    return r.where(~F.col(col).eqNullSafe(F.col("prev_" + col)) | (F.col("rank") == 1)).drop("rank")


def daily_checkpoint(df: DataFrame, ts: str, row_id: str, hours: Sequence[int] = (12, 19)) -> DataFrame:
    """For every day and listed hour, the first event at or after that hour of the day."""
    hs = F.array(*[F.lit(int(h)) for h in hours])
    x = df.select(F.to_date(ts).alias("day"), F.explode(F.filter(hs, lambda h: F.hour(ts) >= h)).alias("hour"),
                  F.struct(F.col(ts).alias("ts"), F.col(row_id).alias("row_id")).alias("_e"))
    g = x.groupBy("day", "hour").agg(F.min("_e").alias("_e"))
    return g.select("day", "hour", F.col("_e.row_id").alias(row_id), F.col("_e.ts").alias(ts))


def time_grid(starts: DataFrame, minute: str, interval_minutes: int = 30, end_hour: int = 23) -> DataFrame:
    """Times every ``interval_minutes`` starting at hour 0 and the given minute;
    ``(end_hour * 60) // interval + 2`` slots (48 for 30 minutes)."""
    n = (end_hour * 60) // interval_minutes + 2
    x = starts.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot", "_i")).drop("_i")
    tot = F.col(minute) + F.col("slot") * interval_minutes
    hh = F.pmod(F.floor(tot / 60), F.lit(24))
    mm = F.pmod(tot, F.lit(60))
    return x.withColumn("time", F.format_string("%02d:%02d", hh.cast("int"), mm.cast("int")))
