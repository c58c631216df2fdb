"""Trailing-window counts, per-source statistics and quota layers.

The reference keeps, per key, an in-memory queue of timestamps that is purged to
the last 24 hours and counted on demand.  Here the occurrences are an event
table ``(key, ts)`` and every statistic is one aggregate over it:

* the time bound is a filter on ``ts`` (pushed into the parquet scan),
* counts are partial aggregates (map-side combine before the shuffle),
* ``as_of`` is a parameter or a scalar subquery ``max(ts)``, never wall clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions.dims import param_table
from postlens.functions.ordering import same

RETENTION_HOURS = 24  # counters are always purged to 24 h; longer periods are capped


def resolve_as_of(events: DataFrame, ts: str = "ts", as_of=None) -> Column:
    """``as_of`` as a column: a literal when given, else the scalar subquery ``max(ts)``."""
    if as_of is None:
        return events.select(F.max(ts)).scalar()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def window_bounds(events: DataFrame, ts: str, as_of, hours: float) -> tuple[Column, Column]:
    """``(as_of - hours, as_of)`` as columns.  With ``as_of`` unset each bound is
    its own scalar subquery, so both comparisons reach the parquet reader as
    pushed filters (an expression over a subquery would not)."""
    if as_of is None:
        hi = events.select(F.max(ts)).scalar()
        lo = events.select(F.max(ts) - _hours(hours)).scalar()
        return lo, hi
    a = resolve_as_of(events, ts, as_of)
    return a - _hours(hours), a


def _hours(h: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(h) * 3600.0))


def _effective_hours(period_hours: float) -> float:
    return min(float(period_hours), float(RETENTION_HOURS))


def retention_24h(events: DataFrame, ts: str = "ts", as_of=None) -> DataFrame:
    """Keep occurrences in ``[as_of - 24h, as_of]`` (both bounds inclusive)."""
    lo, hi = window_bounds(events, ts, as_of, RETENTION_HOURS)
    return events.where((F.col(ts) >= lo) & (F.col(ts) <= hi))


def trailing_count(events: DataFrame, key: str = "event_type", ts: str = "ts", as_of=None,
                   period_hours: float = 24) -> DataFrame:
    """Per key, occurrences with ``ts >= as_of - least(period, 24h)``."""
    lo, hi = window_bounds(events, ts, as_of, _effective_hours(period_hours))
    return (events.where((F.col(ts) >= lo) & (F.col(ts) <= hi))
            .groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")))


def trailing_count_per_row(events: DataFrame, key: str = "event_type", ts: str = "ts",
                           row_id: str = "event_id", period_hours: float = 24,
                           bucket_seconds: int = 60) -> DataFrame:
    """At every event, the number of same-key events in ``[ts - p, ts]``.

    ``count().over(partitionBy(key).orderBy(ts).rangeBetween(-p, 0))`` would put a
    whole key into one task, which fails on a hot key.  Here time is cut into
    buckets of ``B = bucket_seconds`` with ``p = m * B``.  For an event in bucket
    ``b`` the window ``[ts - p, ts]`` is

    * the events of bucket ``b`` at or before ``ts`` (window over key *and* bucket),
    * all events of buckets ``b-m+1 .. b-1`` (a range window over the per-bucket
      count table, whose size per key is bounded by time span / B, not by volume),
    * the events of bucket ``b-m`` at or after ``ts - p`` (a probe row placed in
      that bucket, counted in the same key-and-bucket window, joined back by id).

    A null key is a key, rows of one id count each, and an event without a time counts 0.
    """
    p_us = int(round(_effective_hours(period_hours) * 3600 * 1_000_000))
    b_us = int(bucket_seconds) * 1_000_000
    if p_us % b_us:
        raise ValueError("period must be a whole number of buckets")
    m = p_us // b_us
    ev = events.select(F.col(row_id).alias("_id"), F.col(key).alias("_k"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("_x"))
    ev = ev.withColumn("_b", F.floor(F.col("_x") / F.lit(b_us)))

    per_bucket = ev.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    if m > 1:
        wm = Window.partitionBy("_k").orderBy("_b").rangeBetween(-(m - 1), -1)
        mid = F.coalesce(F.sum("_n").over(wm), F.lit(0))
    else:
        mid = F.lit(0).cast("long")
    middle = per_bucket.select("_k", "_b", mid.alias("_mid"))

    real = ev.select("_id", "_k", "_x", "_b", F.lit(1).alias("_real"))
    probe = ev.select("_id", "_k", (F.col("_x") - F.lit(p_us)).alias("_x"),
                      (F.col("_b") - F.lit(m)).alias("_b"), F.lit(0).alias("_real"))
    pts = real.unionByName(probe)
    up = Window.partitionBy("_k", "_b").orderBy(F.col("_x").asc()).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_k", "_b").orderBy(F.col("_x").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ranked = pts.select("_id", "_k", "_x", "_b", "_real",
                        F.sum("_real").over(up).alias("_upto"), F.sum("_real").over(down).alias("_from"))
    top = ranked.where(F.col("_real") == 1).select("_id", "_k", "_x", "_b", "_upto")
    # rows of one id, key and time have one probe between them
    low = (ranked.where(F.col("_real") == 0).groupBy(F.col("_id").alias("_pid"), F.col("_k").alias("_pk"), (F.col("_x") + p_us).alias("_px"))
           .agg(F.max("_from").alias("_from")))
    middle = middle.select(F.col("_k").alias("_mk"), F.col("_b").alias("_mb"), "_mid")
    res = (top.join(middle, same([F.col("_k"), F.col("_b")], [F.col("_mk"), F.col("_mb")]), "left")
           .join(low, same([F.col("_id"), F.col("_k"), F.col("_x")], [F.col("_pid"), F.col("_pk"), F.col("_px")]), "left"))
    n = F.when(F.col("_x").isNull(), F.lit(0)).otherwise(
        F.col("_upto") + F.coalesce(F.col("_mid"), F.lit(0)) + F.coalesce(F.col("_from"), F.lit(0)))
    return res.select(F.col("_id").alias(row_id), F.col("_k").alias("key"), n.cast("long").alias("n"))


def last_n_count(events: DataFrame, n: int = 30, key: str = "event_type") -> DataFrame:
    """``least(n, count)`` per key (the reference counts per key, not over the last n rows)."""
    return events.groupBy(F.col(key).alias("key")).agg(
        F.least(F.lit(n).cast("long"), F.count(F.lit(1))).alias("n_last"))


# Fallback domain -> source alias table of the reference
# (used when the remote table cannot be read).  One row is corrected: the
# reference maps nostr.com to forocoches; the corrected default maps it to nostr
# and the reference row is kept in REFERENCE_ALIAS_FIX for the legacy behaviour.
DEFAULT_ALIASES = [
    ("4chan", "4chan"),
    ("4channel.org", "4chan"),
    ("reddit.com", "reddit"),
    ("twitter.com", "twitter"),
    ("t.co", "twitter"),
    ("x.com", "twitter"),
    ("youtube.com", "youtube"),
    ("yt.co", "youtube"),
    ("mastodon.social", "mastodon"),
    ("mastodon", "mastodon"),
    ("weibo.com", "weibo"),
    ("weibo.org", "weibo"),
    ("nostr.social", "nostr"),
    ("nostr.com", "nostr"),
    ("jeuxvideo.com", "jvc"),
    ("forocoches.com", "forocoches"),
    ("bitcointalk.org", "bitcointalk"),
    ("ycombinator.com", "hackernews"),
    ("tradingview.com", "tradingview"),
    ("followin.in", "followin"),
    ("seekingalpha.io", "seekingalpha"),
    ("threads.net", "threads"),
    ("bsky.app", "bluesky"),
    ("bsky.social", "bluesky"),
    ("bluesky.social", "bluesky"),
]
REFERENCE_ALIAS_FIX = ("nostr.com", "forocoches")


def alias_table(spark: SparkSession, rows=None, legacy: bool = False) -> DataFrame:
    rows = list(rows or DEFAULT_ALIASES)
    if legacy:
        rows = [REFERENCE_ALIAS_FIX if r[0] == REFERENCE_ALIAS_FIX[0] else r for r in rows]
    return param_table(spark, rows, "domain string, alias string")


def domain_alias(items: DataFrame, aliases: DataFrame, domain: str = "domain") -> DataFrame:
    """Attach ``alias``; unknown domains (exact match only) become ``other``."""
    a = aliases.select(F.col("domain").alias("_a_domain"), F.col("alias").alias("_a_alias"))
    j = items.join(a, items[domain] == a["_a_domain"], "left")
    return j.withColumn("alias", F.coalesce(F.col("_a_alias"), F.lit("other"))).drop("_a_domain", "_a_alias")


def contribution_count(items: DataFrame, aliases: DataFrame, domain: str = "domain") -> DataFrame:
    """Items per source alias under the ``rep_`` counter key."""
    return (domain_alias(items.select(domain), aliases, domain)
            .groupBy(F.concat(F.lit("rep_"), F.col("alias")).alias("rep_key"))
            .agg(F.count(F.lit(1)).alias("n")))


def source_stats(events: DataFrame, weights: DataFrame, as_of=None, quotas: DataFrame | None = None,
                 only: str = "", key: str = "event_type", ts: str = "ts",
                 contribution: Column | None = None, last_n: int = 30) -> DataFrame:
    """One row per weighted source plus ``other``: weight, quota and only layers,
    24 h / 1 h counts, last-``n`` count and 24 h contributions.

    One pass over the 24 h slice of the event table (conditional partial
    aggregates), then small joins against the parameter tables.  Event keys
    that have no weight are counted under ``other``.
    """
    a = resolve_as_of(events, ts, as_of)
    lo, hi = window_bounds(events, ts, as_of, RETENTION_HOURS)
    contribution = F.lit(False) if contribution is None else contribution
    recent = events.where((F.col(ts) >= lo) & (F.col(ts) <= hi))
    per_key = recent.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("count_24h"),
        F.count_if(F.col(ts) >= a - _hours(1)).alias("count_1h"),
        F.count_if(contribution).alias("rep_24h"))

    wkeys = weights.select(F.col("source").alias("_wsrc"))
    per_src = (per_key.join(wkeys, per_key["_key"] == wkeys["_wsrc"], "left")
               .groupBy(F.coalesce(F.col("_wsrc"), F.lit("other")).alias("source"))
               .agg(F.sum("count_24h").alias("count_24h"), F.sum("count_1h").alias("count_1h"),
                    F.sum("rep_24h").alias("rep_24h")))

    rows = weights.select("source", F.col("weight").cast("double").alias("weight"))
    other_w = rows.where(F.col("source") == "other").agg(F.max("weight").alias("w"))
    rows = rows.where(F.col("source") != "other").unionByName(
        other_w.select(F.lit("other").alias("source"), F.coalesce(F.col("w"), F.lit(0.0)).alias("weight")))

    out = rows.join(per_src, "source", "left")
    n24 = F.coalesce(F.col("count_24h"), F.lit(0)).cast("long")
    if quotas is not None:
        q = quotas.select(F.col("source").alias("_qsrc"), F.col("quota").cast("double").alias("_quota"))
        out = out.join(q, out["source"] == q["_qsrc"], "left")
        quota = F.when(F.col("_quota").isNull(), 0.0).when(n24 < F.col("_quota"), 1.0).otherwise(0.0)
    else:
        quota = F.lit(0.0)
    onlies = [s for s in only.split(",")] if only else []
    only_c = F.col("source").isin(onlies).cast("double") if onlies else F.lit(0.0)
    return out.select(
        "source", "weight", quota.alias("quota"), only_c.alias("only"),
        n24.alias("count_24h"), F.coalesce(F.col("count_1h"), F.lit(0)).cast("long").alias("count_1h"),
        F.least(F.lit(last_n).cast("long"), n24).alias("count_last_30"),
        F.coalesce(F.col("rep_24h"), F.lit(0)).cast("long").alias("rep_24h"))


def daily_total(stats: DataFrame, legacy_other: bool = True) -> DataFrame:
    """Total contributions over 24 h from ``source_stats``.

    ``legacy_other`` reproduces the reference: ``rep_<source>`` for each
    weighted source but the plain ``other`` counter (not ``rep_other``).
    """
    other_term = F.col("count_24h") if legacy_other else F.col("rep_24h")
    return stats.agg(F.sum(F.when(F.col("source") == "other", other_term).otherwise(F.col("rep_24h")))
                     .cast("long").alias("total_24h"))


def inactive_sources(weights: DataFrame, events: DataFrame, key: str = "event_type", ts: str = "ts",
                     as_of=None, period_hours: float = 24) -> DataFrame:
    """Weighted sources without any event in the period (left anti join)."""
    lo, hi = window_bounds(events, ts, as_of, _effective_hours(period_hours))
    active = events.where((F.col(ts) >= lo) & (F.col(ts) <= hi)).select(F.col(key).alias("_k")).distinct()
    w = weights.select("source")
    return w.join(active, w["source"] == active["_k"], "left_anti")


def error_count_by_source(events: DataFrame, is_error: Column, key: str) -> DataFrame:
    """Collection errors per source key."""
    return events.where(is_error).groupBy(F.col(key).alias("source")).agg(F.count(F.lit(1)).alias("errors"))


def quota_layer(quotas: DataFrame, counts: DataFrame) -> DataFrame:
    """``1.0`` while the 24 h count is below the quota, else ``0.0``; a source
    without events has count 0."""
    c = counts.select(F.col("key").alias("_k"), F.col("n").alias("_n"))
    j = quotas.join(c, quotas["source"] == c["_k"], "left")
    return j.select("source", F.when(F.coalesce(F.col("_n"), F.lit(0)) < F.col("quota"), 1.0)
                    .otherwise(0.0).alias("layer"))
