"""Queries of §2.6 over ``events``: feed/job key = user_id, tokens = 1 + event_id % 120.

Binding parameters: batch size 20 chunks, token cap 1000, early-close gap
12 h (the reference's 90 s would close every per-user batch early on this data).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import batching
from postlens.plans.registry import register
from postlens.tables import Tables

BATCH_SIZE, MAX_TOKENS, GAP_S = 20, 1000, 43200


def _events(t: Tables):
    return t.events.withColumn("tokens", 1 + F.col("event_id") % 120)


def _assembled(spark, sf):
    return batching.assemble_batches(_events(Tables(spark, sf)), "user_id", "ts", "event_id", "tokens",
                                     BATCH_SIZE, MAX_TOKENS, GAP_S)


ASSEMBLE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS feed, event_id AS row_id, 1 + event_id % 120 AS tok,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
    coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap
  FROM events),
r AS (
  SELECT feed, row_id, rn, CAST(0 AS BIGINT) AS batch_no, CAST(1 AS BIGINT) AS n, CAST(tok AS BIGINT) AS s,
    CASE WHEN gap > {GAP_S * 1000000} AND 1 >= 5 THEN 'early' WHEN tok > {MAX_TOKENS} THEN 'tokens'
         WHEN 1 >= {BATCH_SIZE} THEN 'full' END AS reason
  FROM e WHERE rn = 1
  UNION ALL
  SELECT feed, row_id, rn, batch_no, n, s,
    CASE WHEN gap > {GAP_S * 1000000} AND n >= 5 THEN 'early' WHEN s > {MAX_TOKENS} THEN 'tokens'
         WHEN n >= {BATCH_SIZE} THEN 'full' END
  FROM (SELECT e.feed, e.row_id, e.rn, e.gap,
          CASE WHEN r.reason IS NOT NULL THEN r.batch_no + 1 ELSE r.batch_no END AS batch_no,
          CASE WHEN r.reason IS NOT NULL THEN 1 ELSE r.n + 1 END AS n,
          CASE WHEN r.reason IS NOT NULL THEN e.tok ELSE r.s + e.tok END AS s
        FROM r JOIN e ON e.feed = r.feed AND e.rn = r.rn + 1) x),
asm AS (SELECT feed, row_id, batch_no, n AS chunk_in_batch, s AS tokens_in_batch, reason AS close_reason FROM r)"""


@register("assemble_batches", ASSEMBLE_SQL + "\nSELECT * FROM asm")
def _assemble(spark, sf):
    return _assembled(spark, sf)


@register("batch_order_check", ASSEMBLE_SQL + """
SELECT feed, batch_no, count(*) AS n_chunks, max(tokens_in_batch) AS tokens,
  coalesce(max(close_reason), 'open') AS close_reason FROM asm GROUP BY feed, batch_no""")
def _order_check(spark, sf):
    return batching.batch_close_reason(_assembled(spark, sf))


@register("inter_arrival", """
SELECT event_id, user_id,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_seconds
FROM events""")
def _gaps(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return batching.inter_arrival(e, "user_id", "ts", "event_id").select("event_id", "user_id", "gap_seconds")


@register("running_tokens", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day,
  row_number() OVER w AS chunks_so_far, CAST(sum(1 + event_id % 120) OVER w AS BIGINT) AS tokens_so_far
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _running(spark, sf):
    e = _events(Tables(spark, sf)).select("event_id", "user_id", "ts", "tokens").withColumn("day", F.to_date("ts"))
    r = batching.running_tokens(e, ["user_id", "day"], "ts", "event_id", "tokens")
    return r.select("event_id", "user_id", "day", "chunks_so_far", F.col("tokens_so_far").cast("long"))


@register("job_step_status", """
SELECT user_id, event_type, min(ts) AS started, max(ts) AS ended, bool_or(value < 1.0) AS failed,
  CASE WHEN bool_or(value < 1.0) THEN 'failed' ELSE 'done' END AS status,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_s
FROM events GROUP BY user_id, event_type""")
def _steps(spark, sf):
    return batching.job_step_status(Tables(spark, sf).events, "user_id", "event_type", "ts", F.col("value") < 1.0)


@register("attempt_rollup", """
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type <> 'error' AS ok,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt_no FROM events),
b AS (SELECT * FROM a WHERE attempt_no <= 5),
g AS (SELECT user_id, day, min(attempt_no) FILTER (WHERE ok) AS first_ok, count(*) AS n FROM b GROUP BY 1, 2)
SELECT g.user_id, g.day, CAST(coalesce(first_ok, n) AS BIGINT) AS attempts, first_ok IS NOT NULL AS success,
  first_ok IS NULL AND n >= 5 AS gave_up, CASE WHEN b.ok THEN 'ok' ELSE 'failed' END AS last_status
FROM g JOIN b ON g.user_id = b.user_id AND g.day = b.day AND b.attempt_no = coalesce(first_ok, n)""")
def _attempts(spark, sf):
    e = Tables(spark, sf).events.withColumn("day", F.to_date("ts"))
    return batching.attempt_rollup(e, ["user_id", "day"], "ts", "event_id", F.col("event_type") != "error")


@register("latest_jobs", """
SELECT user_id, event_id, item_rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS item_rank
  FROM events) x
WHERE item_rank <= 15""")
def _latest(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", "ts")
    r = batching.latest_jobs(e, "user_id", "ts", "event_id", 15)
    return r.select("user_id", "event_id", F.col("item_rank").cast("long"))
