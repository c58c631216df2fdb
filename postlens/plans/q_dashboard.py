"""Queries of §2.9: event-log folding, alerts and dashboard tables over ``events``
(job/intent key = user_id, module/source = event_type, keyword = props.k)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from postlens.operators import dashboard, statelog, stats
from postlens.plans.registry import ORACLES, register
from postlens.session import checkpoint_dir
from postlens.tables import Tables
from postlens.views import v_updates, v_versions, with_views


@register("fold_state", """
WITH u AS (SELECT user_id AS key, event_id AS seq, event_type FROM events),
r AS (SELECT key, max(seq) FILTER (WHERE event_type = 'signup') AS lr FROM u GROUP BY key),
a AS (SELECT u.key, max(u.seq) FILTER (WHERE u.event_type = 'view' AND u.seq > coalesce(r.lr, -1)) AS last_view,
        count(*) FILTER (WHERE u.event_type = 'error' AND u.seq > coalesce(r.lr, -1)) AS n_err, max(r.lr) AS lr
      FROM u JOIN r ON u.key = r.key GROUP BY u.key)
SELECT key, 'total' AS path, CAST(max(seq) AS VARCHAR) AS value FROM u WHERE event_type = 'purchase' GROUP BY key
UNION ALL SELECT key, 'jobs.b', CAST(max(seq) AS VARCHAR) FROM u WHERE event_type = 'click' GROUP BY key
UNION ALL SELECT key, 'jobs.a.n', CAST(last_view AS VARCHAR) FROM a WHERE last_view IS NOT NULL
UNION ALL SELECT key, 'jobs.a.err', '{}' FROM a WHERE n_err > 0
UNION ALL SELECT key, 'jobs.a', 'reset' FROM a WHERE lr IS NOT NULL AND last_view IS NULL AND n_err = 0""")
def _fold(spark, sf):
    return statelog.fold_state(v_updates(Tables(spark, sf)))


@register("fold_state_incremental")
def _fold_incremental(spark, sf):
    """Three snapshots one after the other, each from the last one and the updates after it."""
    updates = v_updates(Tables(spark, sf))
    folder = os.path.join(checkpoint_dir(spark), f"state-{uuid.uuid4().hex}")
    last = updates.agg(F.max("seq")).first()[0] or 0
    for part in (1, 2, 3):
        state = statelog.compact_state(updates.where(F.col("seq") <= last * part // 3), folder)
    return state.select("key", statelog.path_text(F.col("path")).alias("path"), "value")


ORACLES["fold_state_incremental"] = ORACLES["fold_state"]


@register("state_path", """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing.x') AS missing_x
FROM events""")
def _state_path(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "props")
    e = statelog.state_path(e, "props", "k")
    return statelog.state_path(e, "props", "missing.x", "missing_x").select("event_id", "k", "missing_x")


TB_SQL = ("['Traceback (most recent call last):', '  File \"collector_' || CAST(user_id % 7 AS VARCHAR) || "
          "'.py\", line ' || CAST(10 + user_id % 3 AS VARCHAR), 'ValueError: bad item']")


def _error_events(t: Tables):
    e = t.events.where(F.col("event_type") == "error")
    lines = F.array(F.lit("Traceback (most recent call last):"),
                    F.concat(F.lit('  File "collector_'), (F.col("user_id") % 7).cast("string"), F.lit('.py", line '),
                             (F.lit(10) + F.col("user_id") % 3).cast("string")),
                    F.lit("ValueError: bad item"))
    return e.select("event_id", "ts", F.col("user_id").alias("intent_id"), lines.alias("traceback"),
                    F.concat(F.lit("collector_"), (F.col("user_id") % 7).cast("string")).alias("module"))


@register("error_fingerprint", f"""
SELECT event_id, sha256(array_to_string({TB_SQL}, chr(10))) AS error_id FROM events WHERE event_type = 'error'""")
def _fingerprint(spark, sf):
    return statelog.error_fingerprint(_error_events(Tables(spark, sf))).select("event_id", "error_id")


@register("error_rollup", f"""
SELECT sha256(array_to_string({TB_SQL}, chr(10))) AS error_id, min('collector_' || CAST(user_id % 7 AS VARCHAR)) AS module,
  count(*) AS occurrences, count(DISTINCT user_id) AS intents, min(ts) AS first_seen, max(ts) AS last_seen
FROM events WHERE event_type = 'error' GROUP BY 1""")
def _rollup(spark, sf):
    return statelog.error_rollup(statelog.error_fingerprint(_error_events(Tables(spark, sf))))


@register("keyword_spread", """
WITH g AS (SELECT event_type AS module, json_extract_string(props, '$.k') AS keyword, count(*) AS n FROM events
           WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2)
SELECT module, keyword, n, CAST((n * 20000 + sum(n) OVER (PARTITION BY module)) // (sum(n) OVER (PARTITION BY module) * 2)
  AS DOUBLE) / 100 AS pct FROM g""")
def _spread(spark, sf):
    e = Tables(spark, sf).events.select(F.col("event_type").alias("module"),
                                        F.get_json_object("props", "$.k").alias("keyword"))
    return dashboard.keyword_spread(e, "module", "keyword")


@register("intent_summary", """
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS start, arg_min(event_type, ts) AS module,
             count(*) FILTER (WHERE event_type <> 'error') AS collections,
             count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2)
SELECT *, (epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY user_id ORDER BY start))) / 1e6 AS gap_seconds
FROM g""")
def _intents(spark, sf):
    e = Tables(spark, sf).events.withColumn("day", F.to_date("ts"))
    return dashboard.intent_summary(e, ["user_id", "day"], "ts", "event_type", F.col("event_type") == "error",
                                    "user_id")


def _age_sql():
    units = dashboard.AGE_UNITS
    parts = ["CASE WHEN diff < 60000000 THEN 'Just now'"]

    def lab(u, s):
        return (f"CAST(diff // {s} AS VARCHAR) || ' {u}' || CASE WHEN diff // {s} > 1 THEN 's' ELSE '' END || ' ago'")
    for (u, s), (_, nxt) in zip(units[:-1], units[1:]):
        parts.append(f"WHEN diff < {nxt} THEN {lab(u, s)}")
    parts.append(f"ELSE {lab(*units[-1])} END")
    return " ".join(parts)


@register("relative_age", f"""
WITH d AS (SELECT event_id, epoch_us(a) - epoch_us(ts) AS diff FROM events, (SELECT max(ts) AS a FROM events) m)
SELECT event_id, {_age_sql()} AS age FROM d""")
def _age(spark, sf):
    e = Tables(spark, sf).events
    return dashboard.relative_age(e.select("event_id", "ts"), "ts", stats.resolve_as_of(e)).select("event_id", "age")


@register("preview_text", """
SELECT doc_id,
  CASE WHEN length(text) <= 40 THEN text ELSE substring(text, 1, 18) || '...' || substring(text, length(text) - 18, 19) END
    AS middle,
  CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS p50,
  CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS p100
FROM documents""")
def _preview(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", dashboard.middle_ellipsis("text", 40).alias("middle"),
                    dashboard.prefix_ellipsis("text", 50).alias("p50"),
                    dashboard.prefix_ellipsis("text", 100).alias("p100"))


@register("daily_checkpoint", """
SELECT day, hour, event_id, ts FROM (
  SELECT CAST(ts AS DATE) AS day, h AS hour, event_id, ts,
         row_number() OVER (PARTITION BY CAST(ts AS DATE), h ORDER BY ts, event_id) AS rn
  FROM events JOIN (VALUES (12), (19)) hv(h) ON hour(ts) >= h) x WHERE rn = 1""")
def _checkpoint(spark, sf):
    return statelog.daily_checkpoint(Tables(spark, sf).events, "ts", "event_id", (12, 19))


@register("time_grid", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, minute(min(ts)) AS m FROM events GROUP BY 1)
SELECT day, slot, lpad(CAST(((m + 30 * slot) // 60) % 24 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST((m + 30 * slot) % 60 AS VARCHAR), 2, '0') AS time
FROM s JOIN generate_series(0, 47) g(slot) ON true""")
def _grid(spark, sf):
    e = Tables(spark, sf).events
    starts = e.groupBy(F.to_date("ts").alias("day")).agg(F.minute(F.min("ts")).alias("m"))
    g = statelog.time_grid(starts, "m", 30)
    return g.select("day", F.col("slot").cast("long").alias("slot"), "time")


@register("throttle", """
WITH RECURSIVE e AS (SELECT event_type AS key, event_id, ts,
                       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, event_id, ts, rn, ts AS last_emit, true AS emitted FROM e WHERE rn = 1
      UNION ALL
      SELECT e.key, e.event_id, e.ts, e.rn,
             CASE WHEN e.ts - r.last_emit >= INTERVAL 24 HOUR THEN e.ts ELSE r.last_emit END,
             e.ts - r.last_emit >= INTERVAL 24 HOUR
      FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
SELECT event_id, key AS event_type, ts FROM r WHERE emitted""")
def _throttle(spark, sf):
    e = Tables(spark, sf).events
    return statelog.throttle(e, "event_type", "ts", "event_id", 24).select("event_id", "event_type", "ts")


@register("change_events", """
SELECT o_custkey, o_orderkey, o_orderstatus, prev_o_orderstatus FROM (
  SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x
WHERE rn = 1 OR prev_o_orderstatus IS DISTINCT FROM o_orderstatus""")
def _changes(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    c = statelog.change_events(o, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return c.select("o_custkey", "o_orderkey", "o_orderstatus", "prev_o_orderstatus")


@register("outdated_versions", with_views("""
SELECT module, installed, latest,
  list_transform(string_split(regexp_replace(installed, '^v', ''), '.'), lambda x: CAST(x AS INTEGER)) <
  list_transform(string_split(regexp_replace(latest, '^v', ''), '.'), lambda x: CAST(x AS INTEGER)) AS outdated
FROM V_versions""", "V_versions"))
def _outdated(spark, sf):
    return dashboard.outdated_versions(v_versions(Tables(spark, sf)))
