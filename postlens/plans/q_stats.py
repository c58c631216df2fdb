"""Queries of §2.7: trailing counts, statistics and quotas over ``events``.

Event roles: source key = ``event_type``; contribution = ``purchase``;
``as_of`` = ``max(ts)`` (scalar subquery on both sides).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.dims import param_table
from postlens.operators import stats
from postlens.plans.registry import register
from postlens.tables import Tables
from postlens.views import v_items, with_views

# Source weights of the test binding (FIXTURES event roles).
WEIGHTS = [("view", 3.0), ("click", 2.0), ("purchase", 1.0), ("signup", 0.5), ("error", 0.0), ("absent", 1.0)]
# Job parameters of the test binding.
QUOTAS = [("view", 60.0), ("click", 70.0)]
ONLY = "view,click,purchase,absent"

W_SQL = ("w(source, weight) AS (SELECT * FROM (VALUES ('view',3.0),('click',2.0),('purchase',1.0),"
         "('signup',0.5),('error',0.0),('absent',1.0)) v(source, weight))")
Q_SQL = "q(source, quota) AS (SELECT * FROM (VALUES ('view',60.0),('click',70.0)) v(source, quota))"
M_SQL = "m AS (SELECT max(ts) AS a FROM events)"


def weights_df(spark):
    return param_table(spark, WEIGHTS, "source string, weight double")


def quotas_df(spark):
    return param_table(spark, QUOTAS, "source string, quota double")


def _source_stats(spark, sf):
    t = Tables(spark, sf)
    ev = t.events
    return stats.source_stats(ev, weights_df(spark), quotas=quotas_df(spark), only=ONLY,
                              contribution=F.col("event_type") == "purchase")


SOURCE_STATS_SQL = f"""
WITH {W_SQL}, {Q_SQL}, {M_SQL},
c AS (SELECT CASE WHEN event_type IN (SELECT source FROM w) THEN event_type ELSE 'other' END AS source,
        count(*) AS count_24h,
        count(*) FILTER (WHERE ts >= a - INTERVAL 1 HOUR) AS count_1h,
        count(*) FILTER (WHERE event_type = 'purchase') AS rep_24h
      FROM events, m WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a GROUP BY 1),
s AS (SELECT source, CAST(weight AS DOUBLE) AS weight FROM w WHERE source <> 'other'
      UNION ALL SELECT 'other', CAST(coalesce((SELECT max(weight) FROM w WHERE source = 'other'), 0) AS DOUBLE))
SELECT s.source, s.weight,
  CAST(CASE WHEN q.quota IS NULL THEN 0 WHEN coalesce(c.count_24h, 0) < q.quota THEN 1 ELSE 0 END AS DOUBLE) AS quota,
  CAST(CASE WHEN s.source IN ('view','click','purchase','absent') THEN 1 ELSE 0 END AS DOUBLE) AS only,
  CAST(coalesce(c.count_24h, 0) AS BIGINT) AS count_24h, CAST(coalesce(c.count_1h, 0) AS BIGINT) AS count_1h,
  CAST(least(30, coalesce(c.count_24h, 0)) AS BIGINT) AS count_last_30,
  CAST(coalesce(c.rep_24h, 0) AS BIGINT) AS rep_24h
FROM s LEFT JOIN c ON s.source = c.source LEFT JOIN q ON s.source = q.source
"""

register("source_stats", SOURCE_STATS_SQL)(_source_stats)


@register("trailing_count", f"""
WITH {M_SQL}
SELECT event_type AS key, count(*) AS n FROM events, m
WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a GROUP BY event_type""")
def _trailing_count(spark, sf):
    # period 48 h is capped to the 24 h retention
    return stats.trailing_count(Tables(spark, sf).events, period_hours=48)


@register("trailing_count_per_row", """
SELECT event_id, event_type AS key,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n
FROM events""")
def _trailing_count_per_row(spark, sf):
    return stats.trailing_count_per_row(Tables(spark, sf).events, period_hours=1)


@register("retention_24h", f"""
WITH {M_SQL}
SELECT event_id, ts, user_id, event_type, value, props FROM events, m
WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a""")
def _retention(spark, sf):
    return stats.retention_24h(Tables(spark, sf).events)


@register("last_n_count", f"""
WITH {M_SQL}
SELECT user_id AS key, least(30, count(*)) AS n_last FROM events, m
WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a GROUP BY user_id""")
def _last_n(spark, sf):
    return stats.last_n_count(stats.retention_24h(Tables(spark, sf).events), n=30, key="user_id")


ALIAS_VALUES_SQL = ",".join(f"('{d}','{a}')" for d, a in stats.DEFAULT_ALIASES)
A_SQL = f"al(domain, alias) AS (SELECT * FROM (VALUES {ALIAS_VALUES_SQL}) v(domain, alias))"


@register("domain_alias", with_views(f"""
WITH {A_SQL}
SELECT i.item_id, i.domain, coalesce(al.alias, 'other') AS alias
FROM V_items i LEFT JOIN al ON i.domain = al.domain""", "V_items"))
def _domain_alias(spark, sf):
    items = v_items(Tables(spark, sf)).select("item_id", "domain")
    return stats.domain_alias(items, stats.alias_table(spark)).select("item_id", "domain", "alias")


@register("contribution_count", with_views(f"""
WITH {A_SQL}
SELECT 'rep_' || coalesce(al.alias, 'other') AS rep_key, count(*) AS n
FROM V_items i LEFT JOIN al ON i.domain = al.domain GROUP BY 1""", "V_items"))
def _contributions(spark, sf):
    return stats.contribution_count(v_items(Tables(spark, sf)), stats.alias_table(spark))


@register("daily_total", f"""
WITH src AS ({SOURCE_STATS_SQL})
SELECT CAST(sum(CASE WHEN source = 'other' THEN count_24h ELSE rep_24h END) AS BIGINT) AS total_24h FROM src""")
def _daily_total(spark, sf):
    return stats.daily_total(_source_stats(spark, sf))


@register("inactive_sources", f"""
WITH {W_SQL}, {M_SQL}
SELECT source FROM w WHERE source NOT IN (
  SELECT event_type FROM events, m WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a)""")
def _inactive(spark, sf):
    return stats.inactive_sources(weights_df(spark), Tables(spark, sf).events)


@register("error_count_by_source", """
SELECT user_id AS source, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id""")
def _errors(spark, sf):
    # the collector job (user_id) is the source of an error event
    return stats.error_count_by_source(Tables(spark, sf).events, F.col("event_type") == "error", "user_id")


@register("quota_layer", f"""
WITH {Q_SQL}, {M_SQL},
c AS (SELECT event_type AS key, count(*) AS n FROM events, m WHERE ts >= a - INTERVAL 24 HOUR AND ts <= a
      GROUP BY 1)
SELECT q.source, CAST(CASE WHEN coalesce(c.n, 0) < q.quota THEN 1 ELSE 0 END AS DOUBLE) AS layer
FROM q LEFT JOIN c ON q.source = c.key""")
def _quota_layer(spark, sf):
    counts = stats.trailing_count(Tables(spark, sf).events)
    return stats.quota_layer(quotas_df(spark), counts)
