"""Queries of §2.8: weight layers, weighted choice, rollout and keyword draws.

Bindings: options are nations (weight = number of suppliers), draws are
orders with the portable uniform ``u = ((o_orderkey * 2654435761) % 1000003) / 1000003``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.dims import param_table
from postlens.functions.indexing import portable_uniform, portable_uniform_sql
from postlens.operators import sampling
from postlens.plans.registry import register
from postlens.tables import Tables

ONLY_NATIONS = "NATION_1,NATION_3,NATION_5,NATION_7,NATION_9,NATION_12,NATION_20"
_ONLY_SQL = ",".join(f"'{x}'" for x in ONLY_NATIONS.split(","))


def _layers(t: Tables):
    n = t.nation
    sc = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    l1 = n.join(sc, n["n_nationkey"] == sc["s_nationkey"], "left").select(
        F.lit(1).alias("layer_no"), F.col("n_name").alias("key"), F.col("n_nationkey").alias("ord"),
        F.coalesce(F.col("c"), F.lit(0)).cast("double").alias("w"))
    l2 = n.where(F.col("n_regionkey") == 4).select(F.lit(2).alias("layer_no"), F.col("n_name").alias("key"),
                                                   F.col("n_nationkey").alias("ord"), F.lit(0.0).alias("w"))
    only = sampling.only_layer(n.select(F.col("n_name").alias("source"), "n_nationkey"), ONLY_NATIONS)
    l3 = only.select(F.lit(3).alias("layer_no"), "key", F.lit(None).cast("int").alias("ord"),
                     F.col("layer").alias("w"))
    return l1.unionByName(l2).unionByName(l3)


LAYERS_SQL = f"""
l AS (SELECT 1 AS layer_no, n_name AS key, n_nationkey AS ord, CAST(coalesce(c, 0) AS DOUBLE) AS w
      FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey
      UNION ALL SELECT 2, n_name, n_nationkey, CAST(0 AS DOUBLE) FROM nation WHERE n_regionkey = 4
      UNION ALL SELECT 3, n_name, NULL, CAST(CASE WHEN n_name IN ({_ONLY_SQL}) THEN 1 ELSE 0 END AS DOUBLE) FROM nation),
cw AS (SELECT key, max(ord) AS ord, product(w) AS weight FROM l GROUP BY key),
cws AS (SELECT key, ord, weight, CASE WHEN sum(weight) OVER () > 0 THEN weight / sum(weight) OVER () END AS share
        FROM cw)"""


@register("only_layer", f"""
SELECT n_name AS key, CAST(CASE WHEN n_name IN ({_ONLY_SQL}) THEN 1 ELSE 0 END AS DOUBLE) AS layer FROM nation""")
def _only_layer(spark, sf):
    n = Tables(spark, sf).nation.select(F.col("n_name").alias("source"))
    return sampling.only_layer(n, ONLY_NATIONS)


@register("combine_weights", f"WITH {LAYERS_SQL} SELECT key, ord, weight, share FROM cws")
def _combine(spark, sf):
    return sampling.combine_weights(_layers(Tables(spark, sf)))


U1 = portable_uniform_sql("o_orderkey")
DRAW_SQL = f"""
iv AS (SELECT key, ord, weight, sum(weight) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS hi FROM cws),
iv2 AS (SELECT key, ord, hi - weight AS lo, hi FROM iv),
tot AS (SELECT sum(weight) AS total FROM cws),
first_opt AS (SELECT key FROM iv ORDER BY ord LIMIT 1),
d AS (SELECT o_orderkey, {U1} * total AS x FROM orders, tot)"""


@register("weighted_draw", f"""
WITH {LAYERS_SQL}, {DRAW_SQL}
SELECT d.o_orderkey, coalesce(iv2.key, (SELECT key FROM first_opt)) AS choice
FROM d LEFT JOIN iv2 ON iv2.lo <= d.x AND d.x < iv2.hi""")
def _weighted_draw(spark, sf):
    t = Tables(spark, sf)
    w = sampling.combine_weights(_layers(t))
    draws = t.orders.select("o_orderkey", portable_uniform(F.col("o_orderkey")).alias("u"))
    return sampling.weighted_draw(draws, "u", w).select("o_orderkey", "choice")


@register("url_generator_mix", f"""
WITH cws AS (SELECT * FROM (VALUES ('twitter', 1, 60.0), ('reddit', 2, 35.0), ('4chan', 3, 5.0)) v(key, ord, weight)),
{DRAW_SQL}
SELECT d.o_orderkey, coalesce(iv2.key, (SELECT key FROM first_opt)) AS choice
FROM d LEFT JOIN iv2 ON iv2.lo <= d.x AND d.x < iv2.hi""")
def _url_mix(spark, sf):
    t = Tables(spark, sf)
    gens = param_table(spark, [(k, i + 1, w) for i, (k, w) in enumerate(sampling.URL_GENERATORS)],
                       "key string, ord int, weight double")
    draws = t.orders.select("o_orderkey", portable_uniform(F.col("o_orderkey")).alias("u"))
    return sampling.weighted_draw(draws, "u", gens).select("o_orderkey", "choice")


@register("rollout_split", """
SELECT event_id, ((event_id * 2654435761) % 1000003) % 100 AS number,
  CASE WHEN ((event_id * 2654435761) % 1000003) % 100 <= 30 THEN 'new' ELSE 'old' END AS variant
FROM events""")
def _rollout(spark, sf):
    e = Tables(spark, sf).events.select("event_id")
    number = (F.col("event_id") * F.lit(2654435761)) % F.lit(1000003) % F.lit(100)
    return sampling.rollout_split(e, number, cursor=30)


LANGS = ["all", "en", "fr", "de", "pt"]
_TOPICS_SQL = """tp AS (SELECT p_brand AS topic, CASE p_size % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de'
   WHEN 3 THEN 'es' ELSE 'it' END AS lang, p_name AS keyword, p_partkey % 64 AS s FROM part)"""


def _topics(t: Tables):
    p = t.part
    m = F.col("p_size") % 5
    lang = F.when(m == 0, "en").when(m == 1, "fr").when(m == 2, "de").when(m == 3, "es").otherwise("it")
    return p.select(F.col("p_brand").alias("topic"), lang.alias("lang"), F.col("p_name").alias("keyword"),
                    "p_partkey")


@register("topic_keyword_draw", f"""
WITH {_TOPICS_SQL},
pools AS (SELECT topic, 'all' AS lk, keyword, lang AS l, s FROM tp UNION ALL SELECT topic, lang, keyword, lang, s FROM tp),
idx AS (SELECT topic, lk, keyword, row_number() OVER (PARTITION BY topic, lk ORDER BY s, l, keyword) AS k_no FROM pools),
sizes AS (SELECT topic, lk, count(*) AS n_pool FROM pools GROUP BY 1, 2),
tidx AS (SELECT topic, dense_rank() OVER (ORDER BY topic) AS t_no FROM (SELECT DISTINCT topic FROM tp) x),
nt AS (SELECT count(DISTINCT topic) AS n FROM tp),
d AS (SELECT o_orderkey, CAST(floor({U1} * n) + 1 AS BIGINT) AS t_no,
        {portable_uniform_sql("o_orderkey", 40503, 7)} AS u2,
        list_extract(['all','en','fr','de','pt'], CAST(floor({portable_uniform_sql("o_orderkey", 69069, 1)} * 5) + 1 AS BIGINT)) AS lang
      FROM orders, nt),
d3 AS (SELECT d.o_orderkey, d.lang, tidx.topic, d.u2 FROM d LEFT JOIN tidx ON d.t_no = tidx.t_no),
d4 AS (SELECT d3.*, CASE WHEN n_pool > 0 THEN CAST(floor(u2 * n_pool) + 1 AS BIGINT) END AS k_no
       FROM d3 LEFT JOIN sizes ON d3.topic = sizes.topic AND d3.lang = sizes.lk)
SELECT d4.o_orderkey, d4.lang, d4.topic, coalesce(idx.keyword, d4.topic) AS keyword
FROM d4 LEFT JOIN idx ON d4.topic = idx.topic AND d4.lang = idx.lk AND d4.k_no = idx.k_no""")
def _topic_draw(spark, sf):
    t = Tables(spark, sf)
    o = t.orders
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]),
                        (F.floor(portable_uniform(F.col("o_orderkey"), 69069, 1) * len(LANGS)) + 1).cast("int"))
    draws = o.select("o_orderkey", portable_uniform(F.col("o_orderkey")).alias("u1"),
                     portable_uniform(F.col("o_orderkey"), 40503, 7).alias("u2"), lang.alias("lang"))
    out = sampling.topic_keyword_draw(draws, "u1", "u2", "lang", _topics(t), F.col("p_partkey") % 64)
    return out.select("o_orderkey", "lang", "topic", "keyword")


@register("keyword_draw", f"""
WITH kw AS (SELECT p_name AS keyword, p_partkey % 64 AS s FROM part),
idx AS (SELECT keyword, row_number() OVER (ORDER BY s, keyword) AS k_no FROM kw),
n AS (SELECT count(*) AS n FROM kw),
d AS (SELECT o_orderkey, CAST(floor({U1} * n) + 1 AS BIGINT) AS k_no FROM orders, n)
SELECT d.o_orderkey, idx.keyword FROM d LEFT JOIN idx ON d.k_no = idx.k_no""")
def _keyword_draw(spark, sf):
    t = Tables(spark, sf)
    draws = t.orders.select("o_orderkey", portable_uniform(F.col("o_orderkey")).alias("u"))
    kws = t.part.select(F.col("p_name").alias("keyword"), "p_partkey")
    return sampling.keyword_draw(draws, "u", kws, F.col("p_partkey") % 64).select("o_orderkey", "keyword")


@register("module_for_source", """
WITH f AS (SELECT n_name AS source, arg_min(s_name, s_suppkey) AS first_module
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT source, CASE WHEN source = 'NATION_3' THEN 'custom_module' ELSE first_module END AS module FROM f""")
def _module_for(spark, sf):
    t = Tables(spark, sf)
    s, n = t.supplier, t.nation
    mods = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("source"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("module"))
    over = param_table(spark, [("NATION_3", "custom_module")], "source string, module string")
    return sampling.module_for_source(mods, over)


def _param_entries(t: Tables):
    s = t.supplier
    k = F.col("s_suppkey")
    base = s.select(k.alias("scope"), F.lit(0).alias("priority"), F.lit("keyword").alias("key"),
                    F.col("s_name").alias("value"))
    generic = s.select(k.alias("scope"), F.explode(F.array(
        F.struct(F.lit("max_oldness_seconds").alias("key"), F.lit("120").alias("value")),
        F.struct(F.lit("maximum_items_to_collect").alias("key"), F.lit("10").alias("value")),
        F.struct(F.lit("min_post_length").alias("key"), F.lit("10").alias("value")))).alias("e")).select(
        "scope", F.lit(1).alias("priority"), "e.key", "e.value")
    spec1 = s.where(k % 4 == 0).select(k.alias("scope"), F.lit(2).alias("priority"),
                                      F.lit("maximum_items_to_collect").alias("key"), k.cast("string").alias("value"))
    spec2 = s.where(k % 3 == 0).select(k.alias("scope"), F.lit(2).alias("priority"), F.lit("keyword").alias("key"),
                                      F.lit("override").alias("value"))
    return base.unionByName(generic).unionByName(spec1).unionByName(spec2)


@register("overlay_parameters", """
WITH e AS (
  SELECT s_suppkey AS scope, 0 AS priority, 'keyword' AS key, s_name AS value FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'max_oldness_seconds', '120' FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'maximum_items_to_collect', '10' FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'min_post_length', '10' FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'maximum_items_to_collect', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT s_suppkey, 2, 'keyword', 'override' FROM supplier WHERE s_suppkey % 3 = 0)
SELECT scope, key, arg_max(value, priority) AS value FROM e GROUP BY scope, key""")
def _overlay(spark, sf):
    return sampling.overlay_parameters(_param_entries(Tables(spark, sf)))


@register("search_url", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0
  THEN 'https://twitter.com/search?q=' || replace(p_name, ' ', '%20') || '&src=typed_query&f=live'
  ELSE 'https://twitter.com/search?q=' || replace(p_name, ' ', '%20') || '&src=typed_query' END AS url
FROM part""")
def _search_url(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", F.col("p_name").alias("keyword"), "p_size")
    return sampling.search_url(p, "keyword", F.col("p_size") % 2 == 0).select("p_partkey", "url")
