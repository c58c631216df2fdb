"""Weight layers, weighted choice, rollout split and uniform keyword draws.

Draws are a column of uniforms in ``[0, 1)`` (seeded, reproducible), so a draw
is a deterministic function of its row and every operator here is an ordinary
join or expression: nothing is sampled on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.indexing import dense_index

# Keyword list used when the flat keyword list is empty.
FALLBACK_KEYWORDS = ["bitcoin", "ethereum", "eth", "btc", "usdt", "usdc", "stablecoin", "defi", "finance",
                     "liquidity", "token", "economy", "markets", "stocks", "crisis"]

# URL generators and their weights (twitter 60, reddit 35, 4chan 5).
URL_GENERATORS = [("twitter", 60.0), ("reddit", 35.0), ("4chan", 5.0)]
TWITTER_SEARCH = "https://twitter.com/search?q={kw}&src=typed_query"
LIVE_SUFFIX = "&f=live"


def only_layer(weights: DataFrame, csv: str, key: str = "source") -> DataFrame:
    """Comma allow-list as a layer: 1.0 for listed keys, 0.0 otherwise.
    An empty list means no layer (no rows)."""
    allowed = [] if csv == "" else csv.split(",")
    if not allowed:
        return weights.select(F.col(key).alias("key"), F.lit(1.0).alias("layer")).where(F.lit(False))
    arr = F.array(*[F.lit(x) for x in allowed])
    return weights.select(F.col(key).alias("key"),
                          F.when(F.array_contains(arr, F.col(key)), 1.0).otherwise(0.0).alias("layer"))


def combine_weights(layers: DataFrame) -> DataFrame:
    """Product of weight layers ``(layer_no, key, ord, w)``; layer 1 defines the options.

    A key missing from a later layer keeps its weight (factor 1); a key that is
    not an option of layer 1 raises, as in the reference.  ``share`` is the
    normalised weight (null when every weight is 0); ``ord`` is the declared
    option order carried by layer 1.  Options are a small dimension, so the
    total is an unpartitioned window over it.
    """
    opts = layers.where(F.col("layer_no") == 1).select(F.col("key").alias("_ok"), F.col("ord").alias("_ord"))
    f = layers.join(opts, layers["key"] == opts["_ok"], "left").select(
        "key", "_ord",
        F.when(F.col("_ok").isNull(), F.raise_error(F.concat(F.lit("unknown weight key: "), F.col("key"))))
        .otherwise(F.col("w").cast("double")).alias("w"))
    prod = f.groupBy("key").agg(F.first("_ord").alias("ord"), F.product("w").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy())
    return prod.select("key", "ord", "weight", F.when(total > 0, F.col("weight") / total).alias("share"))


#: Largest option table whose cells are sent to every executor; beyond it the join is the planner's.
MAX_BROADCAST_ROWS = 100_000


def weighted_draw(draws: DataFrame, u: str, weights: DataFrame, grid: int = 1024) -> DataFrame:
    """Pick one option per draw: the first option whose cumulative interval holds
    ``u * total``; when every weight is 0 the first option wins.

    ``weights`` is ``(key, ord, weight)``, a small dimension.  The range lookup
    ``lo <= x < hi`` is made an equi join: ``[0, total)`` is cut into ``grid``
    cells, every interval is listed under the cells it touches (options + grid
    rows at most), each draw joins on its cell and keeps the exact match.
    """
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = weights.select(F.sum(F.col("weight").cast("double"))).scalar()
    iv = weights.select("ord", "key", F.col("weight").cast("double").alias("weight")).withColumn(
        "hi", F.sum("weight").over(w)).withColumn("lo", F.col("hi") - F.col("weight"))
    first = weights.select(F.min_by("key", "ord")).scalar()

    def cell(v):
        return F.floor(v / total * grid).cast("int")

    cells = (iv.where(F.col("weight") > 0)
             .select("key", "lo", "hi", F.explode(F.sequence(
                 F.greatest(cell(F.col("lo")) - 1, F.lit(0)),
                 F.least(cell(F.col("hi")) + 1, F.lit(grid - 1)))).alias("_cell")))
    d = draws.withColumn("_x", F.col(u) * total).withColumn("_cell", F.floor(F.col(u) * grid).cast("int"))
    c = cells.select(F.col("key").alias("_key"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                     F.col("_cell").alias("_c"))
    if weights.count() <= MAX_BROADCAST_ROWS:  # options and grid cells only: the draws stay where they are
        c = F.broadcast(c)
    j = d.join(c, (d["_cell"] == c["_c"]) & (c["_lo"] <= d["_x"]) & (d["_x"] < c["_hi"]), "left")
    return j.withColumn("choice", F.coalesce(F.col("_key"), first)).drop("_x", "_cell", "_key", "_lo", "_hi", "_c")


def rollout_split(df: DataFrame, number: Column, cursor: int) -> DataFrame:
    """``new`` when ``number <= cursor`` (number in 0..99, so P = (cursor+1)/100)."""
    return df.withColumn("number", number).withColumn(
        "variant", F.when(F.col("number") <= F.lit(cursor), "new").otherwise("old"))


def topic_keyword_draw(draws: DataFrame, u_topic: str, u_kw: str, lang: str, topics: DataFrame,
                       salt: Column, legacy: bool = False) -> DataFrame:
    """Uniform topic, then a uniform keyword of that topic.

    ``topics`` is the long table ``(topic, lang, keyword)``.  Language ``all``
    draws from every language of the topic; another language draws from that
    language's list (``legacy=True`` returns the topic name instead, as the
    reference's lookup always fails).  A topic without keywords in the language
    returns the topic name.  Numbering uses :func:`dense_index` (salted, no
    one-task window per topic).
    """
    tidx = topics.select("topic").distinct()
    tidx = tidx.withColumn("t_no", F.dense_rank().over(Window.orderBy("topic")))  # distinct topics: small
    n_topics = topics.select(F.count_distinct("topic")).scalar()
    d = draws.withColumn("t_no", (F.floor(F.col(u_topic) * n_topics) + 1).cast("long"))
    d = d.join(tidx, "t_no", "left")
    ts = topics.withColumn("_s", salt)
    pool_all = ts.select("topic", F.lit("all").alias("lk"), "keyword", F.col("lang").alias("_l"), "_s")
    pool_lang = ts.select("topic", F.col("lang").alias("lk"), "keyword", F.col("lang").alias("_l"), "_s")
    pools = pool_all.unionByName(pool_lang)
    pools = dense_index(pools, ["topic", "lk"], ["_l", "keyword"], F.col("_s"), out="k_no")
    sizes = pools.groupBy("topic", "lk").agg(F.count(F.lit(1)).alias("n_pool"))
    lk = F.col(lang) if not legacy else F.when(F.col(lang) == "all", "all")
    d = d.withColumn("lk", lk).join(sizes, ["topic", "lk"], "left")
    d = d.withColumn("k_no", F.when(F.col("n_pool") > 0, (F.floor(F.col(u_kw) * F.col("n_pool")) + 1)
                                    .cast("long")))
    d = d.join(pools.select("topic", "lk", "k_no", "keyword"), ["topic", "lk", "k_no"], "left")
    return d.withColumn("keyword", F.coalesce(F.col("keyword"), F.col("topic"))).drop("lk", "k_no", "n_pool")


def keyword_draw(draws: DataFrame, u: str, keywords: DataFrame, salt: Column) -> DataFrame:
    """Uniform keyword from the flat list ``keywords(keyword)``; the fixed
    15-word fallback list is used when that list is empty."""
    spark = draws.sparkSession
    fb = spark.createDataFrame([(i + 1, k) for i, k in enumerate(FALLBACK_KEYWORDS)], "k_no long, keyword string")
    kw = dense_index(keywords.withColumn("_g", F.lit(0)), ["_g"], ["keyword"], salt, out="k_no").drop("_g")
    has = keywords.exists()
    pool = kw.select("k_no", "keyword").where(has).unionByName(F.broadcast(fb).where(~has))
    n = pool.select(F.count(F.lit(1))).scalar()
    d = draws.withColumn("k_no", (F.floor(F.col(u) * n) + 1).cast("long"))
    return d.join(pool, "k_no", "left")


def module_for_source(modules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """First enabled module per source (``modules(source, pos, module)``); a user
    override ``(source, module)`` wins."""
    first = modules.groupBy("source").agg(F.min_by("module", "pos").alias("_first"))
    if overrides is None:
        return first.select("source", F.col("_first").alias("module"))
    o = overrides.select(F.col("source").alias("_os"), F.col("module").alias("_om"))
    j = first.join(o, first["source"] == o["_os"], "left")
    return j.select("source", F.coalesce("_om", "_first").alias("module"))


def overlay_parameters(entries: DataFrame) -> DataFrame:
    """Shallow overlay of parameter layers ``(scope, priority, key, value)``:
    for each scope and key the value of the highest priority wins.
    (``map_concat`` refuses duplicate keys, so the overlay is an aggregate.)"""
    return entries.groupBy("scope", "key").agg(F.max_by("value", "priority").alias("value"))


def parameters_map(overlaid: DataFrame) -> DataFrame:
    """Folded parameters as one map per scope."""
    return overlaid.groupBy("scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("parameters"))


def search_url(df: DataFrame, keyword: str = "keyword", live: Column | None = None) -> DataFrame:
    """Search URL from the template; spaces become ``%20``; live mode appends a flag."""
    base = F.concat(F.lit("https://twitter.com/search?q="), F.replace(F.col(keyword), F.lit(" "), F.lit("%20")),
                    F.lit("&src=typed_query"))
    live = F.lit(True) if live is None else live
    return df.withColumn("url", F.when(live, F.concat(base, F.lit(LIVE_SUFFIX))).otherwise(base))
