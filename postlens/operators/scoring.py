"""Enrichment and scoring (§2.4).

Neural models are outside this engine; each model call is a pluggable batch
scorer run with ``mapInPandas`` (Arrow batches, model loaded once per Python
worker).  The defaults here are deterministic Spark-native scorers (feature
hashing, centroid classification, lexicons); their values are not the
reference's model outputs.  Blending rules are exact ``DECIMAL`` arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.dims import param_table
from postlens.functions.models import load_once
from postlens.sources.schema import AGES, GENDERS

# Exact-match social domains (anything else is "news").
SOCIAL_DOMAINS = [
    "4chan.org", "4channel.org", "reddit.com", "twitter.com", "bsky.app", "t.com", "x.com", "youtube.com", "yt.co",
    "lemmy.world", "mastodon.social", "weibo.com", "nostr.social", "nostr.com", "jeuxvideo.com", "forocoches.com",
    "bitcointalk.org", "ycombinator.com", "news.ycombinator.com", "tradingview.com", "followin.in",
    "seekingalpha.io", "threads.net", "telegram.org", "tumblr.com", "facebook.com", "instagram.com", "tiktok.com",
    "whatsapp.com", "9gag.com", "techhaven.org", "hey.xyz", "dscvr.one", "warpcast.com", "discord.com",
    "matrix.org", "gab.com", "parler.com", "truthsocial.com", "vk.com", "vero.co", "substack.com", "8kun.top",
    "ello.co", "minds.com", "mewe.com", "livejournal.com", "plurk.com", "friendica.net", "aminoapps.com",
    "bitchute.com", "gettr.com", "odysee.com", "poal.co", "rumble.com", "wimkin.com", "twitch.tv", "rocket.chat",
    "snap.com", "vidlii.com",
]
# Text-type labels of the classifier and their field names.
TEXT_TYPE_LABELS = ["Assumption", "Anecdote", "None", "Definition", "Testimony", "Other", "Statistics/Study"]
# Sentiment blend tiers on |finance|: (threshold, general, lexicon, finance).
BLEND_TIERS = [("0.6", "0.30", "0.10", "0.60"), ("0.4", "0.40", "0.20", "0.40"), ("0.1", "0.60", "0.25", "0.15"),
               ("0", "0.60", "0.40", "0")]
FIN_MODEL_W, FIN_LEX_W = "0.70", "0.30"
LEXICON_ALPHA = 15  # compound = s / sqrt(s^2 + alpha)


def D(x: str) -> Column:
    return F.lit(Decimal(x))


# ---- model surface -------------------------------------------------------------------------------

def score_with_model(df: DataFrame, loader: Callable[[], object],
                     fn: Callable[[object, pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
                     cols: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
    """Batch inference over partitions: ``fn(model, batch)`` maps a pandas batch to the
    output batch.  ``loader()`` runs once per Python worker for each model ``name``
    (the loader's qualified name by default; give one to loaders that share it, as
    lambdas do).  Workers import ``postlens`` for the cache."""
    if name is None:
        name = f"{loader.__module__}.{loader.__qualname__}"
        if "<lambda>" in name:
            raise ValueError("a lambda has no name of its own: give the model a name")
    src = df.select(*cols) if cols else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_once(name, loader)
        for b in batches:
            yield fn(model, b)
    return src.mapInPandas(run, schema=schema)


def embed_text(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Feature-hashing embedding: lower-cased word tokens hashed to ``dim``
    buckets, counted and L2-normalised; one ``array<double>`` per text.  The
    per-text vector is assembled from at most ``dim`` (bucket, value) pairs."""
    toks = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("t"))
    b = toks.groupBy(key, F.pmod(F.xxhash64("t"), F.lit(dim)).alias("i")).agg(F.count(F.lit(1)).cast("double")
                                                                          .alias("c"))
    v = b.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("_m"),
                           F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_n"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)) / F.col("_n"))
    return df.select(key).join(v.select(key, dense.alias("embedding")), key, "left")


def classify_topic(vectors: DataFrame, key: str, vec: str, label_vectors: DataFrame, n_labels_bound: int
                   ) -> DataFrame:
    """Best label by cosine similarity against label vectors, score rounded to 4 dp.

    A distributed dot product: both sides are exploded to ``(id, pos, value)``
    and joined on ``pos``; the label side has ``labels x dim`` rows, bounded by
    ``n_labels_bound`` labels, so it is broadcast by hint only under that bound."""
    from postlens.functions.dims import bounded_broadcast

    dv = vectors.select(key, F.posexplode(vec).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    lv = label_vectors.select("label", F.posexplode(vec).alias("pos", "w")).withColumn("w", F.col("w").cast("double"))
    lnorm = lv.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    dnorm = dv.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("dn"))
    dots = dv.join(bounded_broadcast(lv, n_labels_bound * 4096), "pos").groupBy(key, "label").agg(
        F.sum(F.col("v") * F.col("w")).alias("dot"))
    s = dots.join(bounded_broadcast(lnorm, n_labels_bound), "label").join(dnorm, key)
    s = s.withColumn("score", F.col("dot") / (F.col("dn") * F.col("ln")))
    best = s.groupBy(key).agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("label")))
                              .alias("_b"))
    return best.select(key, F.col("_b.label").alias("label"), F.round("_b.score", 4).alias("score"))


def scores_to_struct(df: DataFrame, scores: str, labels: Sequence[str], fields: Sequence[str],
                     round_dp: int | None = None, out: str = "scores") -> DataFrame:
    """``array<struct<label, score>>`` -> a fixed struct with the given field
    names (``labels[i]`` -> ``fields[i]``), optionally rounded."""
    m = F.map_from_entries(F.col(scores))
    vals = []
    for lab, f in zip(labels, fields):
        v = F.element_at(m, F.lit(lab)).cast("double")
        vals.append((F.round(v, round_dp) if round_dp is not None else v).alias(f))
    return df.withColumn(out, F.struct(*vals))


def lexicon_overlay(lexicons: DataFrame) -> DataFrame:
    """Later lexicons override earlier ones: ``(word, valence, priority)`` ->
    the valence of the highest priority per word."""
    return lexicons.groupBy("word").agg(F.max_by("valence", "priority").alias("valence"))


def lexicon_sentiment(docs: DataFrame, key: str, text: str, lexicon: DataFrame, out: str = "compound") -> DataFrame:
    """Compound polarity ``s / sqrt(s^2 + 15)`` of the summed valences of the
    text's (lower-cased, space-split) words, 2 dp; 0 when nothing matches."""
    w = docs.select(key, F.explode(F.split(F.lower(text), " ")).alias("word")).where(F.col("word") != "")
    s = w.join(lexicon.select("word", "valence"), "word").groupBy(key).agg(
        F.sum(F.col("valence").cast("double")).alias("_s"))
    comp = F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(float(LEXICON_ALPHA))), 2)
    return docs.select(key).join(s, key, "left").select(key, F.coalesce(comp, F.lit(0.0)).alias(out))


def polarity_from_probs(positive: Column, negative: Column) -> Column:
    """``round(positive, 3) - round(negative, 3)`` in DECIMAL, 3 dp."""
    return F.round(F.round(positive.cast("decimal(10,6)"), 3) - F.round(negative.cast("decimal(10,6)"), 3), 3)


def finance_sentiment(model: Column, lexicon: Column) -> Column:
    """``0.70 * model + 0.30 * lexicon``, 2 dp (DECIMAL)."""
    return F.round(D(FIN_MODEL_W) * model.cast("decimal(10,4)") + D(FIN_LEX_W) * lexicon.cast("decimal(10,4)"), 2)


def blend_sentiment(general: Column, lexicon: Column, finance: Column) -> Column:
    """Weights by tier of ``|finance|`` (general / lexicon / finance), 2 dp."""
    g, lx, fi = (c.cast("decimal(10,4)") for c in (general, lexicon, finance))
    expr = None
    for th, wg, wl, wf in BLEND_TIERS:
        val = D(wg) * g + D(wl) * lx + D(wf) * fi
        cond = F.abs(fi) >= D(th)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return F.round(expr, 2)


def placeholder_scores(df: DataFrame) -> DataFrame:
    """Constant analysis fields of the reference: gender 0.5/0.5, age 0, language score 1.0."""
    return (df.withColumn("gender", F.struct(*[F.lit(0.5).alias(g) for g in GENDERS]))
            .withColumn("age", F.struct(*[F.lit(0.0).alias(a) for a in AGES]))
            .withColumn("language_score", F.lit(1.0)))


def source_type(df: DataFrame, domain: str = "domain") -> DataFrame:
    """'social' for an exact match in the social domain list, else 'news'
    (so ``www.reddit.com`` is news)."""
    spark = df.sparkSession
    s = param_table(spark, [(d,) for d in SOCIAL_DOMAINS], "_sd string")
    j = df.join(s, df[domain] == s["_sd"], "left")
    return j.withColumn("source_type", F.when(F.col("_sd").isNotNull(), "social").otherwise("news")).drop("_sd")


#: What became of a key: item and score met, or one of them is missing.
COMPLETE, NO_SCORE, NO_ITEM = "complete", "no_score", "no_item"


def assemble_processed(items: DataFrame, scores: DataFrame, kws: DataFrame,
                       keys: Sequence[str] = ("item_id", "chunk_no")) -> DataFrame:
    """Items, scores and keywords joined on ``(item_id, chunk_no)`` into the nested
    processed-item shape (``item``, ``analysis``), with a ``status`` per key.

    No item vanishes: a key without a score comes out as ``no_score`` with a null analysis,
    a score without an item as ``no_item`` with a null item.  Keywords alone make no row; a
    missing list of keywords is null.  Null keys meet each other.
    """
    keys = list(keys)

    def side(df: DataFrame, mark: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], F.struct(*rest).alias(name), F.lit(True).alias(f"{mark}there"))

    def meet(a: str, b: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys])
    j = side(items, "_i", "_item").join(side(scores, "_s", "_score"), meet("_i", "_s"), "full")
    own = [F.when(F.col("_ithere"), F.col(f"_i{k}")).otherwise(F.col(f"_s{k}")).alias(f"_k{k}") for k in keys]
    status = F.when(F.col("_sthere").isNull(), NO_SCORE).when(F.col("_ithere").isNull(), NO_ITEM).otherwise(COMPLETE)
    j = j.select(*own, "_item", "_score", status.alias("status")).join(side(kws, "_w", "_kws"), meet("_k", "_w"), "left")
    ana = [F.col(f"_score.{c}").alias(c) for c in scores.columns if c not in keys] + [F.col(f"_kws.{c}").alias(c) for c in kws.columns if c not in keys]
    return j.select(*[F.col(f"_k{k}").alias(k) for k in keys], F.col("_item").alias("item"),
                    F.when(F.col("status") != NO_SCORE, F.struct(*ana)).alias("analysis"), "status")


def assembly_report(processed: DataFrame) -> DataFrame:
    """Keys per status."""
    return processed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
