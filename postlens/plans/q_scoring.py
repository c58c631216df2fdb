"""Queries of §2.4: scorers on documents/embeddings, blending rules on V_scores."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postlens.functions.text import format_iso
from postlens.operators import scoring as S
from postlens.plans.registry import register
from postlens.sources.schema import AGES, GENDERS, TEXT_TYPES
from postlens.tables import Tables
from postlens.views import lineitem_chunks, v_items, v_lexicon, v_scores, with_views

N_TOPICS, HASH_DIM = 8, 256


def _load_topic_model():
    """A small deterministic linear topic scorer (seeded weights)."""
    return np.random.default_rng(0).normal(size=(HASH_DIM, N_TOPICS))


def _apply_topic_model(w, pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.zeros((len(pdf), HASH_DIM))
    for r, text in enumerate(pdf["text"].fillna("")):
        for tok in text.lower().split():
            x[r, zlib.crc32(tok.encode()) % HASH_DIM] += 1.0
    z = x @ w
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p = p / p.sum(axis=1, keepdims=True)
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "label": p.argmax(axis=1).astype("int64"),
                         "score": np.round(p.max(axis=1), 4)})


@register("score_with_model")
def _score(spark, sf):
    d = Tables(spark, sf).documents
    return S.score_with_model(d, _load_topic_model, _apply_topic_model, "doc_id long, label long, score double",
                              cols=["doc_id", "text"])


@register("embed_text")
def _embed(spark, sf):
    d = Tables(spark, sf).documents
    return S.embed_text(d, "doc_id", "text", 64)


def _label_vectors(t: Tables):
    ex = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    m = ex.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                                              lambda s: s["m"]).alias("embedding"))


@register("classify_topic", """
WITH ex AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
            FROM embeddings),
lv AS (SELECT label, pos, avg(v) AS w FROM ex GROUP BY 1, 2),
ln AS (SELECT label, sqrt(sum(w * w)) AS ln FROM lv GROUP BY 1),
dn AS (SELECT vec_id, sqrt(sum(v * v)) AS dn FROM ex GROUP BY 1),
d AS (SELECT ex.vec_id, lv.label, sum(ex.v * lv.w) AS dot FROM ex JOIN lv ON ex.pos = lv.pos GROUP BY 1, 2),
s AS (SELECT d.vec_id, d.label, dot / (dn * ln) AS score FROM d JOIN ln ON d.label = ln.label
      JOIN dn ON d.vec_id = dn.vec_id),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
SELECT vec_id, label, round(score, 4) AS score FROM b WHERE r = 1""")
def _classify(spark, sf):
    t = Tables(spark, sf)
    return S.classify_topic(t.embeddings, "vec_id", "embedding", _label_vectors(t), n_labels_bound=1000)


_TT_EXPR = [("Assumption", "CAST(positive AS DOUBLE)"), ("Anecdote", "CAST(negative AS DOUBLE)"),
            ("None", "CAST(lexicon AS DOUBLE)"), ("Definition", "score / 100003"), ("Testimony", "0.5"),
            ("Other", "CAST(positive AS DOUBLE) / 3"), ("Statistics/Study", "CAST(negative AS DOUBLE) / 7")]


@register("scores_to_struct", with_views("SELECT item_id, chunk_no, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {f}" for (_, e), f in zip(_TT_EXPR, TEXT_TYPES)) + " FROM V_scores", "V_scores"))
def _to_struct(spark, sf):
    s = v_scores(Tables(spark, sf))
    arr = F.array(*[F.struct(F.lit(lab).alias("label"), F.expr(e).cast("double").alias("score")) for lab, e in _TT_EXPR])
    s = S.scores_to_struct(s.withColumn("tt", arr), "tt", S.TEXT_TYPE_LABELS, TEXT_TYPES, out="text_type")
    return s.select("item_id", "chunk_no", *[F.col(f"text_type.{f}").alias(f) for f in TEXT_TYPES])


def _overlaid(t: Tables, finance: bool = False):
    base = v_lexicon(t)
    lex = base.select("word", "valence", F.lit(0).alias("priority"))
    over = base.where(F.length("word") >= 7).select("word", F.lit(3).alias("valence"), F.lit(1).alias("priority"))
    parts = lex.unionByName(over)
    if finance:
        fin = base.where(F.col("word").endswith("tion")).select("word", F.lit(-2).alias("valence"),
                                                                F.lit(2).alias("priority"))
        parts = parts.unionByName(fin)
    return S.lexicon_overlay(parts)


OVERLAY_SQL = """
ov AS (SELECT word, arg_max(valence, priority) AS valence FROM (
  SELECT word, valence, 0 AS priority FROM V_lexicon
  UNION ALL SELECT word, 3, 1 FROM V_lexicon WHERE length(word) >= 7 {fin}) x GROUP BY word)"""
FIN_PART = "UNION ALL SELECT word, -2, 2 FROM V_lexicon WHERE ends_with(word, 'tion')"


@register("lexicon_overlay", with_views(f"WITH {OVERLAY_SQL.format(fin='')} SELECT word, valence FROM ov",
                                        "V_lexicon"))
def _overlay(spark, sf):
    return _overlaid(Tables(spark, sf))


SENT_SQL = """
WITH {ov},
w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
s AS (SELECT w.doc_id, sum(CAST({val} AS DOUBLE)) AS s FROM w JOIN {lex} l ON w.word = l.word WHERE w.word <> ''
      GROUP BY 1)
SELECT d.doc_id, coalesce(round(s.s / sqrt(s.s * s.s + 15), 2), 0.0) AS compound
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""


@register("lexicon_sentiment", with_views(SENT_SQL.format(ov="dummy AS (SELECT 1)", val="l.valence", lex="V_lexicon"),
                                          "V_lexicon"))
def _lex_sent(spark, sf):
    t = Tables(spark, sf)
    return S.lexicon_sentiment(t.documents, "doc_id", "text", v_lexicon(t))


@register("finance_lexicon_sentiment", with_views(
    SENT_SQL.format(ov=OVERLAY_SQL.format(fin=FIN_PART).strip(), val="l.valence", lex="ov"), "V_lexicon"))
def _fin_lex(spark, sf):
    t = Tables(spark, sf)
    return S.lexicon_sentiment(t.documents, "doc_id", "text", _overlaid(t, finance=True))


POL_SQL = "round(round(CAST(positive AS DECIMAL(10,6)), 3) - round(CAST(negative AS DECIMAL(10,6)), 3), 3)"
FIN_SQL = f"round(0.70 * CAST({POL_SQL} AS DECIMAL(10,4)) + 0.30 * CAST(lexicon AS DECIMAL(10,4)), 2)"


def _blend_sql(g, lx, f):
    parts = []
    for th, wg, wl, wf in S.BLEND_TIERS:
        parts.append(f"WHEN abs({f}) >= {th} THEN {wg} * {g} + {wl} * {lx} + {wf} * {f}")
    return "round(CASE " + " ".join(parts) + " END, 2)"


@register("polarity_from_probs", with_views(
    f"SELECT item_id, chunk_no, CAST({POL_SQL} AS DOUBLE) AS polarity FROM V_scores", "V_scores"))
def _polarity(spark, sf):
    s = v_scores(Tables(spark, sf))
    return s.select("item_id", "chunk_no", S.polarity_from_probs(F.col("positive"), F.col("negative"))
                    .cast("double").alias("polarity"))


@register("finance_sentiment", with_views(
    f"SELECT item_id, chunk_no, CAST({FIN_SQL} AS DOUBLE) AS finance FROM V_scores", "V_scores"))
def _finance(spark, sf):
    s = v_scores(Tables(spark, sf))
    pol = S.polarity_from_probs(F.col("positive"), F.col("negative"))
    return s.select("item_id", "chunk_no", S.finance_sentiment(pol, F.col("lexicon")).cast("double").alias("finance"))


@register("blend_sentiment", with_views(f"""
WITH b AS (SELECT item_id, chunk_no, CAST({POL_SQL} AS DECIMAL(10,4)) AS g, CAST(lexicon AS DECIMAL(10,4)) AS lx,
                  CAST({FIN_SQL} AS DECIMAL(10,4)) AS f FROM V_scores)
SELECT item_id, chunk_no, CAST({_blend_sql('g', 'lx', 'f')} AS DOUBLE) AS sentiment FROM b""", "V_scores"))
def _blend(spark, sf):
    s = v_scores(Tables(spark, sf))
    pol = S.polarity_from_probs(F.col("positive"), F.col("negative"))
    fin = S.finance_sentiment(pol, F.col("lexicon"))
    return s.select("item_id", "chunk_no", S.blend_sentiment(pol, F.col("lexicon"), fin).cast("double")
                    .alias("sentiment"))


@register("placeholder_scores", with_views("SELECT item_id, " + ", ".join(
    [f"CAST(0.5 AS DOUBLE) AS {g}" for g in GENDERS] + [f"CAST(0.0 AS DOUBLE) AS {a}" for a in AGES]
    + ["CAST(1.0 AS DOUBLE) AS language_score"]) + " FROM V_items", "V_items"))
def _placeholders(spark, sf):
    p = S.placeholder_scores(v_items(Tables(spark, sf)).select("item_id"))
    return p.select("item_id", *[F.col(f"gender.{g}").alias(g) for g in GENDERS],
                    *[F.col(f"age.{a}").alias(a) for a in AGES], "language_score")


_SOCIAL_SQL = ",".join(f"'{d}'" for d in S.SOCIAL_DOMAINS)


@register("source_type", with_views(f"""
SELECT item_id, domain, CASE WHEN domain IN ({_SOCIAL_SQL}) THEN 'social' ELSE 'news' END AS source_type
FROM V_items""", "V_items"))
def _source_type(spark, sf):
    return S.source_type(v_items(Tables(spark, sf)).select("item_id", "domain"))


# Every eleventh key has lost its score, every thirteenth its item.
@register("assemble_processed", with_views("""
WITH k AS (SELECT *, (item_id + chunk_no) % 11 = 0 AS lost_s, (item_id + chunk_no) % 13 = 0 AS lost_i FROM V_chunks),
j AS (SELECT c.item_id, c.chunk_no, NOT lost_i AS i, NOT lost_s AS s, c.*, v.label, v.score, v.source_type
  FROM k c JOIN V_scores v ON c.item_id = v.item_id AND c.chunk_no = v.chunk_no WHERE NOT (lost_i AND lost_s))
SELECT item_id, chunk_no, CASE WHEN i AND s THEN 'complete' WHEN i THEN 'no_score' ELSE 'no_item' END AS status,
  CASE WHEN i THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') END AS created_at,
  CASE WHEN i THEN 'https://x.com/o/' || item_id END AS url, CASE WHEN s THEN label END AS label,
  CASE WHEN s THEN score END AS score, CASE WHEN s THEN source_type END AS source_type,
  CASE WHEN s THEN 'rf_' || l_returnflag || ',ls_' || l_linestatus END AS keywords FROM j""", "V_chunks", "V_scores"))
def _assemble(spark, sf):
    t = Tables(spark, sf)
    c = lineitem_chunks(t)
    k = F.col("item_id") + F.col("chunk_no")
    items = c.where(k % 13 != 0).select("item_id", "chunk_no", format_iso("l_shipdate").alias("created_at"),
                                        F.concat(F.lit("https://x.com/o/"), F.col("item_id").cast("string")).alias("url"))
    kws = c.select("item_id", "chunk_no", F.array(F.concat(F.lit("rf_"), "l_returnflag"),
                                                  F.concat(F.lit("ls_"), "l_linestatus")).alias("top_keywords"))
    scores = v_scores(t).where(k % 11 != 0).select("item_id", "chunk_no", "label", "score", "source_type")
    p = S.assemble_processed(items, scores, kws)
    return p.select("item_id", "chunk_no", "status", "item.created_at", "item.url", "analysis.label", "analysis.score",
                    "analysis.source_type", F.array_join("analysis.top_keywords", ",").alias("keywords"))
