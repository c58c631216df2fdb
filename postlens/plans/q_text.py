"""Queries of §2.2 over ``documents`` (and V_items for chunking/translation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import chunking
from postlens.plans.registry import register
from postlens.tables import Tables
from postlens.views import v_items, with_views

STRIP_SQL = "regexp_replace({x}, '^[ \\t\\r\\n\\x0b\\x0c]+|[ \\t\\r\\n\\x0b\\x0c]+$', '', 'g')"
TOK_SQL = "len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+|[^ \\t\\n\\x0B\\f\\r\\p{{L}}\\p{{N}}]'))"
SENTS_SQL = ("list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[ \\t\\r\\n]+|\\n+', "
             "'\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: length(p) > 5)")
PARAS_SQL = ("list_filter(list_concat(r.paras, CASE WHEN len(r.cur) > 0 THEN [array_to_string(r.cur, ' ')] "
             "ELSE []::VARCHAR[] END), lambda p: length(p) > 5)")
def reduce_sql(lst: str, size: int) -> str:
    t = TOK_SQL.format(x="s")
    return (f"list_reduce({lst}, lambda acc, s: {{'paras': CASE WHEN acc.tok + {t} > {size} "
            f"THEN list_append(acc.paras, array_to_string(acc.cur, ' ')) ELSE acc.paras END, "
            f"'cur': CASE WHEN acc.tok + {t} > {size} THEN [s] ELSE list_append(acc.cur, s) END, "
            f"'tok': CASE WHEN acc.tok + {t} > {size} THEN {t} ELSE acc.tok + {t} END}}, "
            f"{{'paras': []::VARCHAR[], 'cur': []::VARCHAR[], 'tok': 0::BIGINT}})")


@register("clean_text", f"""
SELECT doc_id, {STRIP_SQL.format(x="array_to_string(list_filter(string_split(regexp_replace(replace(text, '#', ''), "
                                   "'\\\\u[0-9a-fA-F]{4}', '', 'g'), ' '), lambda w: NOT (starts_with(w, '@') "
                                   "OR starts_with(w, 'http'))), ' ')")} AS cleaned FROM documents""")
def _clean(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", chunking.clean_text("text").alias("cleaned"))


@register("token_count", f"SELECT doc_id, {TOK_SQL.format(x='text')} AS n_tokens FROM documents")
def _tokens(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", chunking.token_count("text").cast("long").alias("n_tokens"))


@register("route_oversize", f"""
SELECT doc_id, {TOK_SQL.format(x='text')} AS n_tokens, {TOK_SQL.format(x='text')} >= 500 AS too_big,
  length(text) > 500 AS split_by_chars FROM documents""")
def _route(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    r = chunking.route_oversize(d, "text")
    return r.select("doc_id", F.col("n_tokens").cast("long"), "too_big", "split_by_chars")


@register("split_sentences", f"""
SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS sent_no, unnest(s) AS sentence
FROM (SELECT doc_id, {SENTS_SQL.format(x='text')} AS s FROM documents) x""")
def _sentences(spark, sf):
    d = Tables(spark, sf).documents
    s = chunking.split_sentences(d, "doc_id", "text")
    return s.select("doc_id", F.col("sent_no").cast("long"), "sentence")


@register("pack_paragraphs", f"""
WITH s AS (SELECT doc_id, {SENTS_SQL.format(x='text')} AS s FROM documents),
r AS (SELECT doc_id, {reduce_sql('s', 500)} AS r FROM s),
p AS (SELECT doc_id, {PARAS_SQL} AS p FROM r)
SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS para_no, unnest(p) AS paragraph FROM p""")
def _paragraphs(spark, sf):
    d = Tables(spark, sf).documents
    p = chunking.pack_paragraphs(d, "doc_id", "text", 500)
    return p.select("doc_id", F.col("para_no").cast("long"), "paragraph")


CHUNKS_SQL = f"""
WITH s AS (SELECT item_id, content, language, {TOK_SQL.format(x='content')} >= 500 AND length(content) > 500 AS sp,
                  {SENTS_SQL.format(x='content')} AS s FROM V_items),
r AS (SELECT item_id, content, language, sp, CASE WHEN sp THEN {reduce_sql('s', 500)} END AS r FROM s),
p AS (SELECT item_id, language, sp, CASE WHEN sp THEN {PARAS_SQL} ELSE [content] END AS p FROM r),
o AS (SELECT *, coalesce(list_position(list_transform(p, lambda x: {TOK_SQL.format(x='x')} >= 500), true), 0) AS big FROM p),
q AS (SELECT *, CASE WHEN big > 0 THEN p[1:big - 1] ELSE p END AS few FROM o)
"""
ONE_CHUNK_SQL = """SELECT item_id, unnest(generate_series(0, len({p}) - 1)) AS chunk_no, unnest({p}) AS content,
  CASE WHEN sp THEN NULL ELSE language END AS language, sp AS was_split FROM q WHERE len({p}) > 0"""


def _chunk_rows(spark, sf, **options):
    it = v_items(Tables(spark, sf)).select("item_id", "content", "language")
    c = chunking.chunk_items(it, **options)
    return c.select("item_id", F.col("chunk_no").cast("long"), "content", "language", "was_split")


@register("chunk_items", with_views(CHUNKS_SQL + ONE_CHUNK_SQL.format(p="p"), "V_items"))
def _chunks(spark, sf):
    return _chunk_rows(spark, sf)


@register("chunk_items_strict", with_views(CHUNKS_SQL + ONE_CHUNK_SQL.format(p="few"), "V_items"))
def _chunks_strict(spark, sf):
    return _chunk_rows(spark, sf, strict_prefix=True)


@register("chunk_report", with_views(CHUNKS_SQL + f"""
SELECT item_id, len(p) AS n_chunks, len(list_filter(p, lambda x: {TOK_SQL.format(x='x')} >= 500)) AS n_oversize, len(few) AS n_strict,
  CASE WHEN len(p) = 0 THEN 'no_chunk' WHEN len(few) < len(p) THEN 'cut' WHEN sp THEN 'split' ELSE 'whole' END AS status
FROM q""", "V_items"))
def _chunk_report(spark, sf):
    return chunking.chunk_report(v_items(Tables(spark, sf)).select("item_id", "content"))


DETECT_SQL = """
WITH d AS (SELECT doc_id, lang, lower(replace(text, chr(10), ' ')) AS t FROM documents),
g AS (SELECT doc_id, lang, gram FROM (SELECT doc_id, lang, substring(t, i, 3) AS gram FROM
        (SELECT doc_id, lang, t, unnest(generate_series(1, greatest(length(t) - 2, 1))) AS i FROM d) x) y
      WHERE length(gram) = 3),
prof AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY lang, gram),
base AS (SELECT lang, CAST(round(ln(CAST(sum(n) + (SELECT count(DISTINCT gram) FROM prof) AS DOUBLE)) * 1000000) AS BIGINT) AS f
         FROM prof GROUP BY lang),
w AS (SELECT lang, gram, CAST(round(ln(CAST(n + 1 AS DOUBLE)) * 1000000) AS BIGINT) AS w FROM prof),
s AS (SELECT g.doc_id, w.lang, sum(w.w) AS w FROM g JOIN w ON g.gram = w.gram GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM g WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY doc_id),
best AS (SELECT doc_id, lang AS detected FROM (
           SELECT n.doc_id, base.lang, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.n * base.f - coalesce(s.w, 0), base.lang) AS r
           FROM n CROSS JOIN base LEFT JOIN s ON s.doc_id = n.doc_id AND s.lang = base.lang) x WHERE r = 1)
SELECT d.doc_id, best.detected FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id"""


@register("detect_language", DETECT_SQL)
def _detect(spark, sf):
    d = Tables(spark, sf).documents
    prof = chunking.train_language_profiles(d, "text", "lang")
    return chunking.detect_language(d, "doc_id", "text", prof)


@register("route_translation", with_views("""
SELECT item_id, language, CASE WHEN language = 'en' THEN 'passthrough' ELSE 'translate' END AS route,
  coalesce(nullif(content, ''), NULL) AS text, false AS translated FROM V_items""", "V_items"))
def _translate(spark, sf):
    it = v_items(Tables(spark, sf)).withColumn("title", F.lit(None).cast("string"))
    r = chunking.route_translation(it, "content", "title", "language")
    return r.select("item_id", "language", "route", "text", "translated")
