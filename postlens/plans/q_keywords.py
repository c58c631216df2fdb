"""Queries of §2.3 (documents, V_ticker_text, embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.spread import spread
from postlens.operators import keywords as K
from postlens.plans.q_text import SENTS_SQL
from postlens.plans.registry import register
from postlens.tables import Tables
from postlens.views import v_ticker_text, with_views

PUNCT_SQL = K.PUNCT_NO_HYPHEN.replace("'", "''")


def _words_sql(src: str, text: str = "text", sep: str = "' '") -> str:
    return (f"SELECT doc_id, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS kw "
            f"FROM (SELECT doc_id, string_split({text}, {sep}) AS ws FROM {src}) a")


@register("kw_noise_filter", f"""
WITH w AS ({_words_sql('documents')}),
f AS (SELECT doc_id, pos, length(regexp_replace(kw, '\\p{{L}}', '', 'g')) AS sp,
        regexp_replace(regexp_replace(kw, '^[^A-Za-z0-9 ]+|[^A-Za-z0-9 ]+$', '', 'g'), '\\\\u[0-9a-fA-F]{{4}}', '', 'g') AS kw
      FROM w WHERE NOT regexp_matches(kw, '{PUNCT_SQL}')),
g AS (SELECT * FROM f WHERE length(kw) > 0 AND sp * 100 <= 20 * length(kw) AND regexp_matches(kw, '\\p{{L}}'))
SELECT doc_id, min(pos) AS pos, kw FROM g GROUP BY doc_id, kw""")
def _noise(spark, sf):
    d = spread(Tables(spark, sf).documents.select("doc_id", "text"))
    return K.noise_filter(K.words(d, "doc_id", "text")).select("doc_id", F.col("pos").cast("long"), "kw")


@register("kw_tickers", with_views(f"""
SELECT doc_id, pos, replace(replace(kw, ',', ''), '.', '') AS kw FROM (
  {_words_sql('V_ticker_text', "replace(replace(text, chr(10), chr(10) || ' '), '$', ' $')")}) b
WHERE starts_with(kw, '$') AND length(kw) > 1""", "V_ticker_text"))
def _tickers(spark, sf):
    t = v_ticker_text(Tables(spark, sf))
    return K.tickers(t, "doc_id", "text").select("doc_id", F.col("pos").cast("long"), "kw")


UPPER_SQL = "len(regexp_extract_all(kw, '\\p{Lu}')) * 10 >= length(kw) * 3"


@register("kw_special_tokens", with_views(f"""
WITH t AS (SELECT doc_id, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS kw0
           FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\t\\r\\n]+') AS ws FROM V_ticker_text) a),
u AS (SELECT doc_id, pos, regexp_replace(kw0, '^[.,;:!?"''()\\[\\]{{}}]+|[.,;:!?"''()\\[\\]{{}}]+$', '', 'g') AS kw FROM t)
SELECT doc_id, pos, kw FROM u WHERE length(kw) > 0 AND {UPPER_SQL}
  AND regexp_matches(kw, '[^\\p{{L}}\\p{{N}}_ \\t\\r\\n,]') AND len(regexp_extract_all(kw, '\\p{{L}}')) > 1""",
                                      "V_ticker_text"))
def _special(spark, sf):
    t = v_ticker_text(Tables(spark, sf))
    return K.special_tokens(t, "doc_id", "text").select("doc_id", F.col("pos").cast("long"), "kw")


@register("kw_acronyms", f"""
WITH w AS ({_words_sql('documents')}),
u AS (SELECT doc_id, pos, replace(replace(kw, ',', ''), '.', '') AS kw FROM w WHERE length(kw) > 1)
SELECT doc_id, pos, kw FROM u WHERE {UPPER_SQL} AND regexp_matches(kw, '\\p{{L}}') AND length(kw) >= 2""")
def _acronyms(spark, sf):
    d = Tables(spark, sf).documents
    return K.acronyms(d, "doc_id", "text").select("doc_id", F.col("pos").cast("long"), "kw")


@register("kw_split_joined", with_views(f"""
WITH w AS ({_words_sql('V_ticker_text')}),
p AS (SELECT doc_id, pos, kw, list_filter(regexp_split_to_array(kw, '[$#]+'), lambda p: p <> '') AS parts FROM w),
o AS (SELECT doc_id, pos, CASE WHEN len(parts) > 1 THEN list_filter(parts, lambda p: length(p) > 2) ELSE [kw] END AS o FROM p),
x AS (SELECT doc_id, pos, unnest(generate_series(0, len(o) - 1)) AS sub, unnest(o) AS kw FROM o)
SELECT doc_id, pos * 1000000 + sub AS pos, kw FROM x""", "V_ticker_text"))
def _split_joined(spark, sf):
    t = v_ticker_text(Tables(spark, sf))
    return K.split_joined(K.words(t, "doc_id", "text")).select("doc_id", F.col("pos").cast("long"), "kw")


@register("kw_drop_invalid", with_views(f"""
WITH w AS ({_words_sql('V_ticker_text')}),
c AS (SELECT doc_id, pos, regexp_replace(kw, '//|https?://.*[\\r\\n]*', '', 'g') AS kw FROM w)
SELECT doc_id, min(pos) AS pos, kw FROM c WHERE length(kw) > 2 AND length(kw) <= 100 GROUP BY doc_id, kw""",
                                    "V_ticker_text"))
def _drop_invalid(spark, sf):
    t = spread(v_ticker_text(Tables(spark, sf)))
    return K.drop_invalid(K.words(t, "doc_id", "text")).select("doc_id", F.col("pos").cast("long"), "kw")


@register("kw_case_expand", with_views(f"""
WITH w AS ({_words_sql('V_ticker_text')}),
o AS (SELECT doc_id, pos, CASE WHEN upper(kw) = kw AND lower(kw) <> kw THEN [kw, lower(kw)]
        WHEN NOT (lower(kw) = kw AND upper(kw) <> kw) THEN [lower(kw)] ELSE [kw] END AS o FROM w),
x AS (SELECT doc_id, pos, unnest(generate_series(0, len(o) - 1)) AS sub, unnest(o) AS kw FROM o)
SELECT doc_id, min(pos * 2 + sub) AS pos, kw FROM x GROUP BY doc_id, kw""", "V_ticker_text"))
def _case(spark, sf):
    t = spread(v_ticker_text(Tables(spark, sf)))
    return K.case_expand(K.words(t, "doc_id", "text")).select("doc_id", F.col("pos").cast("long"), "kw")


# Word occurrences of every document with their sentence; a term is a lower-cased word.
OCC_SQL = """s AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS sent_no, unnest(s) AS sentence
  FROM (SELECT doc_id, """ + SENTS_SQL.format(x="text") + """ AS s FROM documents) x),
w AS (SELECT doc_id, sent_no, unnest(generate_series(0, len(ws) - 1)) AS tok_no, unnest(ws) AS word
  FROM (SELECT doc_id, sent_no, regexp_extract_all(sentence, '[\\p{L}\\p{N}]+') AS ws FROM s) x),
occ AS MATERIALIZED (SELECT doc_id, sent_no, tok_no, lower(word) AS term,
  tok_no > 0 AND regexp_matches(word, '^\\p{Lu}') AS cap,
  length(word) > 1 AND regexp_matches(word, '\\p{Lu}') AND NOT regexp_matches(word, '\\p{Ll}') AS acr,
  NOT (lower(word) IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'has', 'have', 'he', 'her', 'his',
    'i', 'in', 'is', 'it', 'its', 'not', 'of', 'on', 'or', 'she', 'that', 'the', 'their', 'they', 'this', 'to', 'was', 'we',
    'were', 'which', 'with', 'you') OR length(lower(word)) < 3 OR regexp_matches(lower(word), '^\\p{N}+$')) AS cand
  FROM w),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, CAST(count_if(cap) AS BIGINT) AS tf_u, CAST(count_if(acr) AS BIGINT) AS tf_a,
  count(DISTINCT sent_no) AS sf, median(DISTINCT sent_no) AS med FROM occ WHERE cand GROUP BY 1, 2),
docs AS (SELECT doc_id, max(sent_no) + 1 AS n_sents FROM occ GROUP BY 1),
tops AS (SELECT doc_id, avg(tf) AS m, stddev_pop(tf) AS sd, max(tf) AS mx FROM tf GROUP BY 1)"""


def _single_sql(name: str, window: int) -> str:
    """Tables with the single-term score S, by the features of YAKE with a window."""
    return f"""{name}l AS (SELECT a.doc_id, a.term, count(DISTINCT b.term) / count(*) AS r FROM occ a JOIN occ b
  ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND b.tok_no BETWEEN a.tok_no - {window} AND a.tok_no - 1 WHERE a.cand GROUP BY 1, 2),
{name}r AS (SELECT a.doc_id, a.term, count(DISTINCT b.term) / count(*) AS r FROM occ a JOIN occ b
  ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + {window} WHERE a.cand GROUP BY 1, 2),
{name}f AS (SELECT tf.*, greatest(tf_u, tf_a) / (1 + ln(tf)) AS t_case, ln(ln(3 + med)) AS t_pos, tf / (m + sd) AS t_norm,
  1 + (coalesce(l.r, 0) + coalesce(r.r, 0)) * tf / mx AS t_rel, sf / n_sents AS t_sent
  FROM tf JOIN docs USING (doc_id) JOIN tops USING (doc_id)
  LEFT JOIN {name}l l ON l.doc_id = tf.doc_id AND l.term = tf.term LEFT JOIN {name}r r ON r.doc_id = tf.doc_id AND r.term = tf.term),
{name} AS MATERIALIZED (SELECT *, t_rel * t_pos / (t_case + t_norm / t_rel + t_sent / t_rel) AS s FROM {name}f)"""


ONE_SQL = _single_sql("s1", 1) + """,
one AS MATERIALIZED (SELECT doc_id, term, tf, tf_u, tf_a, sf, s / (tf * (1 + s)) AS score,
  row_number() OVER (PARTITION BY doc_id ORDER BY round(s / (tf * (1 + s)), 9), term) AS rank FROM s1)"""
TWO_SQL = _single_sql("s7", 7) + """,
pairs AS (SELECT a.doc_id, a.term AS t1, b.term AS t2, count(*) AS tf FROM occ a JOIN occ b
  ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND b.tok_no = a.tok_no + 1 WHERE a.cand AND b.cand GROUP BY 1, 2, 3),
both_ AS (SELECT doc_id, term, tf, s / (tf * (1 + s)) AS score FROM s7 UNION ALL
  SELECT p.doc_id, t1 || ' ' || t2, p.tf, x.s * y.s / (p.tf * (1 + x.s + y.s)) FROM pairs p
  JOIN s7 x ON x.doc_id = p.doc_id AND x.term = t1 JOIN s7 y ON y.doc_id = p.doc_id AND y.term = t2),
two AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9), term) AS rank FROM both_)"""


def _plain_sql(x: str) -> str:
    """Small letters of Latin-1 as other single bytes, as DuckDB's levenshtein counts bytes."""
    return f"translate({x}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!?#%&*+')"


def _greedy_sql(name: str, src: str, top: int, where: str = "true") -> str:
    """The terms that stay, best first, as a list per document."""
    a, b = _plain_sql("k"), _plain_sql("x.term")
    longer = "greatest(length(k), length(x.term))"
    return f"""{name} AS MATERIALIZED (SELECT doc_id, list_reduce(list({{'term': term, 'kept': []::VARCHAR[]}} ORDER BY rank), lambda acc, x:
  CASE WHEN len(acc.kept) >= {top} OR len(list_filter(acc.kept, lambda k: CASE WHEN {longer} > 10
    AND abs(length(k) - length(x.term)) < {longer} * (1 - 0.9::DOUBLE)
    THEN 1 - levenshtein({a}, {b}) / {longer} > 0.9::DOUBLE ELSE k = x.term END)) > 0
  THEN {{'term': x.term, 'kept': acc.kept}} ELSE {{'term': x.term, 'kept': list_append(acc.kept, x.term)}} END,
  {{'term': '', 'kept': []::VARCHAR[]}}).kept AS kept FROM {src} WHERE {where} GROUP BY doc_id)"""


# Character trigrams of a term between < and >, hashed to buckets; cosine of counts.
SIMILAR_SQL = """v AS (SELECT term, '<' || term || '>' AS p FROM (SELECT DISTINCT term FROM tf) x),
g AS (SELECT term, (ord(p[i]) * 961 + ord(p[i + 1]) * 31 + ord(p[i + 2])) % 4093 AS b
  FROM (SELECT term, p, unnest(generate_series(1, length(p) - 2)) AS i FROM v) x),
gv AS MATERIALIZED (SELECT term, b, count(*) AS c FROM g GROUP BY 1, 2),
gn AS (SELECT term, sum(c * c) AS n FROM gv GROUP BY 1),
dv AS MATERIALIZED (SELECT doc_id, b, sum(c * tf) AS c FROM tf JOIN gv USING (term) GROUP BY 1, 2),
dn AS (SELECT doc_id, sum(c * c) AS n FROM dv GROUP BY 1),
dot AS (SELECT tf.doc_id, tf.term, sum(gv.c * dv.c) AS d FROM tf JOIN gv ON gv.term = tf.term
  JOIN dv ON dv.doc_id = tf.doc_id AND dv.b = gv.b GROUP BY 1, 2),
cosine AS (SELECT doc_id, dot.term, d / (sqrt(gn.n::DOUBLE) * sqrt(dn.n::DOUBLE)) AS sim FROM dot JOIN gn ON gn.term = dot.term JOIN dn USING (doc_id)),
nearest AS (SELECT doc_id, term FROM cosine WHERE sim > 0.175
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(-sim, 9), term) <= 5)"""


@register("kw_unigram_stats", f"""WITH {OCC_SQL},
{ONE_SQL}
SELECT doc_id, term, tf, tf_u, tf_a, sf, round(score, 6) AS score, rank FROM one WHERE rank <= 20""")
def _unigram(spark, sf):
    d = spread(Tables(spark, sf).documents.select("doc_id", "text"))
    u = K.unigram_stats(d, "doc_id", "text")
    return u.select("doc_id", "term", "tf", "tf_u", "tf_a", "sf", F.round("score", 6).alias("score"),
                    F.col("rank").cast("long"))


@register("kw_bigram_stats", f"""WITH {OCC_SQL},
{TWO_SQL}
SELECT doc_id, term, tf, round(score, 6) AS score, rank FROM two WHERE rank <= 10""")
def _bigram(spark, sf):
    d = spread(Tables(spark, sf).documents.select("doc_id", "text"))
    b = K.bigram_stats(d, "doc_id", "text", window=7, top=10)
    return b.select("doc_id", "term", "tf", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@register("kw_near_dup", f"""WITH {OCC_SQL},
{ONE_SQL},
{_greedy_sql("best", "one", 1 << 30)}
SELECT doc_id, term, rank FROM one JOIN (SELECT doc_id, unnest(kept) AS term FROM best) USING (doc_id, term)""")
def _near_dup(spark, sf):
    d = spread(Tables(spark, sf).documents.select("doc_id", "text"))
    u = K.unigram_stats(d, "doc_id", "text", window=1, top=None)
    return K.near_dup(u.select("doc_id", "term", "rank")).select("doc_id", "term", F.col("rank").cast("long"))


def _label_vectors(t: Tables):
    e = t.embeddings
    ex = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    m = ex.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                                              lambda s: s["m"]).alias("embedding"))


@register("kw_embedding", """
WITH ex AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
            FROM embeddings),
dv AS (SELECT label, pos, avg(v) AS m FROM ex GROUP BY 1, 2),
nd AS (SELECT label, sum(m * m) AS nd FROM dv GROUP BY 1),
s AS (SELECT ex.label, ex.vec_id, sum(ex.v * dv.m) AS dot, sum(ex.v * ex.v) AS nv
      FROM ex JOIN dv ON ex.label = dv.label AND ex.pos = dv.pos GROUP BY 1, 2),
c AS (SELECT s.label, s.vec_id, dot / (sqrt(nv) * sqrt(nd)) AS similarity FROM s JOIN nd ON s.label = nd.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM c
      WHERE similarity > 0.175)
SELECT label, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def _semantic(spark, sf):
    t = Tables(spark, sf)
    cands = t.embeddings.select("label", "vec_id", "embedding")
    s = K.semantic_candidates(cands, _label_vectors(t), "label", "vec_id", "embedding")
    return s.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long"))


@register("extract_keywords", f"""WITH {OCC_SQL},
{ONE_SQL},
{TWO_SQL},
{SIMILAR_SQL},
{_greedy_sql("best1", "one", 20)},
{_greedy_sql("best2", "two", 10)},
ranked AS (SELECT doc_id, unnest(kept) AS kw FROM best1 UNION SELECT doc_id, unnest(kept) FROM best2 UNION SELECT * FROM nearest),
trimmed AS (SELECT doc_id, length(regexp_replace(kw, '\\p{{L}}', '', 'g')) AS sp,
  regexp_replace(regexp_replace(kw, '^[^A-Za-z0-9 ]+|[^A-Za-z0-9 ]+$', '', 'g'), '\\\\u[0-9a-fA-F]{{4}}', '', 'g') AS kw
  FROM ranked WHERE NOT regexp_matches(kw, '{PUNCT_SQL}')),
stat AS (SELECT doc_id, kw FROM trimmed WHERE length(kw) > 0 AND sp * 100 <= 20 * length(kw) AND regexp_matches(kw, '\\p{{L}}')),
tick AS (SELECT doc_id, replace(replace(kw, ',', ''), '.', '') AS kw FROM (SELECT doc_id, unnest(string_split(
  replace(replace(text, chr(10), chr(10) || ' '), '$', ' $'), ' ')) AS kw FROM documents) x WHERE starts_with(kw, '$') AND length(kw) > 1),
spec AS (SELECT doc_id, regexp_replace(kw, '^[.,;:!?"''()\\[\\]{{}}]+|[.,;:!?"''()\\[\\]{{}}]+$', '', 'g') AS kw
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS kw FROM documents) x),
word AS (SELECT doc_id, replace(replace(kw, ',', ''), '.', '') AS kw
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS kw FROM documents) x WHERE length(kw) > 1),
every AS (SELECT * FROM stat UNION SELECT * FROM tick UNION
  SELECT * FROM spec WHERE length(kw) > 0 AND {UPPER_SQL} AND regexp_matches(kw, '[^\\p{{L}}\\p{{N}}_ \\t\\r\\n,]')
    AND len(regexp_extract_all(kw, '\\p{{L}}')) > 1 UNION
  SELECT * FROM word WHERE {UPPER_SQL} AND regexp_matches(kw, '\\p{{L}}') AND length(kw) >= 2),
cut AS (SELECT doc_id, kw, list_filter(regexp_split_to_array(kw, '[$#]+'), lambda p: p <> '') AS parts FROM every),
part AS (SELECT doc_id, regexp_replace(unnest(CASE WHEN len(parts) > 1 THEN list_filter(parts, lambda p: length(p) > 2) ELSE [kw] END),
  '//|https?://.*[\\r\\n]*', '', 'g') AS kw FROM cut),
cased AS (SELECT doc_id, unnest(CASE WHEN upper(kw) = kw AND lower(kw) <> kw THEN [kw, lower(kw)]
  WHEN NOT (lower(kw) = kw AND upper(kw) <> kw) THEN [lower(kw)] ELSE [kw] END) AS kw FROM part WHERE length(kw) > 2 AND length(kw) <= 100),
lists AS (SELECT doc_id, list_sort(list(DISTINCT kw)) AS k FROM cased GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(k, ','), '') AS keywords, coalesce(len(k), 0) AS n_keywords FROM documents LEFT JOIN lists USING (doc_id)""")
def _extract(spark, sf):
    d = spread(Tables(spark, sf).documents.select("doc_id", "text"))
    k = K.extract_keywords(d, "doc_id", "text")
    return k.select("doc_id", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").alias("n_keywords"))
