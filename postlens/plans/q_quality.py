"""Queries of §2.1: sources, sinks, schema and quality gates."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlens.functions import text as T
from postlens.operators import quality, stats
from postlens.plans.registry import register
from postlens.session import checkpoint_dir
from postlens.sources import batches
from postlens.sources.schema import AGES, BATCH, EMOTIONS, GENDERS, IRONY, ISO_PATTERN, TEXT_TYPES, URL_PATTERN
from postlens.tables import Tables
from postlens.views import v_dup_items, v_items, with_views

DECODE = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), " \
         "'&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
HOST_SQL = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)"
TITLE_SQL = "trim(" + DECODE.format(x="regexp_extract({h}, '(?s)<title[^>]*>(.*?)</title>', 1)") + ")"
CONTENT_SQL = ("trim(regexp_replace(" + DECODE.format(
    x="regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), "
      "'(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")
    + ", '[ \\t\\r\\n]+', ' ', 'g'))")
LANG_SQL = "regexp_extract({h}, '<html[^>]*[ ]lang=\"([^\"]+)\"', 1)"


@register("pages_to_items", f"""
SELECT page_id, url, {HOST_SQL.format(u='url')} AS domain, {TITLE_SQL.format(h='html')} AS title,
  {CONTENT_SQL.format(h='html')} AS content, {LANG_SQL.format(h='html')} AS language FROM pages""")
def _pages(spark, sf):
    return quality.pages_to_items(Tables(spark, sf).pages)


# ---- validation on V_items with planted faults ------------------------------------------

def _faulty_items(t: Tables):
    it = v_items(t)
    k = F.col("item_id")
    created = F.date_format(F.timestamp_add("MINUTE", k, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
                            "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return it.select(
        "item_id",
        F.when(k % 11 == 0, F.regexp_replace(created, "Z$", "")).otherwise(created).alias("created_at"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("language")).alias("language"),
        "domain",
        F.when(k % 13 == 0, F.replace("url", F.lit("https://"), F.lit("ftp://"))).otherwise(F.col("url")).alias("url"),
        F.when(k % 19 == 0, F.array("author", "author")).otherwise(F.array("author", "domain")).alias("top_keywords"),
        F.when(k % 23 == 0, F.lit("BOGUS")).otherwise(F.lit("SPOTTING")).alias("kind"))


FAULTY_SQL = f"""
fi AS (SELECT item_id,
  CASE WHEN item_id % 11 = 0 THEN regexp_replace(c, 'Z$', '') ELSE c END AS created_at,
  CASE WHEN item_id % 17 = 0 THEN NULL ELSE language END AS language, domain,
  CASE WHEN item_id % 13 = 0 THEN replace(url, 'https://', 'ftp://') ELSE url END AS url,
  CASE WHEN item_id % 19 = 0 THEN [author, author] ELSE [author, domain] END AS top_keywords,
  CASE WHEN item_id % 23 = 0 THEN 'BOGUS' ELSE 'SPOTTING' END AS kind
  FROM (SELECT *, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(item_id), '%Y-%m-%dT%H:%M:%SZ') AS c
        FROM V_items) x),
vi AS (SELECT item_id, list_filter([
    CASE WHEN created_at IS NULL THEN 'missing:created_at' END,
    CASE WHEN language IS NULL THEN 'missing:language' END,
    CASE WHEN domain IS NULL THEN 'missing:domain' END,
    CASE WHEN url IS NULL THEN 'missing:url' END,
    CASE WHEN created_at IS NOT NULL AND NOT regexp_matches(created_at, '{ISO_PATTERN}') THEN 'pattern:created_at' END,
    CASE WHEN url IS NOT NULL AND NOT regexp_matches(url, '{URL_PATTERN}') THEN 'pattern:url' END,
    CASE WHEN kind NOT IN ('SPOTTING', 'VALIDATION') OR kind IS NULL THEN 'enum:kind' END,
    CASE WHEN len(list_distinct(top_keywords)) <> len(top_keywords) THEN 'unique:top_keywords' END], lambda x: x IS NOT NULL)
    AS violations FROM fi)"""


@register("validate_items", with_views(f"""
WITH {FAULTY_SQL}
SELECT item_id, array_to_string(violations, ',') AS violations, CAST(len(violations) AS INTEGER) AS n_violations
FROM vi""", "V_items"))
def _validate(spark, sf):
    v = quality.validate_items(_faulty_items(Tables(spark, sf)))
    return v.select("item_id", F.array_join("violations", ",").alias("violations"),
                    F.size("violations").alias("n_violations"))


@register("quarantine_items", with_views(f"""
WITH {FAULTY_SQL}
SELECT reason, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(violations) = 0 THEN ['valid'] ELSE violations END) AS reason FROM vi) x
GROUP BY reason""", "V_items"))
def _quarantine(spark, sf):
    return quality.rejection_report(quality.validate_items(_faulty_items(Tables(spark, sf))))


@register("require_content", f"""
SELECT d.doc_id FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id
WHERE coalesce(nullif(CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END, ''),
               nullif({TITLE_SQL.format(h='p.html')}, '')) IS NOT NULL""")
def _require_content(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text"))
                           .alias("content"))
    p = t.pages.select(F.col("page_id"), T.html_title("html").alias("title"))
    j = d.join(p, d["doc_id"] == p["page_id"], "left")
    return quality.require_content(j).select("doc_id")


@register("project_item", with_views("""
SELECT item_id, content AS raw_content, content AS translated_content, domain, url, language,
  nullif(author, '') AS author, CAST(item_id AS VARCHAR) AS external_id,
  nullif(CASE WHEN item_id % 3 = 0 THEN '' ELSE 'p' || CAST(item_id % 50 AS VARCHAR) END, '') AS external_parent_id
FROM V_items""", "V_items"))
def _project(spark, sf):
    it = v_items(Tables(spark, sf)).select(
        "item_id", F.col("content").alias("raw_content"), F.col("content").alias("translated_content"),
        "domain", "url", "language", "author", F.col("item_id").alias("external_id"),
        F.when(F.col("item_id") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("p"), (F.col("item_id") % 50).cast("string"))).alias("external_parent_id"))
    p = quality.project_item(it)
    return p.select("item_id", "item.raw_content", "item.translated_content", "item.domain", "item.url",
                    "item.language", "item.author", "item.external_id", "item.external_parent_id")


@register("hash_author", "SELECT c_custkey, sha1(c_name) AS author FROM customer")
def _hash_author(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", F.col("c_name").alias("author"))
    return quality.hash_author(c)


ISO_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _parse_sql(x):
    return (f"CASE WHEN regexp_matches({x}, '{ISO_PATTERN}') THEN "
            f"TRY_CAST(regexp_replace(replace({x}, 'T', ' '), 'Z$', '') AS TIMESTAMP) END")


@register("iso_timestamp", f"""
SELECT event_id, iso, regexp_matches(iso, '{ISO_PATTERN}') AS valid, {_parse_sql('iso')} AS parsed,
  regexp_matches(loose, '{ISO_PATTERN}') AS loose_valid, {_parse_sql('loose')} AS loose_parsed
FROM (SELECT event_id, {ISO_SQL} AS iso, replace({ISO_SQL}, '.', 'x') AS loose FROM events) e""")
def _iso(spark, sf):
    e = Tables(spark, sf).events.select("event_id", T.format_iso("ts").alias("iso"))
    e = e.withColumn("loose", F.replace("iso", F.lit("."), F.lit("x")))
    return e.select("event_id", "iso", T.is_iso("iso").alias("valid"), T.parse_iso("iso").alias("parsed"),
                    T.is_iso("loose").alias("loose_valid"), T.parse_iso("loose").alias("loose_parsed"))


@register("freshness_filter", """
SELECT event_id FROM events, (SELECT max(ts) AS a FROM events) m WHERE ts >= a - INTERVAL 259200 SECOND""")
def _fresh(spark, sf):
    e = Tables(spark, sf).events
    return quality.freshness_filter(e, "ts", 3 * 86400).select("event_id")


@register("min_length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 2000")
def _min_len(spark, sf):
    return quality.min_length_filter(Tables(spark, sf).documents, "text", 2000).select("doc_id", "n_chars")


@register("cap_per_query", """
SELECT event_id, event_type, rank_in_query FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank_in_query
  FROM events) x WHERE rank_in_query <= 25""")
def _cap(spark, sf):
    e = Tables(spark, sf).events
    c = quality.cap_per_query(e, ["event_type"], 25, ["ts", "event_id"])
    return c.select("event_id", "event_type", F.col("rank_in_query").cast("long").alias("rank_in_query"))


@register("url_domain_check", f"""
SELECT page_id, {HOST_SQL.format(u='url')} AS host, contains({HOST_SQL.format(u='url')}, 'example.com') AS domain_ok
FROM pages""")
def _url_check(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", "url")
    return quality.url_domain_check(p, "url", F.lit("example.com")).select(
        "page_id", T.url_host("url").alias("host"), "domain_ok")


@register("dedup_url", with_views("""
SELECT item_id, url, minute_no, batch_id, duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY minute_no, item_id) AS rn,
         count(*) OVER (PARTITION BY url) - 1 AS duplicates FROM V_dup_items) x WHERE rn = 1""", "V_dup_items"))
def _dedup(spark, sf):
    return quality.dedup_url(v_dup_items(Tables(spark, sf)))


@register("submission_report", with_views(f"""
WITH f AS (SELECT url, min(minute_no * 10000000 + item_id) AS first_key FROM V_dup_items GROUP BY url),
j AS (SELECT d.*, (d.minute_no * 10000000 + d.item_id) <> f.first_key AS is_dup,
        NOT regexp_matches(d.url, '{URL_PATTERN}') AS bad FROM V_dup_items d JOIN f USING (url))
SELECT batch_id, count(*) AS submitted, count(*) FILTER (WHERE NOT is_dup AND NOT bad) AS accepted,
  count(*) FILTER (WHERE bad) AS rejected, count(*) FILTER (WHERE is_dup AND NOT bad) AS duplicates
FROM j GROUP BY batch_id""", "V_dup_items"))
def _report(spark, sf):
    return quality.submission_report(v_dup_items(Tables(spark, sf)))


@register("parse_keyword_list", """
SELECT p_partkey, keyword FROM (
  SELECT p_partkey, regexp_replace(replace(regexp_replace(k, '^[ \\t\\r\\n\\x0b\\x0c]+|[ \\t\\r\\n\\x0b\\x0c]+$', '', 'g'),
           chr(13), ''), '\\\\u[0-9a-fA-F]{4}', '', 'g') AS keyword
  FROM (SELECT p_partkey, unnest(string_split(replace(p_name || ', ' || p_type || ',' || chr(10) || p_brand
         || ',,\\u00e9' || lower(p_brand), chr(10), ''), ',')) AS k FROM part) a) b
WHERE keyword <> ''""")
def _parse_kw(spark, sf):
    p = Tables(spark, sf).part
    txt = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(",\n"), F.col("p_brand"),
                   F.lit(",,\\u00e9"), F.lower("p_brand"))
    return quality.parse_keyword_list(p.select("p_partkey", txt.alias("text")), "text", keep=["p_partkey"])


# ---- batch documents ---------------------------------------------------------------------

ITEMS_PER_BATCH = 100


def _analysis(k, label):
    """A full analysis of an item; its scores are 64ths, so that every engine has the same numbers."""
    def score(i: int):
        return F.pmod(k * (i + 1), F.lit(64)).cast("double") / 64.0

    def family(names):
        return F.struct(*[score(i).alias(n) for i, n in enumerate(names)])

    return F.struct(
        F.struct(label.alias("label"), score(0).alias("score")).alias("classification"),
        F.array(F.concat(F.lit("kw"), F.pmod(k, F.lit(7)).cast("string")), F.col("domain")).alias("top_keywords"),
        score(1).alias("language_score"), (score(2) * 2 - 1).alias("sentiment"),
        F.array(*[score(i) for i in range(4)]).alias("embedding"), family(GENDERS).alias("gender"),
        F.lit("social").alias("source_type"), family(TEXT_TYPES).alias("text_type"), family(EMOTIONS).alias("emotion"),
        family(IRONY).alias("irony"), family(AGES).alias("age"))


def _processed_items(t: Tables):
    j = v_items(t).withColumn("batch_id", F.floor(F.col("item_id") / ITEMS_PER_BATCH).cast("long"))
    j = j.withColumn("analysis", _analysis(F.col("item_id"), F.col("author")))
    j = quality.project_item(j.select("*", F.col("content").alias("raw_content"),
                                      F.col("content").alias("translated_content"),
                                      F.lit("2024-01-01T00:00:00Z").alias("created_at"),
                                      F.col("item_id").cast("string").alias("external_id")))
    return j.select("batch_id", F.col("item_id").alias("item_no"), "item", "analysis",
                    F.lit("postlens").alias("collection_client_version"), F.lit("unknown").alias("collection_module"),
                    F.lit("2024-01-01T00:00:00Z").alias("collected_at"))


def _score_sql(i: int) -> str:
    return f"CAST((item_id * {i + 1}) % 64 AS DOUBLE) / 64"


def _written(spark, sf) -> str:
    path = os.path.join(checkpoint_dir(spark), f"batches-{uuid.uuid4().hex}")
    batches.write_batches(_processed_items(Tables(spark, sf)), path)
    return path


@register("read_batches", with_views(f"""
SELECT CAST(item_id AS VARCHAR) AS external_id, content AS raw_content, content AS translated_content,
  '2024-01-01T00:00:00Z' AS created_at, nullif(author, '') AS author, domain, url, language, 'SPOTTING' AS kind,
  row_number() OVER (PARTITION BY item_id // {ITEMS_PER_BATCH} ORDER BY item_id) - 1 AS item_no,
  author AS label, {_score_sql(0)} AS label_score, {_score_sql(1)} AS language_score, {_score_sql(2)} * 2 - 1 AS sentiment,
  'kw' || CAST(item_id % 7 AS VARCHAR) || ' ' || domain AS keywords, {_score_sql(3)} AS embedding_3,
  {_score_sql(len(EMOTIONS) - 1)} AS last_emotion, {_score_sql(len(AGES) - 1)} AS last_age, {_score_sql(1)} AS non_irony,
  'postlens' AS collection_client_version, 'unknown' AS collection_module, '2024-01-01T00:00:00Z' AS collected_at
FROM V_items""", "V_items"))
def _read_batches(spark, sf):
    r = batches.read_batches(spark, _written(spark, sf))
    a = F.col("analysis")
    return r.select("item.external_id", "item.raw_content", "item.translated_content", "item.created_at", "item.author",
                    "item.domain", "item.url", "item.language", "kind", F.col("item_no").cast("long").alias("item_no"),
                    a["classification"]["label"].alias("label"), a["classification"]["score"].alias("label_score"),
                    a["language_score"].alias("language_score"), a["sentiment"].alias("sentiment"),
                    F.array_join(a["top_keywords"], " ").alias("keywords"), F.get(a["embedding"], F.lit(3)).alias("embedding_3"),
                    a["emotion"][EMOTIONS[-1]].alias("last_emotion"), a["age"][AGES[-1]].alias("last_age"),
                    a["irony"]["non_irony"].alias("non_irony"),
                    "collection_client_version", "collection_module", "collected_at")


@register("write_batches", with_views(f"""
SELECT item_id // {ITEMS_PER_BATCH} AS batch_id, CAST(count(*) AS INTEGER) AS n_items, 'SPOTTING' AS kind,
  md5(string_agg(coalesce(content, ''), chr(10) ORDER BY item_id)) AS contents_md5,
  string_agg(url, ' ' ORDER BY item_id) AS urls, sum({_score_sql(2)} * 2 - 1) AS sentiment_sum
FROM V_items GROUP BY 1""", "V_items"))
def _write_batches(spark, sf):
    # read back from the files: one line is one document
    lines = spark.read.text(_written(spark, sf))
    d = lines.select(F.from_json("value", StructType(BATCH.fields[:2])).alias("d")).select("d.*")
    return d.select(
        F.floor(F.col("items")[0]["item"]["external_id"].cast("long") / ITEMS_PER_BATCH).cast("long").alias("batch_id"),
        F.size("items").alias("n_items"), "kind",
        F.md5(F.array_join(F.transform("items", lambda x: F.coalesce(x["item"]["translated_content"], F.lit(""))), "\n")
              .cast("binary")).alias("contents_md5"),
        F.array_join(F.transform("items", lambda x: x["item"]["url"]), " ").alias("urls"),
        F.aggregate("items", F.lit(0.0), lambda s, x: s + x["analysis"]["sentiment"]).alias("sentiment_sum"))
