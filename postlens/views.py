"""Derived test views over the driver tables (FIXTURES.md §3).

Each view exists twice: as a DataFrame builder (used by the Spark queries) and
as portable SQL text (inlined as a CTE by the DuckDB oracle, which cannot see
Spark views).  Both are plain projections/unions of the base tables, so their
size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.tables import Tables

# --------------------------------------------------------------------------
# DataFrame forms
# --------------------------------------------------------------------------


def v_items(t: Tables) -> DataFrame:
    d = t.documents
    m = F.col("doc_id") % 6
    domain = (F.when(m == 0, "reddit.com").when(m == 1, "x.com").when(m == 2, "www.reddit.com")
              .when(m == 3, "example.org").when(m == 4, "bsky.app").otherwise("youtube.com"))
    d = d.select("doc_id", "text", "source", "lang", domain.alias("domain"))
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("content"),
        F.col("source").alias("author"), F.col("lang").alias("language"), "domain",
        F.concat(F.lit("https://"), "domain", F.lit("/p/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id").alias("minute_no"))


def v_dup_items(t: Tables) -> DataFrame:
    it = v_items(t).select("item_id", "url", "minute_no")
    base = it.select("item_id", "url", "minute_no", (F.col("item_id") % 10).alias("batch_id"))
    dup = it.where(F.col("item_id") % 7 == 0).select(
        (F.col("item_id") + 1000000).alias("item_id"), "url", (F.col("minute_no") + 5).alias("minute_no"),
        (F.col("item_id") % 10).alias("batch_id"))
    return base.unionByName(dup)


def v_ticker_text(t: Tables) -> DataFrame:
    p = t.part
    text = F.concat(
        F.col("p_name"), F.lit(" $"), F.upper(F.substring("p_name", 1, 4)), F.lit(", "), F.col("p_brand"),
        F.lit(" S&P500. "), F.col("p_type"), F.lit(" $A$B#Joined_Tag https://x.io/"),
        F.col("p_partkey").cast("string"), F.lit("\n"), F.lit("AI -ok- 5G"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def v_scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    l = t.lineitem.withColumn("chunk_no", F.row_number().over(w).cast("long"))
    return l.select(
        F.col("l_orderkey").alias("item_id"), "chunk_no", F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("source_type"),
        F.round(F.col("l_discount") * 8, 3).cast("decimal(6,3)").alias("positive"),
        F.round(F.col("l_tax") * 8, 3).cast("decimal(6,3)").alias("negative"),
        (F.col("l_quantity") / 50).cast("decimal(6,2)").alias("lexicon"),
        F.col("l_extendedprice").alias("score"))


def lineitem_chunks(t: Tables) -> DataFrame:
    """lineitem as a chunk table: order = item, line = chunk (numbered as in V_scores)."""
    # dealt by the name that the merges group by, so that they need no second shuffle
    w = Window.partitionBy("item_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return t.lineitem.select(F.col("l_orderkey").alias("item_id"), "*").withColumn(
        "chunk_no", F.row_number().over(w).cast("long"))


def v_lexicon(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("word"))
    return (words.where(F.col("word") != "")
            .groupBy("word").agg(F.max((F.length("word") * 7) % 9 - 4).cast("long").alias("valence")))


def v_updates(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id").cast("string")
    js = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"jobs":{"a":{"n":'), eid, F.lit("}}}")))
          .when(F.col("event_type") == "click", F.concat(F.lit('{"jobs":{"b":'), eid, F.lit("}}")))
          .when(F.col("event_type") == "error", F.lit('{"jobs":{"a":{"err":{}}}}'))
          .when(F.col("event_type") == "signup", F.lit('{"jobs":{"a":"reset"}}'))
          .otherwise(F.concat(F.lit('{"total":'), eid, F.lit("}"))))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), js.alias("json"))


def v_versions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    installed = F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (k % 12).cast("string"),
                         F.lit("."), (k % 5).cast("string"))
    return t.supplier.select(k.alias("module"), installed.alias("installed"), F.lit("1.10.2").alias("latest"))


# --------------------------------------------------------------------------
# SQL forms (DuckDB oracle); identical definitions
# --------------------------------------------------------------------------

SQL = {
    "V_items": """
SELECT doc_id AS item_id, text AS content, source AS author, lang AS language, domain,
       concat('https://',domain,'/p/',CAST(doc_id AS VARCHAR)) AS url, doc_id AS minute_no
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'reddit.com' WHEN 1 THEN 'x.com' WHEN 2 THEN 'www.reddit.com'
      WHEN 3 THEN 'example.org' WHEN 4 THEN 'bsky.app' ELSE 'youtube.com' END AS domain FROM documents) d""",
    "V_dup_items": """
SELECT item_id, url, minute_no, item_id % 10 AS batch_id FROM V_items
UNION ALL SELECT item_id + 1000000, url, minute_no + 5, item_id % 10 FROM V_items WHERE item_id % 7 = 0""",
    "V_ticker_text": """
SELECT p_partkey AS doc_id, concat(p_name,' $',upper(substr(p_name,1,4)),', ',p_brand,' S&P500. ',p_type,
  ' $A$B#Joined_Tag https://x.io/',CAST(p_partkey AS VARCHAR),chr(10),'AI -ok- 5G') AS text FROM part""",
    "V_scores": """
SELECT l_orderkey AS item_id, chunk_no, l_returnflag AS label, l_linestatus AS source_type,
  CAST(round(l_discount*8,3) AS DECIMAL(6,3)) AS positive, CAST(round(l_tax*8,3) AS DECIMAL(6,3)) AS negative,
  CAST(l_quantity/50 AS DECIMAL(6,2)) AS lexicon, l_extendedprice AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_shipdate, l_quantity) AS chunk_no FROM lineitem) l""",
    "V_chunks": """
SELECT l_orderkey AS item_id, *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS chunk_no FROM lineitem""",
    "V_lexicon": """
SELECT word, max((length(word)*7) % 9 - 4) AS valence
FROM (SELECT lower(w) AS word FROM (SELECT unnest(string_split(text,' ')) AS w FROM benchmark) a) b
WHERE word <> '' GROUP BY word""",
    "V_updates": """
SELECT user_id AS key, event_id AS seq, CASE event_type
  WHEN 'view'   THEN concat('{"jobs":{"a":{"n":',CAST(event_id AS VARCHAR),'}}}')
  WHEN 'click'  THEN concat('{"jobs":{"b":',CAST(event_id AS VARCHAR),'}}')
  WHEN 'error'  THEN '{"jobs":{"a":{"err":{}}}}'
  WHEN 'signup' THEN '{"jobs":{"a":"reset"}}'
  ELSE concat('{"total":',CAST(event_id AS VARCHAR),'}') END AS json FROM events""",
    "V_versions": """
SELECT s_suppkey AS module, concat('v',CAST(s_suppkey % 3 AS VARCHAR),'.',CAST(s_suppkey % 12 AS VARCHAR),
  '.',CAST(s_suppkey % 5 AS VARCHAR)) AS installed, '1.10.2' AS latest FROM supplier""",
}

_DEPS = {"V_dup_items": ["V_items"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
