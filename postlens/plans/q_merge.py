"""Queries of §2.5: merging chunks (lineitem: order = item, line = chunk;
embeddings: label = item, vector = chunk; V_scores for the full merge)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import merge
from postlens.plans.registry import register
from postlens.sources.schema import AGES, EMOTIONS, GENDERS, IRONY, TEXT_TYPES
from postlens.tables import Tables
from postlens.views import lineitem_chunks, v_scores, with_views


@register("group_chunks", with_views("""
SELECT item_id, count(*) AS n_chunks, min(chunk_no) AS first_chunk, max(chunk_no) AS last_chunk
FROM V_chunks GROUP BY item_id""", "V_chunks"))
def _group(spark, sf):
    return merge.group_chunks(lineitem_chunks(Tables(spark, sf)))


MEDIAN_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("merge_median", "SELECT l_orderkey AS item_id, " + ", ".join(
    f"round(median({f}), 6) AS {f}_median" for f in MEDIAN_FIELDS) + " FROM lineitem GROUP BY l_orderkey")
def _median(spark, sf):
    li = Tables(spark, sf).lineitem.withColumnRenamed("l_orderkey", "item_id")
    return merge.merge_median(li, MEDIAN_FIELDS)


MAJ_SQL = """
pv AS (SELECT item_id, {c} AS v, count(*) AS cnt, min(chunk_no) AS f FROM V_chunks GROUP BY 1, 2),
m_{c} AS (SELECT item_id, v AS {c} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cnt DESC, f)
          AS rn FROM pv) x WHERE rn = 1)"""


@register("merge_majority", with_views("""
WITH pv AS (SELECT item_id, l_returnflag AS v, count(*) AS cnt, min(chunk_no) AS f FROM V_chunks GROUP BY 1, 2),
lab AS (SELECT item_id, v AS l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cnt DESC, f)
        AS rn FROM pv) x WHERE rn = 1),
pv2 AS (SELECT item_id, l_linestatus AS v, count(*) AS cnt, min(chunk_no) AS f FROM V_chunks GROUP BY 1, 2),
st AS (SELECT item_id, v AS l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cnt DESC, f)
       AS rn FROM pv2) x WHERE rn = 1),
sc AS (SELECT item_id, max(l_discount) AS l_returnflag_score FROM V_chunks GROUP BY 1)
SELECT lab.item_id, lab.l_returnflag, sc.l_returnflag_score, st.l_linestatus
FROM lab JOIN sc USING (item_id) JOIN st USING (item_id)""", "V_chunks"))
def _majority(spark, sf):
    c = lineitem_chunks(Tables(spark, sf))
    m = merge.merge_majority(c, label="l_returnflag", score="l_discount")
    return m.join(merge.majority(c, "l_linestatus"), "item_id").select(
        "item_id", "l_returnflag", "l_returnflag_score", "l_linestatus")


@register("merge_keywords", """
WITH c AS (SELECT l_orderkey AS item_id, unnest(['rf_' || l_returnflag, 'ls_' || l_linestatus,
             's' || CAST(l_suppkey % 20 AS VARCHAR)]) AS kw FROM lineitem)
SELECT item_id, string_agg(DISTINCT kw, ',' ORDER BY kw) AS keywords, CAST(count(DISTINCT kw) AS BIGINT) AS n_keywords
FROM c GROUP BY item_id""")
def _keywords(spark, sf):
    li = Tables(spark, sf).lineitem
    c = li.select(F.col("l_orderkey").alias("item_id"), F.array(
        F.concat(F.lit("rf_"), "l_returnflag"), F.concat(F.lit("ls_"), "l_linestatus"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"))).alias("keywords"))
    m = merge.merge_keywords(c)
    return m.select("item_id", F.array_join("keywords", ",").alias("keywords"),
                    F.size("keywords").cast("long").alias("n_keywords"))


EMB_SQL = """
WITH ex AS (SELECT label AS item_id, vec_id AS chunk_no, CAST(unnest(embedding) AS DOUBLE) AS v,
                   generate_subscripts(embedding, 1) AS pos FROM embeddings),
med AS (SELECT item_id, pos, median(v) AS m FROM ex GROUP BY 1, 2),
d AS (SELECT ex.item_id, ex.chunk_no, sqrt(sum((ex.v - med.m) * (ex.v - med.m))) AS dist
      FROM ex JOIN med ON ex.item_id = med.item_id AND ex.pos = med.pos GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, chunk_no) AS rn FROM d)
SELECT item_id, chunk_no, round(dist, 6) AS distance FROM best WHERE rn = 1"""


@register("merge_embedding", EMB_SQL)
def _embedding(spark, sf):
    e = Tables(spark, sf).embeddings.select(F.col("label").alias("item_id"), F.col("vec_id").alias("chunk_no"),
                                            "embedding")
    m = merge.merge_embedding(e)
    return m.select("item_id", "chunk_no", F.round("distance", 6).alias("distance"))


@register("merge_first", with_views("""
SELECT item_id, l_partkey, l_suppkey, l_shipdate FROM V_chunks WHERE chunk_no = 1""", "V_chunks"))
def _first(spark, sf):
    return merge.merge_first(lineitem_chunks(Tables(spark, sf)), ["l_partkey", "l_suppkey", "l_shipdate"])


#: Every numeric family of an analysis, with the figure that its test value is made from.
FAMILIES = ["language_score", "sentiment", *GENDERS, *TEXT_TYPES, *EMOTIONS, *IRONY, *AGES]


def _figure(i: int) -> str:
    """A number of three digits from a line's integers, in either SQL."""
    return f"CAST((l_partkey * {i + 3} + l_suppkey * 7 + chunk_no * {i + 11}) % 997 AS DOUBLE) / 1000"


MERGE_SQL = f"""
WITH c AS (SELECT item_id, chunk_no, l_returnflag AS label, l_extendedprice AS score, l_linestatus AS source_type,
  {", ".join(f"{_figure(i)} AS {f}" for i, f in enumerate(FAMILIES) if f != "sentiment")},
  CASE WHEN item_id % 37 = 0 AND chunk_no = 2 THEN NULL ELSE {_figure(1)} END AS sentiment,
  ['rf_' || l_returnflag, 's' || (l_suppkey % 20)] AS kws,
  [{_figure(1)}, {_figure(5)}, {_figure(8)}] || CASE WHEN item_id % 41 = 0 AND chunk_no = 3 THEN [0.5::DOUBLE] ELSE []::DOUBLE[] END AS emb,
  'https://x.com/' || item_id || '/' || chunk_no AS url, 'm' || l_partkey AS author FROM V_chunks),
ok AS (SELECT item_id FROM c GROUP BY 1 HAVING count(*) = 1 OR (count(sentiment) = count(*) AND min(len(emb)) = max(len(emb)))),
d AS (SELECT c.* FROM c JOIN ok USING (item_id)),
lab AS (SELECT item_id, label FROM (SELECT item_id, label, count(*) AS n, min(chunk_no) AS f FROM d GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1),
st AS (SELECT item_id, source_type FROM (SELECT item_id, source_type, count(*) AS n, min(chunk_no) AS f FROM d GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1),
agg AS (SELECT item_id, count(*) AS n_chunks, max(score) AS label_score,
  {", ".join(f"round(median({f}), 6) AS {f}_median" for f in FAMILIES)},
  arg_min(url, chunk_no) AS url, arg_min(author, chunk_no) AS author, array_to_string(list_sort(list_distinct(flatten(list(kws)))), ',') AS kws
  FROM d GROUP BY 1),
ex AS (SELECT item_id, chunk_no, unnest(emb) AS v, generate_subscripts(emb, 1) AS place FROM d),
med AS (SELECT item_id, place, median(v) AS m FROM ex GROUP BY 1, 2),
dist AS (SELECT ex.item_id, ex.chunk_no, sqrt(sum((v - m) * (v - m) ORDER BY ex.place)) AS x FROM ex
  JOIN med ON ex.item_id = med.item_id AND ex.place = med.place GROUP BY 1, 2),
near AS (SELECT item_id, chunk_no FROM dist QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY x, chunk_no) = 1),
vec AS (SELECT d.item_id, array_to_string(list_transform(emb, lambda e: CAST(CAST(round(e * 1000) AS INTEGER) AS VARCHAR)), ',') AS emb
  FROM d JOIN near USING (item_id, chunk_no))
SELECT agg.*, lab.label, st.source_type, vec.emb FROM agg JOIN lab USING (item_id) JOIN st USING (item_id) JOIN vec USING (item_id)"""


@register("merge_chunks", with_views(MERGE_SQL, "V_chunks"))
def _merge_chunks(spark, sf):
    c = lineitem_chunks(Tables(spark, sf))
    k, n = F.col("item_id"), F.col("chunk_no")
    figures = [F.expr(_figure(i)).alias(f) for i, f in enumerate(FAMILIES) if f != "sentiment"]
    vector = F.concat(F.array(*[F.expr(_figure(i)) for i in (1, 5, 8)]),
                      F.when((k % 41 == 0) & (n == 3), F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>")))
    chunks = c.select(
        "item_id", "chunk_no", F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("score"),
        F.col("l_linestatus").alias("source_type"), *figures,
        F.when((k % 37 == 0) & (n == 2), F.lit(None)).otherwise(F.expr(_figure(1))).alias("sentiment"),
        F.array(F.concat(F.lit("rf_"), "l_returnflag"), F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"))).alias("kws"),
        vector.alias("emb"), F.concat_ws("/", F.lit("https://x.com"), k.cast("string"), n.cast("string")).alias("url"),
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("author"))
    m = merge.merge_chunks(chunks, median_cols=FAMILIES, first_cols=["url", "author"], keywords="kws", embedding="emb")
    return m.withColumn("kws", F.array_join("kws", ",")).withColumn("emb", F.array_join(F.transform(
        "emb", lambda e: F.round(e * 1000).cast("int").cast("string")), ","))
