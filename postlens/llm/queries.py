"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bisector, chat_format, decontam, langid, line_dedup, merkle, mixing, order_minhash, pii, quality_rules, sentence_spans,
               simhash_groups, toxicity)
from .common import crc_mod, read
from .registry import register

W = r"'[^\x20\x09-\x0D]+'"

@register("op1_language_id")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~held))
    return (docs.select("doc_id", held.alias("held_out"), langid.predict(model)("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, {W})), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k
      FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
r AS (SELECT *, z * 3.0::DOUBLE / w AS r FROM w),
c AS (SELECT *, (sum(z) OVER ())::DOUBLE - coalesce(sum(z * 3.0::DOUBLE) OVER q, 0) AS lft,
             sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS wl
      FROM r WINDOW q AS (ORDER BY r, w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT lft / wl AS level FROM c WHERE lft / wl <= r ORDER BY r, level LIMIT 1),
t AS (SELECT source, z, least(z * 3.0::DOUBLE, w * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM c),
e AS (SELECT d.doc_id, d.size, t.z AS source_size, t.target,
             CASE WHEN t.z > 0 THEN least(t.target / t.z, 3.0) ELSE 0 END AS rate,
             CAST('0x' || substr(md5(concat_ws(':', '0', coalesce(CAST(d.doc_id AS VARCHAR), 'null'),
                  md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""


@register("op2_mixing", MIX_SQL)
def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op3_decontamination")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_items(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct("hits.item_id")).alias("items"), "hits")


@register("op4_quality_rules")
def op4(spark, sf_dir):
    return quality_rules.quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_sentence_spans")
def op5(spark, sf_dir):
    return sentence_spans.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("has_repeats"), "text")


@register("op6_simhash_groups")
def op6(spark, sf_dir):
    return simhash_groups.groups(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", simhash_groups.hex_digits().alias("fingerprint"), "component_id")


@register("op7_toxicity")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op8_line_dedup")
def op8(spark, sf_dir):
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "text")


@register("op9_pii")
def op9(spark, sf_dir):
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="postlens").select(
        "doc_id", "text", "pii", F.size("pii").cast("long").alias("n_replaced"))


@register("op10_chat_format")
def op10(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat_format.format_conversations(convs.unionByName(probe))
    read_back = out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"),
                           chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("said"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@register("op11_order_minhash")
def op11(spark, sf_dir):
    return order_minhash.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


def _cluster_sql(k=16, rounds=3):
    """Squared distances to all centroids, three rounds and a last assignment."""
    out = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
           f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS no, x AS c FROM v
  QUALIFY no < {k})"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, x, no AS cluster, dist FROM (
  SELECT rid, vec_id, x, no, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v CROSS JOIN c{i})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, no) = 1)""")
        if i < rounds:
            out.append(f"""m{i} AS (SELECT cluster, place, sum(CAST(e AS HUGEINT)) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY cluster, place),
l{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT no, coalesce(l.c, o.c) AS c FROM c{i} o LEFT JOIN l{i} l ON o.no = l.cluster)""")
    out.append(f"""d AS (SELECT no, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds})""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN d ON d.no = cluster"""


@register("op12_bisector_clusters", _cluster_sql())
def op12(spark, sf_dir):
    return bisector.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def _field(c):
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS leaf,
         sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed,
         xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                 lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END,
             CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
             count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS lev, k, n, leaf AS h FROM r
  UNION ALL
  SELECT source, lev + 1, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1
  GROUP BY source, lev, k // 16),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (SELECT 0 AS lev, k, n, subroot AS h FROM sub
  UNION ALL
  SELECT lev + 1, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM over_ WHERE n > 1 GROUP BY lev, k // 16),
side AS (SELECT a.source, a.lev, a.k, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS lft,
                coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS rgt
         FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lev = b.lev AND a.k // 16 = b.k // 16
         WHERE a.n > 1 GROUP BY 1, 2, 3),
side2 AS (SELECT a.lev, a.k, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS lft,
                 coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS rgt
          FROM over_ a JOIN over_ b ON a.lev = b.lev AND a.k // 16 = b.k // 16 WHERE a.n > 1 GROUP BY 1, 2),
steps AS (
  SELECT r.source, r.k AS rk, s.lev, s.lft, s.rgt FROM r JOIN side s
    ON r.source IS NOT DISTINCT FROM s.source AND s.k = r.k // CAST(pow(16, s.lev) AS BIGINT)
  UNION ALL
  SELECT r.source, r.k, 1000 + s.lev, s.lft, s.rgt FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source
    JOIN side2 s ON s.k = sub.k // CAST(pow(16, s.lev) AS BIGINT)),
p AS (SELECT source, rk, string_agg(lft || rgt, '' ORDER BY lev) AS proof,
             list([lft, rgt] ORDER BY lev) AS path FROM steps GROUP BY 1, 2),
o AS (SELECT r.doc_id, r.leaf, sub.subroot, (SELECT h FROM over_ WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
             list_reduce(coalesce(p.path, []), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''],
                         [CASE WHEN r.crc % 5 = 0 THEN r.changed ELSE r.leaf END, ''])[1] AS folded_root
      FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source
      LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.k = p.rk)
SELECT *, folded_root = root AS verified FROM o
"""


@register("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = merkle.sha(merkle.canonical(*fields, "text"))
    changed = merkle.sha(merkle.canonical(*fields, merkle.lower_ascii(F.col("text"))))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(crc_mod("doc_id", 5) == 0, changed).otherwise(leaf).alias("found"))
    made = merkle.manifest(rows, F.col("leaf"), "source", ["doc_id"])
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                       merkle.fold(F.col("found"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
