"""Item projection, validation and collection filters (§2.1).

All of these are narrow (map-side) expressions except the dedup and report
rules, which aggregate on the URL / batch key with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators.stats import window_bounds
from postlens.sources.schema import BATCH_KINDS, ISO_PATTERN, ITEM_REQUIRED, URL_PATTERN


def pages_to_items(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Raw HTML pages -> items: visible text as content, title, domain, language."""
    return pages.select(
        "*", T.url_host(url).alias("domain"), T.html_title(html).alias("title"),
        T.strip_html(html).alias("content"), T.html_lang(html).alias("language")).drop(html)


def validate_items(items: DataFrame, keywords: str | None = "top_keywords", kind: str | None = "kind",
                   numeric: Sequence[str] = ()) -> DataFrame:
    """Add ``violations array<string>``: every failed rule of the batch schema.

    Rules: required item fields present; ``created_at``/``collected_at`` match
    the timestamp pattern; ``url``/``picture`` match the URL pattern; ``kind``
    in the enum; keywords unique; required numeric fields present.
    """
    cols = set(items.columns)
    checks: list[Column] = []
    for f in ITEM_REQUIRED:
        if f in cols:
            checks.append(F.when(F.col(f).isNull(), F.lit(f"missing:{f}")))
        else:
            checks.append(F.lit(f"missing:{f}"))
    for f in ("created_at", "collected_at"):
        if f in cols:
            checks.append(F.when(F.col(f).isNotNull() & ~F.col(f).rlike(ISO_PATTERN), F.lit(f"pattern:{f}")))
    for f in ("url", "picture"):
        if f in cols:
            checks.append(F.when(F.col(f).isNotNull() & ~F.col(f).rlike(URL_PATTERN), F.lit(f"pattern:{f}")))
    if kind and kind in cols:
        checks.append(F.when(~F.col(kind).isin(BATCH_KINDS) | F.col(kind).isNull(), F.lit("enum:kind")))
    if keywords and keywords in cols:
        checks.append(F.when(F.size(F.array_distinct(keywords)) != F.size(keywords), F.lit("unique:top_keywords")))
    for f in numeric:
        checks.append(F.when(F.col(f).isNull(), F.lit(f"missing:{f}")))
    return items.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def quarantine_items(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected) on ``violations``."""
    ok = F.size("violations") == 0
    return validated.where(ok), validated.where(~ok)


def rejection_report(validated: DataFrame) -> DataFrame:
    """Counts per reason, plus ``valid``: one aggregate over an exploded reason list."""
    reasons = F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(F.col("violations"))
    return validated.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def usable_text(content: str = "content", title: str = "title") -> Column:
    return F.coalesce(F.nullif(F.col(content), F.lit("")), F.nullif(F.col(title), F.lit("")))


def require_content(items: DataFrame, content: str = "content", title: str = "title") -> DataFrame:
    """Keep items that have a non-empty content or title."""
    return items.where(usable_text(content, title).isNotNull())


OPTIONAL_ITEM = ["title", "summary", "picture", "author", "external_id", "external_parent_id", "username",
                 "userprofile_url"]


def project_item(df: DataFrame) -> DataFrame:
    """Protocol item struct: required fields as is, optional ones only when truthy
    (empty text -> null), ids as text."""
    fields = []
    for f in ["raw_content", "translated_content", "created_at", "domain", "url", "language"]:
        fields.append((F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f))
    for f in OPTIONAL_ITEM:
        if f in df.columns:
            fields.append(F.nullif(F.col(f).cast("string"), F.lit("")).alias(f))
        else:
            fields.append(F.lit(None).cast("string").alias(f))
    return df.withColumn("item", F.struct(*fields))


def hash_author(df: DataFrame, col: str = "author") -> DataFrame:
    """Author stored as the SHA-1 hex digest of its UTF-8 name."""
    return df.withColumn(col, T.sha1_text(col))


def freshness_filter(df: DataFrame, ts: str, max_age_seconds: int, as_of=None) -> DataFrame:
    """Drop posts older than ``max_age_seconds`` before the collection time ``as_of`` (the
    newest post by default).  The bound is a literal or one scalar subquery, so the
    comparison reaches the parquet reader."""
    lo, _ = window_bounds(df, ts, as_of, max_age_seconds / 3600.0)
    return df.where(F.col(ts) >= lo)


def min_length_filter(df: DataFrame, content: str, n: int) -> DataFrame:
    return df.where(F.length(content) >= n)


def cap_per_query(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """At most ``n`` rows per key, earliest first.  ``row_number() <= n`` lets
    Catalyst insert a partial group limit before the shuffle, so a hot key
    sends at most ``n`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_query", F.row_number().over(w)).where(F.col("rank_in_query") <= n)


def url_domain_check(df: DataFrame, url: str, domain: Column) -> DataFrame:
    """The URL's host must contain the declared domain marker."""
    return df.withColumn("domain_ok", F.coalesce(F.contains(T.url_host(url), domain), F.lit(False)))


def dedup_url(df: DataFrame, url: str = "url", order: Sequence[str] = ("minute_no", "item_id")) -> DataFrame:
    """Keep the earliest row per URL and report how many copies were dropped.
    ``min_by`` is a partial aggregate: a hot URL is combined map-side."""
    keep = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    g = df.groupBy(url).agg(keep.alias("_k"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return g.select(*[F.col("_k")[c].alias(c) for c in df.columns], "duplicates")


def submission_report(df: DataFrame, batch: str = "batch_id", url: str = "url",
                      order: Sequence[str] = ("minute_no", "item_id")) -> DataFrame:
    """Per batch: submitted, accepted, rejected (URL pattern; a null URL too) and duplicates
    (a URL already seen earlier in any batch).  Rows are summed per batch and URL first, so
    that a hot URL has a row per batch in the join."""
    bad = ~F.coalesce(F.col(url).rlike(URL_PATTERN), F.lit(False))
    each = df.groupBy(F.col(batch).alias("_b"), F.col(url).alias("_u"), bad.alias("_bad")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[F.col(c) for c in order])).alias("_f"))
    first = each.where("not _bad").groupBy(F.col("_u").alias("_fu")).agg(F.min("_f").alias("_first"))
    j = each.join(first, F.col("_u") == F.col("_fu"), "left")  # a null URL is bad and has no first
    new = (~F.col("_bad") & (F.col("_f") == F.col("_first"))).cast("long")
    n = F.col("_n")
    return j.groupBy(F.col("_b").alias(batch)).agg(
        F.sum(n).alias("submitted"), F.sum(F.coalesce(new, F.lit(0))).alias("accepted"),
        F.sum(F.when(F.col("_bad"), n).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("_bad"), 0).otherwise(n - F.coalesce(new, F.lit(0)))).alias("duplicates"))


def parse_keyword_list(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Comma text -> one row per keyword: newlines removed, stripped, literal
    ``\\uXXXX`` escapes removed, empty entries dropped."""
    parts = F.split(F.replace(F.col(text), F.lit("\n"), F.lit("")), ",")
    x = df.select(*keep, F.explode(parts).alias("keyword"))
    x = x.withColumn("keyword", F.regexp_replace(F.replace(T.py_strip("keyword"), F.lit("\r"), F.lit("")),
                                                 r"\\u[0-9a-fA-F]{4}", ""))
    return x.where(F.col("keyword") != "")
