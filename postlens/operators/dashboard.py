"""Tables shown by the dashboard (§2.9): keyword spread, intents, ages,
previews and version checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60 * 1_000_000
# Relative-age units (month = 30 days, as in the reference).
AGE_UNITS = [("minute", MINUTE_US), ("hour", 60 * MINUTE_US), ("day", 24 * 60 * MINUTE_US),
             ("week", 7 * 24 * 60 * MINUTE_US), ("month", 30 * 24 * 60 * MINUTE_US)]


def keyword_spread(df: DataFrame, module: str, keyword: str) -> DataFrame:
    """Per module and keyword: count and percent of the module's total (2 dp,
    half-up, computed in integers so every engine rounds alike).  The total is
    a window over the aggregated ``(module, keyword)`` table, not the events."""
    g = df.where(F.col(keyword).isNotNull()).groupBy(module, keyword).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(module))
    pct = F.floor((F.col("n") * 20000 + total) / (total * 2)) / 100.0
    return g.withColumn("pct", pct.cast("double"))


def relative_age(df: DataFrame, ts: str, as_of: Column, out: str = "age") -> DataFrame:
    """'Just now', 'n minute(s) ago', ... 'n month(s) ago' (month = 30 days)."""
    diff = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))

    def label(unit: str, size: int) -> Column:
        n = F.floor(diff / F.lit(size)).cast("long")
        return F.concat(n.cast("string"), F.lit(" " + unit), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    expr = F.when(diff < MINUTE_US, F.lit("Just now"))
    for (unit, size), (_, nxt) in zip(AGE_UNITS[:-1], AGE_UNITS[1:]):
        expr = expr.when(diff < nxt, label(unit, size))
    expr = expr.otherwise(label(*AGE_UNITS[-1]))
    return df.withColumn(out, expr)


def middle_ellipsis(c: str | Column, n: int) -> Column:
    """Shorten to ``n`` characters by replacing the middle with '...'."""
    c = F.col(c) if isinstance(c, str) else c
    left, right = (n - 3) // 2, (n - 3) - (n - 3) // 2
    ln = F.length(c)
    return F.when(ln <= n, c).otherwise(F.concat(F.substring(c, 1, left), F.lit("..."),
                                                 F.substring(c, ln - right + 1, right)))


def prefix_ellipsis(c: str | Column, n: int) -> Column:
    """First ``n`` characters plus '...' when longer."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def version_array(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.split(F.regexp_replace(c, "^v", ""), "\\."), lambda x: x.try_cast("int"))


def outdated_versions(df: DataFrame, installed: str = "installed", latest: str = "latest") -> DataFrame:
    """Three-part numeric version compare, optional 'v' prefix; null if a part of either
    version is not a number (``1.2.3rc1``), so that such rows can be reported."""
    a, b = version_array(installed), version_array(latest)
    known = F.forall(F.concat(a, b), lambda x: x.isNotNull())
    return df.withColumn("outdated", F.when(known, a < b))


def intent_summary(events: DataFrame, intent: list[str], ts: str, kind: str, is_error: Column,
                   order_key: str) -> DataFrame:
    """Per intent: start, module (kind of its first event), collections, errors,
    and the gap in seconds since the previous intent of the same collector
    (``order_key``).  The gap window runs over the aggregated intents, whose
    count per collector is bounded by its days of activity."""
    g = events.groupBy(*intent).agg(
        F.min(ts).alias("start"), F.min_by(kind, F.struct(F.col(ts), F.col(kind))).alias("module"),
        F.count_if(~is_error).alias("collections"), F.count_if(is_error).alias("errors"))
    w = Window.partitionBy(order_key).orderBy("start")
    prev = F.lag("start").over(w)
    gap = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))) / 1e6
    return g.withColumn("gap_seconds", gap)
