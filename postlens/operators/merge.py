"""Merging chunk results into one record per item.

Input is a chunk table ``(item_id, chunk_no, ...)``; output one row per item.
Every rule is an aggregate on ``item_id`` (one shuffle, partial aggregation
map-side) or a two-level aggregate.  Semantics kept from the reference:

* majority label: most frequent, tie -> the first seen (smallest ``chunk_no``),
  not ``mode()`` which may return any of the tied values;
* classification score: max over **all** chunks;
* numeric fields: exact median (mean of the two middle values);
* keywords: set union;
* embedding: the chunk vector nearest (L2) to the component-wise median,
  tie -> first chunk;
* item metadata: the first chunk's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.selection import LIMIT, exact_median

MEDIAN_DP = 6  # medians are interpolated; rounded so engines agree to the last bit


def group_chunks(chunks: DataFrame, item: str = "item_id", chunk: str = "chunk_no") -> DataFrame:
    """Per item: number of chunks and the first/last chunk numbers."""
    return chunks.groupBy(item).agg(F.count(F.lit(1)).alias("n_chunks"), F.min(chunk).alias("first_chunk"),
                                    F.max(chunk).alias("last_chunk"))


def median_col(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.median(c.cast("double")), MEDIAN_DP)


def merge_median(chunks: DataFrame, fields: Sequence[str], item: str = "item_id") -> DataFrame:
    """Exact median of every numeric field per item.  Items of more chunks than one buffer should
    hold are narrowed down by counts (:func:`exact_median`)."""
    if not _has_large(chunks, item):
        return chunks.groupBy(item).agg(*[median_col(f).alias(f"{f}_median") for f in fields])
    out = chunks.groupBy(F.col(item).alias("_item")).agg(F.count(F.lit(1)))
    for i, f in enumerate(fields):
        m = exact_median(chunks, [item], f, f"{f}_median").withColumnRenamed(item, f"_i{i}")
        out = out.join(m, F.col("_item").eqNullSafe(F.col(f"_i{i}")), "left")
    return out.select(F.col("_item").alias(item), *[F.round(f"{f}_median", MEDIAN_DP).alias(f"{f}_median") for f in fields])


def _has_large(chunks: DataFrame, item: str) -> bool:
    return not chunks.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIMIT).isEmpty()


def majority(chunks: DataFrame, col: str, item: str = "item_id", chunk: str = "chunk_no",
             out: str | None = None) -> DataFrame:
    """Most common value per item; a tie goes to the value seen first.

    Two-level aggregate: ``(item, value) -> (count, first chunk)``, then
    ``max_by(value, (count, -first))`` per item.  Both levels combine map-side,
    so a hot item never sends its rows to one task.
    """
    out = out or col
    per_val = chunks.groupBy(item, col).agg(F.count(F.lit(1)).alias("_cnt"), F.min(chunk).alias("_first"))
    return per_val.groupBy(item).agg(
        F.max_by(F.col(col), F.struct(F.col("_cnt"), -F.col("_first"))).alias(out))


def merge_majority(chunks: DataFrame, label: str = "label", score: str = "score",
                   item: str = "item_id", chunk: str = "chunk_no") -> DataFrame:
    """Majority label with the max score over all chunks (not only the winner's)."""
    lab = majority(chunks, label, item, chunk)
    sc = chunks.groupBy(item).agg(F.max(score).alias(f"{label}_score"))
    return lab.join(sc, item)


def merge_keywords(chunks: DataFrame, keywords: str = "keywords", item: str = "item_id") -> DataFrame:
    """Union of the chunks' keyword arrays, distinct and sorted."""
    kw = chunks.select(item, F.explode(keywords).alias("_kw")).distinct()
    return kw.groupBy(item).agg(F.sort_array(F.collect_list("_kw")).alias(keywords))


def merge_embedding(chunks: DataFrame, embedding: str = "embedding", item: str = "item_id",
                    chunk: str = "chunk_no") -> DataFrame:
    """The chunk vector nearest (L2) to the component-wise median of the item's vectors.

    Medians are per ``(item, position)`` groups (exploded vectors); the median
    vector of an item is rebuilt in position order (bounded by the dimension)
    and joined back to the item's chunks; the distance is computed with
    ``zip_with``/``aggregate`` inside codegen.
    """
    ex = chunks.select(item, F.posexplode(embedding).alias("_pos", "_v"))
    med = exact_median(ex, [item, "_pos"], "_v", "_m")
    centroid = med.groupBy(item).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("_centroid"))
    j = chunks.select(item, chunk, embedding).join(centroid, item)
    sq = F.aggregate(F.zip_with(F.col(embedding), F.col("_centroid"),
                                lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                     F.lit(0.0), lambda acc, x: acc + x)
    j = j.withColumn("_dist", F.sqrt(sq))
    best = j.groupBy(item).agg(F.min_by(F.struct(F.col(chunk), F.col(embedding), F.col("_dist")),
                                        F.struct(F.col("_dist"), F.col(chunk))).alias("_b"))
    return best.select(item, F.col("_b")[chunk].alias(chunk), F.col("_b")[embedding].alias(embedding),
                       F.col("_b._dist").alias("distance"))


def merge_first(chunks: DataFrame, cols: Sequence[str], item: str = "item_id", chunk: str = "chunk_no") -> DataFrame:
    """Item metadata taken from the first chunk."""
    b = chunks.groupBy(item).agg(F.min_by(F.struct(*cols), F.col(chunk)).alias("_f"))
    return b.select(item, *[F.col("_f")[c].alias(c) for c in cols])


def _bound(value: Column, body) -> Column:
    """``body(value)``, the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _middle(values: Column, dp: int | None = MEDIAN_DP) -> Column:
    """The median of an array; nulls don't count."""
    middle = _bound(F.array_sort(F.filter(values, lambda v: v.isNotNull())), lambda a: (
        F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)
    return middle if dp is None else F.round(middle, dp)


def _most(rows: str, field: str) -> Column:
    """The most common value of a field of a list of structs; of several the one with the first chunk."""
    def vote(v: Column) -> Column:
        chunks = F.transform(F.filter(rows, lambda r: r[field].eqNullSafe(v)), lambda r: r["chunk"])
        return F.struct(F.size(chunks).alias("n"), (-F.array_min(chunks)).alias("first"), v.alias("value"))
    return F.array_max(F.transform(F.array_distinct(F.transform(rows, lambda r: r[field])), vote))["value"]


def _nearest(rows: str) -> Column:
    """Of a list of (chunk, vector) the vector nearest to the component-wise median, the first chunk's if several are."""
    def choose(some: Column) -> Column:
        centre = F.transform(F.sequence(F.lit(0), F.size(F.get(some, 0)["vector"]) - 1),
                             lambda p: _middle(F.transform(some, lambda r: F.get(r["vector"], p).cast("double")), None))

        def nearest(m: Column) -> Column:
            gaps = F.transform(some, lambda r: F.struct(F.sqrt(F.aggregate(F.zip_with(
                r["vector"], m, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)).alias("gap"),
                r["chunk"].alias("chunk"), r["vector"].alias("vector")))
            return F.array_min(gaps)["vector"]
        return _bound(centre, nearest)
    kept = F.filter(rows, lambda r: r["vector"].isNotNull() & (F.size(r["vector"]) > 0))
    return _bound(kept, lambda some: F.when(F.size(some) > 0, choose(some)))


def merge_chunks(chunks: DataFrame, label: str = "label", score: str = "score",
                 majority_cols: Sequence[str] = ("source_type",), median_cols: Sequence[str] = (),
                 first_cols: Sequence[str] = (), keywords: str | None = None, embedding: str | None = None,
                 item: str = "item_id", chunk: str = "chunk_no") -> DataFrame:
    """All merge rules for one chunk table: one aggregate on ``item`` for counts, max score
    and first-chunk fields; figures, majority votes, keywords and embeddings come out of one list
    per item.  If an item has more chunks than a list should hold, they are aggregates of their
    own, joined on ``item`` (each side is already one row per item).

    An item of several chunks fails, and is left out, if a chunk has a null in one of the
    merged families or its vectors differ in length; an item of one chunk stays as it is.
    """
    families = [label, score, *majority_cols, *median_cols, *([keywords] if keywords else []), *([embedding] if embedding else [])]
    voted = [label, *majority_cols]
    gap = F.lit(False)
    for c in families:
        gap = gap | F.col(c).isNull()
    size = F.size(embedding) if embedding else F.lit(0)
    aggs = [F.count(F.lit(1)).alias("n_chunks"), F.max(score).alias(f"{label}_score"),
            (F.bool_or(gap) | (F.min(size) != F.max(size))).alias("_failed")]
    large = _has_large(chunks, item)
    if not large:  # at most LIMIT chunks an item: one list of all that is merged inside the row
        listed = [F.col(chunk).alias("chunk"), F.array(*[F.col(c).cast("double") for c in median_cols]).cast("array<double>").alias("figures"),
                  *[F.col(c).alias(f"m{i}") for i, c in enumerate(voted)], *([F.col(keywords).alias("words")] if keywords else []), *([F.col(embedding).alias("vector")] if embedding else [])]
        # gathered over sorted rows, an item at a time: an aggregate would hold (and spill) the lists of all items of a task
        chunks = chunks.withColumn("_rows", F.collect_list(F.struct(*listed)).over(Window.partitionBy(item)))
        aggs.append(F.first("_rows").alias("_rows"))
    if first_cols:
        aggs.append(F.min_by(F.struct(*first_cols), F.col(chunk)).alias("_first"))
    out = chunks.groupBy(item).agg(*aggs).where((F.col("n_chunks") == 1) | ~F.col("_failed")).drop("_failed")
    if not large:
        medians = F.transform(F.array(*[F.lit(i) for i in range(len(median_cols))]).cast("array<int>"),
                              lambda p: _middle(F.transform("_rows", lambda r: F.get(r["figures"], p))))
        out = out.withColumn("_medians", medians)
        out = out.select(*[c for c in out.columns if c not in ("_rows", "_medians")], *[
            F.get("_medians", F.lit(i)).alias(f"{c}_median") for i, c in enumerate(median_cols)],
            *[_most("_rows", f"m{i}").alias(c) for i, c in enumerate(voted)],
            *([F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("_rows", lambda r: r["words"]), lambda w: w.isNotNull()))))
               .alias(keywords)] if keywords else []),
            *([_nearest("_rows").alias(embedding)] if embedding else []))
    elif median_cols:
        out = out.join(merge_median(chunks, median_cols, item), item)
    if first_cols:
        out = out.select("*", *[F.col("_first")[c].alias(c) for c in first_cols]).drop("_first")
    for c in voted if large else []:
        out = out.join(majority(chunks, c, item, chunk), item)
    if keywords and large:
        out = out.join(merge_keywords(chunks, keywords, item), item, "left")
    if embedding and large:
        # vectors of unequal length belong to items that have failed
        e = merge_embedding(chunks.where(F.col(embedding).isNotNull()), embedding, item, chunk).select(item, embedding)
        out = out.join(e, item, "left")
    return out
