"""Batch documents ``{"items": [...], "kind": ...}`` as files.

Reading uses the fixed schema (no inference) and keeps malformed documents in
``_corrupt_record``; writing groups one batch per document.  A batch holds at
most a few hundred items (the batch size limit), so collecting one batch into
one document is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.sources.schema import BATCH, PROCESSED

MAX_BATCH_ITEMS = 30000 // 150  # the batch token cap over the fallback per-chunk estimate (200)


def read_batches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per item: ``batch_file, kind, item_no, item, analysis, ...``.

    ``multi_line=False`` reads one document per line (what ``write_batches``
    writes, splittable); ``True`` reads one (pretty-printed) document per file.
    Malformed documents are kept as rows with ``_corrupt_record`` set and no item.
    """
    raw = (spark.read.schema(BATCH).option("multiLine", multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .withColumn("batch_file", F.input_file_name()))
    good = raw.where(F.col("_corrupt_record").isNull()).select(
        "batch_file", "kind", F.posexplode("items").alias("item_no", "p")).select(
        "batch_file", "kind", "item_no", "p.*")
    bad = raw.where(F.col("_corrupt_record").isNotNull()).select("batch_file", "kind", "_corrupt_record")
    return good.unionByName(bad, allowMissingColumns=True)


def write_batches(items: DataFrame, path: str, batch_col: str = "batch_id", kind: str = "SPOTTING",
                  mode: str = "overwrite") -> None:
    """Write one JSON document per batch (one text line each)."""
    batch_documents(items, batch_col, kind).select("value").write.mode(mode).text(path)


def batch_documents(items: DataFrame, batch_col: str = "batch_id", kind: str = "SPOTTING",
                    max_items: int = MAX_BATCH_ITEMS) -> DataFrame:
    """Batches as JSON text rows ``(batch_id, n_items, value)`` (what ``write_batches`` writes).

    A batch of more than ``max_items`` items is an error, found by a count (combined
    before its shuffle) before any batch is collected into a document."""
    large = items.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_items).head(1)
    if large:
        raise ValueError(f"batch {large[0][0]} holds {large[0]['n']} items, more than {max_items}")
    cols = [f.name for f in PROCESSED.fields if f.name in items.columns]
    order = F.col("item_no") if "item_no" in items.columns else F.lit(0)
    docs = items.groupBy(batch_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.struct(*cols).alias("p")))),
                    lambda s: s["p"]).alias("items"))
    return docs.select(batch_col, F.size("items").alias("n_items"),
                       F.to_json(F.struct("items", F.lit(kind).alias("kind"))).alias("value"))
