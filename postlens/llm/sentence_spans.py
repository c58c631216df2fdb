"""Substring deduplication by sliding sentence spans.

A text is cut into sentences.  From every sentence the shortest run of sentences with
MIN_WORDS words is taken forwards, and to every sentence backwards, so that a repeated
passage is covered to both its ends; a run is mostly several sentences, a long sentence
alone may be one.  Run hashes (128 bits) are joined globally: of each run's places the
first (by document, then position) stays, and the sentences of every other place go.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from .common import bound_batches, replace_columns, row_key

MIN_WORDS = 20
#: A sentence ends at . ! or ? before white space, or at a newline.
_END = re.compile(r"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of each sentence; a sentence owns the white space that follows it."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def runs(counts: list[int], least: int) -> set[tuple[int, int]]:
    """Shortest runs [i, j] with ``least`` words, from each sentence on and up to each sentence."""
    out, n = set(), len(counts)
    j, total = 0, 0
    for i in range(n):  # forwards
        while j < n and total < least:
            total += counts[j]
            j += 1
        if total < least:
            break
        out.add((i, j - 1))
        total -= counts[i]
    i, total = n - 1, 0
    for j in range(n - 1, -1, -1):  # backwards
        while i >= 0 and total < least:
            total += counts[i]
            i -= 1
        if total < least:
            break
        out.add((i + 1, j))
        total -= counts[j]
    return out


def _span_batches(least: int):
    def run(batches):
        for pdf in batches:
            doc, key, h1, h2, first, last = [], [], [], [], [], []
            for d, k, text in zip(pdf["doc_id"], pdf["_key"], pdf["text"]):
                words = [text[a:b].lower().split() for a, b in sentences(text)]
                marks = [xxhash.xxh128_digest(" ".join(w)) for w in words]
                for i, j in runs([len(w) for w in words], least):
                    # runs that start or end with wordless sentences are the same run
                    v = xxhash.xxh128_intdigest(b"".join(m for m, w in zip(marks[i:j + 1], words[i:j + 1]) if w))
                    h1.append((v >> 64) - (1 << 63))
                    h2.append((v & (1 << 64) - 1) - (1 << 63))
                    doc.append(d)
                    key.append(k)
                    first.append(i)
                    last.append(j)
                if len(h1) > 50_000:
                    yield _frame(doc, key, h1, h2, first, last)
                    doc, key, h1, h2, first, last = [], [], [], [], [], []
            yield _frame(doc, key, h1, h2, first, last)
    return run


def _frame(doc, key, h1, h2, first, last):
    return pd.DataFrame({"h1": pd.array(h1, "int64"), "h2": pd.array(h2, "int64"), "doc_id": pd.array(doc, "Int64"),
                         "_key": pd.array(key, "int64"), "i": pd.array(first, "int32"), "j": pd.array(last, "int32")})


def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    total, removed, kept = [], [], []
    for t, s in zip(text, spans):
        cuts = sentences(t) if t else []
        gone = set()
        for x in s if s is not None else ():
            gone.update(range(x["i"], x["j"] + 1))
        total.append(len(cuts))
        removed.append(len(gone))
        kept.append(t if not gone else "".join(t[a:b] for k, (a, b) in enumerate(cuts) if k not in gone))
    return pd.DataFrame({"n_sentences": total, "n_removed": removed, "text": kept})


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences taken out of ``text``, and n_sentences and n_removed.

    Case and white space don't count in comparisons.  The first place of a run is the one
    with the smallest doc_id (null last), then a hash of the row, then position; a run may
    also repeat inside one text.  Defined cases: null text stays null (0 sentences); a text
    of fewer than ``min_words`` words stays as it is; rows equal in doc_id and text are one
    document and stay equal; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(f"`{doc_id}`", f"`{text}`").alias("_key"),
                       F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    spans = base.mapInPandas(_span_batches(min_words), "h1 long, h2 long, doc_id long, _key long, i int, j int")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "i")
    # one row of a repeated run per task goes into the shuffle; minimum and maximum differ if it has two places
    first = (spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter("first != last").select("h1", "h2", "first"))
    later = spans.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    lists = (later.select("doc_id", "_key", "i", "j").groupBy("doc_id", "_key")
             .agg(F.collect_set(F.struct("i", "j")).alias("_pl_spans"))  # bounded by the sentences of one document
             .select(F.col("doc_id").alias("_pl_doc"), F.col("_key").alias("_pl_key"), "_pl_spans"))
    key = row_key(f"`{doc_id}`", f"`{text}`")
    joined = docs.withColumn("_pl_own", key).join(
        lists, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_pl_doc")) & (F.col("_pl_own") == F.col("_pl_key")), "left")
    cut = pandas_udf(_cut, "n_sentences int, n_removed int, text string", PandasUDFType.SCALAR)
    made = joined.withColumn("_pl_cut", cut(F.col(f"`{text}`"), F.col("_pl_spans")))
    return made.select(replace_columns(docs, {text: F.col("_pl_cut.text"), "n_sentences": F.col("_pl_cut.n_sentences"),
                                              "n_removed": F.col("_pl_cut.n_removed")}))
