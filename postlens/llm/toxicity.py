"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of lexicon terms (a given list and terms learnt from labelled rows:
words and word beginnings), their nearness to second-person words, their densest stretch,
and rates of capitals, punctuation and obfuscated spelling, all over the whole text.  Trees
and calibration are Spark ML's, fitted on a bounded sample of the labelled rows: lexicons
are cross-fitted by folds and the calibration has rows of its own, so none judges its own rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches

#: Most labelled documents that a fit uses.
MAX_TRAIN_ROWS = 8_000
#: Parts of the sample, each described by a lexicon learnt from the others.
FOLDS = 3
#: Most terms that a fit learns, and the least log-odds of one.
MAX_TERMS, MIN_LOG_ODDS = 600, 2.5
#: Given lexicon (insults, English); weights as of learnt terms.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
              "dumb", "imbecile", "filthy", "vermin", "garbage", "hate", "shut", "jerk", "freak", "coward")
SEED_WEIGHT = 3.0
SECOND_PERSON = frozenset("you your yours youre yourself u ya du dich dir dein deine ihr euch tu te toi ton ta tes vous "
                          "votre vos usted ustedes tus vosotros".split())
NEAR, STRETCH = 4, 25  # words to a second-person word; words of the densest stretch
_TOKEN = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?<![\w@$*])[^\W\d_]+(?:[@$*!0134575]+[^\W\d_]+)+(?![\w@$*])")
_LEET = str.maketrans({"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "3": "e", "7": "t"})
N_FEATURES = 13


def term_weight(word: str, lexicon: dict[str, float]) -> float:
    """Weight of a word: its own, or that of its beginning (marked by a final ^)."""
    w = lexicon.get(word)
    if w is None:
        w = lexicon.get(word[:5] + "^") if len(word) > 5 else None
        if w is None and len(word) > 4:
            w = lexicon.get(word[:4] + "^")
    return w or 0.0


def features(text: str, lexicon: dict[str, float], seen: dict[str, float]) -> list[float]:
    """Dense features of one text; ``seen`` remembers weights of words within a batch."""
    low = text.lower()
    words = _TOKEN.findall(low)
    n = len(words)
    hits = []
    for i, w in enumerate(words):
        v = seen.get(w)
        if v is None:
            v = seen[w] = term_weight(w, lexicon)
        if v:
            hits.append((i, v))
    odd = [m.group(0) for m in _ODD.finditer(low)]
    masked = sum(term_weight(o.translate(_LEET).replace("*", ""), lexicon) > 0 for o in odd)
    near = sum(any(x in SECOND_PERSON for x in words[max(0, i - NEAR): i + NEAR + 1]) for i, _ in hits)
    dense, lo = 0.0, 0
    total = 0.0
    for i, v in hits:
        total += v
        while i - hits[lo][0] >= STRETCH:
            total -= hits[lo][1]
            lo += 1
        dense = max(dense, total)
    chars = max(1, len(text))
    strong = sum(v >= 4 for _, v in hits)
    return [len(hits) / max(1, n), sum(v for _, v in hits) / max(1, n), math.log1p(len(hits)), math.log1p(strong),
            math.log1p(len({words[i] for i, _ in hits})), dense, max((v for _, v in hits), default=0.0),
            near / max(1, len(hits)), sum(map(str.isupper, text)) / chars if len(text) < 1000 else _upper(text) / chars,
            text.count("!") / chars, (chars - low.count(" ") - sum(map(len, words))) / chars,
            (len(odd) + masked) / max(1, n), math.log1p(n)]


def _upper(text: str) -> int:
    """Characters that lower-casing changes, without a call per character."""
    low = text.lower()
    return sum(a != b for a, b in zip(text, low)) if len(low) == len(text) else sum(map(str.isupper, text))


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None
    base: float = 0.0  # the score if there is nothing to learn


def _features_of(lexicon: dict[str, float]):
    @pandas_udf("array<double>")
    def dense(s: pd.Series) -> pd.Series:
        seen: dict[str, float] = {}
        out = []
        for x in s:
            if len(seen) > 200_000:
                seen.clear()
            out.append(features(x or "", lexicon, seen))
        return pd.Series(out)

    return dense


def _terms(rows: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Words and beginnings that speak for label 1, by log-odds of document frequencies."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) > 2))
    begin = [F.transform(F.filter("w", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("^"))) for k in (4, 5)]
    df = (rows.select("y", words.alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", *begin))).alias("term"))
          .groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")))
    odds = F.log((F.col("p") + 0.5) / (n_pos + 1)) - F.log((F.col("q") + 0.5) / (n_neg + 1))
    # at most MAX_TERMS rows come to the driver; a term must be more frequent in label 1 than chance repeats
    top = (df.filter(F.col("p") >= max(3, n_pos // 100)).select("term", odds.alias("s"), "p")
           .filter(F.col("s") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("s") * F.log1p("p")), "term").limit(MAX_TERMS).collect())
    return {r["term"]: float(r["s"]) for r in top}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents (spread by a hash of the id).

    ``labels`` holds the rows that may be learnt from.  A doc_id labelled more than once
    counts as toxic if any of its labels does, and of its texts the smallest is learnt from; null
    ids and labels are left out.  Without
    rows of both labels the model is the constant share of label 1 (0 without rows).
    """
    y = (labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
         .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    n = y.count()
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(100))
    if n > max_rows:
        y = y.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # about max_rows ids, so the sample may be sent to every executor
    rows = (docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
            .join(F.broadcast(y), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
            .select("id", "y", "text", part.alias("part")).repartition(6, "id").checkpoint())
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return Model(base=float(next(iter(count), 0)))
    def learn(some: DataFrame) -> dict[str, float]:
        seen = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {t: SEED_WEIGHT for t in SEED_TERMS} | _terms(some, seen.get(1, 0), seen.get(0, 0))

    # a row's features come from a lexicon learnt without its fold, as those of new texts do
    tables = []
    for k in range(FOLDS):
        own = F.col("part") % FOLDS == k
        tables.append(rows.filter(own).select("y", "part", array_to_vector(_features_of(learn(rows.filter(~own)))("text")).alias("x")))
    table = reduce(DataFrame.unionByName, tables).coalesce(4).checkpoint()
    lexicon = learn(rows)
    grow, hold = table.filter("part < 70"), table.filter("part >= 70")
    ys = {(r["held"], r["y"]) for r in table.select((F.col("part") >= 70).alias("held"), "y").distinct().collect()}
    if not {(False, 0), (False, 1)} <= ys:
        grow = table
        if len({v for _, v in ys}) < 2:
            return Model(lexicon, base=count[1] / sum(count.values()))
    if not {(True, 0), (True, 1)} <= ys:
        hold = table
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxMemoryInMB=64).fit(grow)
    held = trees.transform(hold).select(vector_to_array("probability")[1].alias("p"), F.col("y").cast("double").alias("y"))
    curve = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="iso").fit(held)
    return Model(lexicon, trees, curve)


#: Share of the uncalibrated probability in a score: it orders texts that the isotonic steps tie.
RAW_SHARE = 0.02


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1); null and empty texts are scored like a text without words."""
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(model.base).alias("score"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_pl_row"),
                      array_to_vector(_features_of(model.lexicon)(F.col(f"`{text}`"))).alias("x"))
    probable = model.trees.transform(row).select("_pl_row", vector_to_array("probability")[1].alias("p"))
    mixed = (1 - RAW_SHARE) * F.col("iso") + RAW_SHARE * F.col("p")
    return model.curve.transform(probable).select("_pl_row.*", F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)).alias("score"))
