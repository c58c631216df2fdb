"""Language identification by hierarchical discrimination.

A text is first given a language family, then a language of that family.  Both levels
are one-versus-one linear support vector machines over hashed byte trigrams and bigrams
of the whole lower-cased text.  The machines are fitted on a bounded sample of labelled
rows; scoring is a vectorised function over Arrow batches, with no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches

UNKNOWN = "und"
BITS = 13
DIM = 1 << BITS
ROWS = 128  # texts whose dense features are held at a time
#: Labelled rows that a fit uses, all languages together; each is taken by the hash of its id, so their number is about this.
MAX_TRAIN_ROWS = 800
#: Parts of the hash by which rows are taken.
PARTS = 1_000_000
#: Words of the short excerpt that a fit takes of each text besides the whole.
EXCERPT = 6
#: Families of closely related languages; a language not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
}
_BLANK = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed n-gram counts."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    keys = np.concatenate([three, two + np.uint32(0x55000000)]) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(keys >> np.uint32(32 - BITS), minlength=DIM).astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 120) -> np.ndarray:
    """Weights (last one: bias) of a balanced squared-hinge linear SVM, y in {-1, 1}."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, c / max(1, (y > 0).sum()), c / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-9)
    rate, w = 1.0 / (1.0 + 2.0 * top), np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    for _ in range(steps):  # accelerated gradient
        miss = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * (x.T @ (weight * y * miss)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (last - 1) / t * (new - w)
    return w


@dataclass
class Level:
    """One-versus-one machines between ``names``."""
    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # a column for each pair

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Level:
        names = sorted(set(labels))
        pairs = list(combinations(range(len(names)), 2))
        cols = []
        for i, j in pairs:
            on = np.isin(labels, [names[i], names[j]])
            cols.append(fit_svm(x[on], np.where(labels[on] == names[i], 1, -1).astype(np.float32)))
        return cls(names, pairs, np.stack(cols, 1) if cols else None)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner (votes, then margins) and its weakest margin as a probability."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        votes, weakest = np.zeros((len(x), len(self.names))), np.full((len(x), len(self.names)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margin[:, k]
            for side, v in ((i, m), (j, -m)):
                votes[:, side] += (v > 0) + 0.1 * np.tanh(v) / len(self.names)
                weakest[:, side] = np.minimum(weakest[:, side], v)
        won = votes.argmax(1)
        return won, 1 / (1 + np.exp(-2.5 * weakest[np.arange(len(x)), won]))


@dataclass
class Model:
    families: Level
    members: dict[str, Level]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = np.stack([features(t) for t in texts])
        fam, score = self.families.predict(x)
        out = [UNKNOWN] * len(texts)
        for k, name in enumerate(self.families.names):
            at = np.flatnonzero(fam == k)
            if len(at):
                won, p = self.members[name].predict(x[at])
                score[at] = score[at] * p
                for i, w in zip(at, won):
                    out[i] = self.members[name].names[w]
        return out, score


def family_of(lang: str, families: dict = FAMILIES) -> str:
    return next((f for f, langs in families.items() if lang in langs), lang)


def _excerpt(text: str) -> str:
    words = text.split()
    k = len(words) // 2
    return " ".join(words[k: k + EXCERPT])


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        max_rows: int = MAX_TRAIN_ROWS, families: dict = FAMILIES) -> Model | None:
    """Fit on about ``max_rows`` rows of ``labelled`` (text and lang not null), spread evenly
    over the languages and chosen by a hash of the id; None if there are none.  A language gets the
    share of its rows that makes up its part of ``max_rows``, so nothing is ranked; of an id given
    more than once in a language the smallest text is taken.  Only features, no texts, come to the driver.
    """
    bound_batches(labelled.sparkSession)
    d = labelled.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # a row per language: their number is small beside max_rows
    sizes = {r["lang"]: r["n"] for r in d.filter("id is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    quota = max(1, max_rows // len(sizes))
    parts = F.create_map(*map(F.lit, chain.from_iterable((lang, min(PARTS, math.ceil(PARTS * quota / n))) for lang, n in sizes.items())))
    chosen = d.filter(F.pmod(F.xxhash64("id"), F.lit(PARTS)) < F.try_element_at(parts, F.col("lang")))

    def sparse(batches):
        for pdf in batches:
            out = []
            for t, l in zip(pdf["text"], pdf["lang"]):
                for piece in {t, _excerpt(t)}:
                    v = features(piece)
                    at = np.flatnonzero(v).astype(np.uint16)
                    out.append((l, at.tobytes(), v[at].astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "v"])

    rows = (chosen.groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
            .mapInPandas(sparse, "lang string, at binary, v binary").collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["v"])))
    x, labels = np.zeros((len(rows), DIM), np.float32), np.array([r["lang"] for r in rows], object)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float32)
    fams = np.array([family_of(l, families) for l in labels], object)
    top = Level.fit(x, fams)
    return Model(top, {f: Level.fit(x[fams == f], labels[fams == f]) for f in top.names})


def predict(model: Model | None):
    """Column function: text -> struct<lang_pred, score>.

    ``und`` and score 0 for null, for a text without a letter, and without a model.
    """
    @pandas_udf("lang_pred string, score double")
    def identify(s: pd.Series) -> pd.DataFrame:
        lang, score = [UNKNOWN] * len(s), np.zeros(len(s))
        texts = [x or "" for x in s]
        known = [i for i, x in enumerate(texts) if model is not None and any(map(str.isalpha, x))]
        for k in range(0, len(known), ROWS):
            at = known[k:k + ROWS]
            got, p = model.predict([texts[i] for i in at])
            score[at] = p
            for i, g in zip(at, got):
                lang[i] = g
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return lambda c: identify(F.col(c) if not isinstance(c, Column) else c)
