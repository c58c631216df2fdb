"""Centroid clustering by a tournament of bisectors, in exact integers.

For a pair of centroids a, b (a the smaller number) a vector x is strictly nearer to b
exactly if ``2 (b - a) . x > |b|^2 - |a|^2``.  Normals and thresholds of all pairs are
computed once per round; a vector starts with centroid 0 and meets the others in turn, and
each meeting is the sign of one linear form: positive, the challenger stays, else (zero
too) the smaller number.  k - 1 signs leave the nearest centroid, and only its distance is
computed.

Tasks read the vectors in Arrow batches and add up each batch by cluster; Spark adds up the
sums.  The driver holds the centroids alone: k vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep_columns

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Components may be this large (as integers): every test and squared distance of 64 of them fits a long.
MOST = 1 << 27
_ROWS = 4_096  # vectors in one numpy step


def kept(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right number of components, none null, NaN or infinite."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & fine, F.lit(False))


def integers(v: Column, scale: int = SCALE) -> Column:
    """Components as integers, floor(scale * x) with x as a double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of all pairs: [a, b] is positive where b is strictly nearer than a."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the number of the nearest centroid and the squared distance to it."""
    normals, thresholds = bisectors(centroids)
    best = np.zeros(len(x), np.int64)
    for b in range(1, len(centroids)):
        side = np.einsum("ij,ij->i", normals[best, b], x) - thresholds[best, b]
        best[side > 0] = b
    gap = x - centroids[best]
    return best, np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if len(x) and max(int(x.max()), -int(x.min())) > MOST:
        raise ValueError(f"a component beyond {MOST} in size: squared distances may not fit a long")
    return x


def _steps(batches, dimensions: int):
    """(batch, vectors of some of its rows, where these begin)."""
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index("x")), dimensions)
        for lo in range(0, len(x), _ROWS):
            yield batch.slice(lo, _ROWS), x[lo:lo + _ROWS]


def _sums(centroids: np.ndarray):
    k, dimensions = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for _, x in _steps(batches, dimensions):
            best, _ = nearest(x, centroids)
            part = np.zeros((k, dimensions), np.int64)
            np.add.at(part, best, x)
            total += part  # Python integers: no sum of a task can overflow
            count += np.bincount(best, minlength=k)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([count[c]], pa.int64()), pa.array([[str(v) for v in total[c]]], pa.list_(pa.string()))],
                names=["cluster", "n", "sums"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for rows, x in _steps(batches, centroids.shape[1]):
            best, distance = nearest(x, centroids)
            rest = [rows.column(i) for i, n in enumerate(rows.schema.names) if n != "x"]
            names = [n for n in rows.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(best, pa.int32()), pa.array(distance, pa.int64())],
                                             names=[*names, "cluster", "distance"])
    return run


def start(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of (id, x) with the smallest sha256 of ``seed:id``, ids that are null last,
    vectors of one id in the order of their components."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(by.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""
    parts = vectors.select("x").mapInArrow(_sums(centroids), "cluster int, n long, sums array<string>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x dimensions rows
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The rows whose vectors are kept, with ``cluster``, ``distance`` (squared, of the integer vectors),
    ``cluster_inertia``, ``inertia`` (sums of it) and ``centroid_sha256``.

    Defined cases: vectors that are null, of another length, or with a null, NaN or infinite
    component go; with fewer than ``k`` vectors each starts a centroid; equal vectors may start
    equal centroids, of which the smaller number takes all and the other stays; a null id
    starts a centroid only after all others; repeated rows count each; an empty table gives no
    rows; an integer component beyond 2^27 in size is an error, as distances would not fit a
    long.  Columns named like the added ones are replaced, others kept.
    """
    bound_batches(rows.sparkSession)
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    good = rows.filter(kept(rows, vector, dimensions))
    x = integers(F.col(f"`{vector}`"), scale).alias("x")
    vectors = good.select(F.col(f"`{id}`").alias("id"), x)
    centroids = start(vectors, k, seed)
    stay = [c for c in rows.columns if c not in added]
    own = good.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(stay)], x)
    schema = ", ".join([*(f"_c{i} {t}" for i, t in enumerate(good.schema[c].dataType.simpleString() for c in stay)), "cluster int", "distance long"])
    if not len(centroids):  # no vector at all
        made = own.drop("x").withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
    else:
        for _ in range(rounds):
            centroids = step(vectors, centroids)
        made = own.mapInArrow(_assign(centroids), schema).checkpoint()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = made.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = F.array(*[F.lit(d) for d in digests]) if digests else F.array().cast("array<string>")
    table = totals.select(F.col("cluster").alias("_no"), "cluster_inertia", F.get(every, F.col("cluster")).alias("centroid_sha256"))
    whole = totals.agg(F.sum("cluster_inertia")).scalar()
    out = made.join(F.broadcast(table), made["cluster"] == table["_no"])  # a row per centroid
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(stay)], "cluster", "distance", "cluster_inertia",
                      whole.alias("inertia"), "centroid_sha256")
