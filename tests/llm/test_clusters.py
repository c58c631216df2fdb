"""Bisector tournament against brute force over all centroids, and its SQL."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import bisector as B
from postlens.llm.common import read
from postlens.llm.queries import op12
from postlens.llm.registry import ORACLES

from .conftest import SF


def _brute(rows, k=16, rounds=3, dim=64):
    """rows: (vec_id, vector) -> (vec_id, cluster, distance, cluster inertia, inertia, digest) per kept row."""
    v = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows
         if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    by = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(x) for _, x in sorted(v, key=by)[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents] for _, x in v]
        return [(min(range(len(cents)), key=lambda j: (row[j], j)), min(row)) for row in d]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [x for (_, x), (c, _) in zip(v, got) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    inertia = {}
    for c, d in got:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(v, got)), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_query_matches_brute_force_and_sql(spark, con):
    rows = [tuple(r) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    want = _brute(rows)
    df = op12(spark, SF)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _rows(df) == want
    con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted((tuple(r) for r in con.sql(ORACLES["op12_bisector_clusters"]).fetchall()), key=str) == want


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_repeated_vectors(spark, seed):
    """Few values, so that many vectors lie on a bisector and many centroids are equal."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (60, 64)) * (rng.random((60, 64)) < 0.05) / 64.0
    rows = [(int(i) if i % 11 else None, [float(e) for e in x[i % 40]]) for i in range(60)]
    got = B.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    assert _rows(got) == _brute(rows)


def test_cases(spark):
    schema = "vec_id long, embedding array<double>"
    assert B.cluster(spark.createDataFrame([], schema)).collect() == []
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [1.0] * 63 + [None]), (6, [float("nan")] * 64), (7, [float("-inf")] + [0.0] * 63)]
    assert B.cluster(spark.createDataFrame(bad, schema)).collect() == []
    few = bad + [(8, [0.5] * 64), (8, [0.5] * 64), (9, [-0.01] * 64), (None, [100000.7] * 64)]
    df = spark.createDataFrame(few, schema).withColumn("cluster", F.lit("mine")).withColumn("x", F.lit("kept")).withColumn("id", F.lit(3))
    out = B.cluster(df)
    assert out.columns.count("cluster") == 1 and {r["x"] for r in out.collect()} == {"kept"}
    assert _rows(out) == _brute(few)
    with pytest.raises(Exception, match="fit a long"):
        B.cluster(spark.createDataFrame([(1, [1e10] * 64)], schema)).collect()


def test_tests_at_the_bound_are_exact():
    m = B.MOST
    x = np.array([[m] * 64, [-m] * 64, [m - 1] * 64, [0] * 64], np.int64)
    c = np.array([[-m] * 64, [m] * 64], np.int64)
    best, distance = B.nearest(x, c)
    assert best.tolist() == [1, 0, 1, 0] and distance.tolist() == [0, 0, 64, 64 * m * m]
