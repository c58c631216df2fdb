"""Prefix scans, exact selection, and rows with null keys, null times and repeated ids."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.functions.ordering import running
from postlens.functions.selection import exact_median
from postlens.operators import batching, merge, quality, statelog, stats

T0 = dt.datetime(2024, 5, 1)
ROWS = [("x", 1, 10, "a", 5), ("x", 2, None, "a", 7), ("x", 3, 12, "b", None), (None, 4, 11, "a", 1), (None, 5, 11, "a", 1), (None, 6, None, "c", 2),
        (None, 7, 30, "b", 3), ("y", 8, 10, None, 4), ("y", 9, 40, None, 4), ("y", 9, 40, None, 4)]


def _df(spark):
    return spark.createDataFrame([(k, i, None if t is None else T0 + dt.timedelta(seconds=t), v, n) for k, i, t, v, n in ROWS],
                                 "k string, id long, ts timestamp, v string, n long")


def _keyed():
    out = {}
    for r in sorted(ROWS, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_every_row_comes_back_with_its_gap(spark):
    got = sorted(((r.k, r.id, r.gap_seconds) for r in batching.inter_arrival(_df(spark), "k", "ts", "id").collect()), key=str)
    want = [(k, r[1], None if p is None or p[2] is None or r[2] is None else float(r[2] - p[2])) for k, mine in _keyed().items() for p, r in zip([None, *mine], mine)]
    assert got == sorted(want, key=str)


def test_running_tokens_of_null_keys(spark):
    got = sorted(((r.k, r.id, r.chunks_so_far, r.tokens_so_far) for r in batching.running_tokens(_df(spark), ["k"], "ts", "id", "n").collect()), key=str)
    want = [(k, r[1], i + 1, sum(x[4] or 0 for x in mine[: i + 1])) for k, mine in _keyed().items() for i, r in enumerate(mine)]
    assert got == sorted(want, key=str)


def test_change_events_of_null_keys(spark):
    got = sorted(((r.k, r.id, r.v, r.prev_v) for r in statelog.change_events(_df(spark), "k", "ts", "id", "v").collect()), key=str)
    want = [(k, r[1], r[3], p and p[3]) for k, mine in _keyed().items() for p, r in zip([None, *mine], mine) if p is None or p[3] != r[3]]
    assert got == sorted(want, key=str)


def test_one_key_in_one_second_spreads_over_tasks(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.lit(T0).alias("ts"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = running(df, ["k"], ["ts", "id"])
        assert r.where("rank <> id + 1").count() == 0 and r.count() == 40_000
        ranged = df.repartitionByRange("k", "ts", "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranged) > 4 and max(x["count"] for x in ranged) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trailing_count_of_null_keys_and_repeated_ids(spark):
    rows = [(None, 1, 0), (None, 2, 300), ("x", 3, 0), ("x", 3, 0), ("x", 4, 3600), ("x", 5, 3601), ("x", 6, None)]
    df = spark.createDataFrame([(k, i, None if t is None else T0 + dt.timedelta(seconds=t)) for k, i, t in rows], "event_type string, event_id long, ts timestamp")
    got = sorted((r.event_id, r.n) for r in stats.trailing_count_per_row(df, period_hours=1).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (3, 2), (4, 3), (5, 2), (6, 0)]


def test_submission_report_with_null_urls(spark):
    rows = [(1, None, 1, 1), (1, None, 1, 2), (1, "https://x.com/a", 1, 3), (2, "https://x.com/a", 2, 4), (2, "https://x.com/a", 2, 5), (2, "nope", 2, 6)]
    df = spark.createDataFrame(rows, "batch_id long, url string, minute_no long, item_id long")
    got = {r.batch_id: (r.submitted, r.accepted, r.rejected, r.duplicates) for r in quality.submission_report(df).collect()}
    assert got == {1: (3, 1, 2, 0), 2: (3, 0, 1, 2)}


@pytest.mark.parametrize("seed", range(2))
def test_exact_median_without_a_buffer(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in ((None, 501), ("even", 500), ("few", 3), ("ties", 400), ("huge", 301), ("none", 2)):
        v = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n) if k == "huge" else rng.integers(-3, 4, n) / 8.0 if k == "ties" else rng.normal(size=n)
        rows += [(k, None if k == "none" else float(x)) for x in v] + [(k, None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v", limit=50).collect()}
    for k in got:
        mine = [v for q, v in rows if q == k and v is not None]
        assert (got[k] is None and not mine) or math.isclose(got[k], statistics.median(mine), rel_tol=1e-15), k
    assert len(got) == 6


def test_merge_of_a_hot_item_equals_that_of_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i % 3 if i % 7 else 0, i, [float(x) for x in rng.normal(size=4)], float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, chunk_no long, embedding array<double>, score double")
    plain = sorted(map(str, merge.merge_embedding(df).collect())), sorted(map(str, merge.merge_median(df, ["score"]).collect()))
    monkeypatch.setattr(merge, "LIMIT", 20)
    monkeypatch.setattr(exact_median, "__defaults__", ("median", 20))
    assert (sorted(map(str, merge.merge_embedding(df).collect())), sorted(map(str, merge.merge_median(df, ["score"]).collect()))) == plain
