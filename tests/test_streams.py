"""Stream folds in order of event time against the sequential rules, over shuffled and late rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.streaming import ordered, streams

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "k string, id long, ts timestamp_ntz, v string, tokens long"


def _at(seconds):
    return T0 + dt.timedelta(seconds=float(seconds))


def _feed(spark, path, files, far=10 ** 7):
    """One file after another, then a row of no key that moves the watermark past all."""
    for rows in [*files, [("~", -9, _at(far), None, 0)]]:
        spark.createDataFrame([(k, i, t if isinstance(t, dt.datetime) or t is None else _at(t), v, n) for k, i, t, v, n in rows], SCHEMA).coalesce(1) \
            .write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)


def _mixed(seed, n=400, delay=600):
    """Rows of four keys (one null), dealt over five files that overlap by less than the delay."""
    rng = np.random.default_rng(seed)
    rows = [([None, "a", "b", "c"][rng.integers(4)], i, float(rng.integers(1, 20_000)), "xyz"[rng.integers(3)], int(rng.integers(0, 60))) for i in range(n)]
    files = [[] for _ in range(5)]
    for r in rows:
        files[int((r[2] + rng.random() * delay * 0.99) // ((20_000 + delay) / 5))].append(r)
    return rows, [[f[i] for i in rng.permutation(len(f))] for f in files]


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def _batches(rows, size, most, gap):
    out, no, n, s, last = [], 0, 0, 0, None
    for _, i, t, _, tok in rows:
        wide = last is not None and t - last > gap
        last, n, s = t, n + 1, s + tok
        why = "early" if wide and n >= 5 else "tokens" if s > most else "full" if n >= size else None
        out.append((i, no, n, s, why))
        if why:
            no, n, s = no + 1, 0, 0
    return out


@pytest.mark.parametrize("seed", range(2))
def test_folds_match_the_sequential_rules(spark, tmp_path, seed):
    rows, files = _mixed(seed)
    late = [("a", 9001, 5.0, "x", 1), (None, 9002, 7.0, "y", 1), ("new", 9003, 9.0, "y", 1), ("a", 9004, None, "y", 1)]
    path = str(tmp_path / "in")
    stream = _feed(spark, path, [*files, late])
    kept = streams.run_available(streams.throttle_stream(stream, "k", "ts", "id", 0.5, "600 seconds"), name="throttle").collect()
    want = set()
    for k, mine in _by_key(rows).items():
        last = None
        for r in mine:
            if last is None or r[2] - last >= 1800:
                last = r[2]
                want.add((k, r[1]))
    assert {(r.key, r.row_id) for r in kept if not r.late and r.key != "~"} == want
    assert {r.row_id for r in kept if r.late} == {9001, 9002, 9003}

    asm = streams.run_available(streams.assemble_batches_stream(stream, "k", "ts", "id", "tokens", 12, 200, 120, delay="600 seconds"), name="asm").collect()
    want = {(k, *b) for k, mine in _by_key(rows).items() for b in _batches(mine, 12, 200, 120)}
    assert {(r.feed, r.row_id, r.batch_no, r.chunk_in_batch, r.tokens_in_batch, r.close_reason) for r in asm if not r.late and r.feed != "~"} == want
    assert {(r.row_id, r.batch_no) for r in asm if r.late} == {(9001, None), (9002, None), (9003, None)}

    changes = streams.run_available(streams.change_events_stream(stream, "k", "ts", "id", "v", "600 seconds"), name="changes").collect()
    want = {(k, r[1], r[3], p[3] if p else None) for k, mine in _by_key(rows).items() for p, r in zip([None, *mine], mine) if not p or p[3] != r[3]}
    assert {(r.key, r.row_id, r.value, r.previous) for r in changes if not r.late and r.key != "~"} == want


def test_batch_fold_in_any_cut(spark):
    """The fold's memory carries a batch over any cut of the rows."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 3000, 300)) * 1_000_000
    rows = [(int(x), i, int(rng.integers(0, 50))) for i, x in enumerate(t)]
    want = _batches([(None, i, x / 1e6, None, tok) for x, i, tok in rows], 7, 90, 20)
    fold = ordered.batch_fold(7, 90, 20e6, 5)
    for cuts in ([], [1], [3, 4, 5, 100, 299], list(range(1, 300))):
        memory, got = None, []
        for lo, hi in zip([0, *cuts], [*cuts, 300]):
            memory, out = fold(memory, t[lo:hi], rows[lo:hi])
            got += out
        assert got == want


def test_throttle_forgets_keys_that_are_over(spark, tmp_path):
    """Memory goes once no row can come that it holds back; a later row of the key starts anew, a late one stays late."""
    files = [[("a", 1, 10, "x", 0), ("a", 2, 20, "x", 0)], [("b", 3, 50_000, "x", 0)], [("b", 4, 50_001, "x", 0), ("a", 5, 15, "x", 0)], [("a", 6, 60_000, "x", 0)]]
    out = streams.run_available(streams.throttle_stream(_feed(spark, str(tmp_path / "in"), files), "k", "ts", "id", 1, "1 minute"), name="ttl").collect()
    assert {r.row_id for r in out if not r.late} - {-9} == {1, 3, 6} and {r.row_id for r in out if r.late} == {5}


def test_sliding_counts_over_panes(spark, tmp_path):
    rows, files = _mixed(3)
    late = [("a", 9001, 5.0, "x", 1)]
    stream = _feed(spark, str(tmp_path / "in"), [*files, late])
    got = streams.run_available(streams.sliding_count_stream(stream, "k", "60 minutes", "10 minutes", "600 seconds"), name="slide")
    got = {(r.k, r.window.start, r.n) for r in got.where("k is null or k <> '~'").collect()}
    df = spark.createDataFrame([(k, i, _at(t)) for k, i, t, *_ in rows], "k string, id long, ts timestamp_ntz")
    want = df.groupBy(F.window(F.col("ts").cast("timestamp"), "60 minutes", "10 minutes"), "k").count()
    assert got == {(r.k, r.window.start, r["count"]) for r in want.collect()}
    plan = stream.transform(lambda s: streams.sliding_count_stream(s, "k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate [") == 2


def test_folds_run_under_a_session_with_another_state_store(spark, tmp_path):
    """A session that others have built has Spark's own store, which can't hold list and value state side by side."""
    rows, files = _mixed(4, n=60)
    stream = _feed(spark, str(tmp_path / "in"), files)
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(streams.STATE_STORE)
    spark.conf.set(streams.STATE_STORE, other)
    try:
        out = streams.run_available(streams.change_events_stream(stream, "k", "ts", "id", "v", "600 seconds"), name="other").collect()
        assert spark.conf.get(streams.STATE_STORE) == other
    finally:
        spark.conf.set(streams.STATE_STORE, before)
    want = {(k, r[1]) for k, mine in _by_key(rows).items() for p, r in zip([None, *mine], mine) if not p or p[3] != r[3]}
    assert {(r.key, r.row_id) for r in out if not r.late and r.key != "~"} == want
