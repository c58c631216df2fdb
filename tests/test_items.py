"""Merged and assembled items, and rules compiled from the schema, on hand-made rows."""

import statistics

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators import merge
from postlens.operators import scoring as S
from postlens.plans.q_rules import BROKEN, MISSING
from postlens.sources import rules


def test_no_item_vanishes(spark):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d")], "item_id long, chunk_no long, url string")
    scores = spark.createDataFrame([(1, 1, "x"), (3, 1, "y"), (None, 1, "z")], "item_id long, chunk_no long, label string")
    kws = spark.createDataFrame([(1, 1, ["k"]), (9, 9, ["q"])], "item_id long, chunk_no long, top_keywords array<string>")
    p = S.assemble_processed(items, scores, kws)
    got = sorted(((r.item_id, r.chunk_no, r.status, r.item and r.item.url, r.analysis and r.analysis.label, r.analysis and r.analysis.top_keywords)
                  for r in p.collect()), key=str)
    assert got == sorted([(1, 1, "complete", "a", "x", ["k"]), (1, 2, "no_score", "b", None, None), (2, 1, "no_score", "c", None, None),
                          (3, 1, "no_item", None, "y", None), (None, 1, "complete", "d", "z", None)], key=str)
    assert {r.status: r.n for r in S.assembly_report(p).collect()} == {"complete": 2, "no_score": 2, "no_item": 1}


def test_failed_merges_go_and_single_chunks_stay(spark, monkeypatch):
    rows = [(1, 1, "a", 1.0, "s", 0.1, ["x"], [0.0, 0.0]), (1, 2, "b", 3.0, "s", 0.3, ["y", "x"], [1.0, 1.0]), (1, 3, "b", 2.0, "n", 0.2, [], [0.9, 1.0]),
            (2, 1, "a", 1.0, "s", None, ["x"], [0.0, 0.0]), (2, 2, "a", 1.0, "s", 0.5, ["x"], [0.0, 0.0]),
            (3, 1, "a", 1.0, "s", 0.5, ["x"], [0.0, 0.0]), (3, 2, "a", 1.0, "s", 0.5, ["x"], [0.0]),
            (4, 1, None, None, None, None, None, None), (5, 1, "c", 1.0, "n", 0.7, ["w"], [])]
    df = spark.createDataFrame(rows, "item_id long, chunk_no long, label string, score double, source_type string, v double, kw array<string>, emb array<double>")

    def merged():
        m = merge.merge_chunks(df, median_cols=["v"], first_cols=["chunk_no"], keywords="kw", embedding="emb")
        return {r.item_id: (r.n_chunks, r.label, r.label_score, r.source_type, r.v_median, r.emb and list(r.emb)) for r in m.collect()}, \
               {r.item_id: r.kw for r in m.collect()}
    got, kw = merged()
    assert got[1] == (3, "b", 3.0, "s", 0.2, [0.9, 1.0]) and kw[1] == ["x", "y"]
    assert set(got) == {1, 4, 5} and got[4][:2] == (1, None) and got[5][4] == 0.7
    monkeypatch.setattr(merge, "LIMIT", 1)  # the way of large items
    again, _ = merged()
    assert {k: v[:5] for k, v in again.items()} == {k: v[:5] for k, v in got.items()} and again[1] == got[1]


def test_nearest_vector_in_a_row_matches_the_joined_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 9, i, "l", 1.0, "s", [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "item_id long, chunk_no long, label string, score double, source_type string, embedding array<double>")
    joined = {r.item_id: list(r.embedding) for r in merge.merge_embedding(df).collect()}
    assert {r.item_id: list(r.embedding) for r in merge.merge_chunks(df, embedding="embedding").collect()} == joined
    for k, v in joined.items():
        mine = [r[5] for r in rows if r[0] == k]
        centre = [statistics.median(c) for c in zip(*mine)]
        best = min(mine, key=lambda x: sum((a - b) ** 2 for a, b in zip(x, centre)))
        assert v == best


def test_rules_follow_the_schema_and_only_where_the_object_is_there(spark):
    assert len(MISSING) == 63 and len(BROKEN) == 8
    kind = T.StructType([T.StructField("a", T.StructType([T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])),
                         T.StructField("s", T.StringType())])
    tree = {"required": ["a", "gone"], "properties": {"a": {"required": ["n"], "properties": {"tags": {"unique": True, "items": {"pattern": "^[a-z]+$"}}}},
                                                      "s": {"enum": ["x", "y"]}}}
    rows = [((1, ["a", "b"]), "x"), (None, "y"), ((None, ["a", "a"]), "z"), ((2, ["A", None]), None)]
    got = [r.violations for r in rules.with_violations(spark.createDataFrame(rows, kind), tree).collect()]
    assert got == [["missing:gone"], ["missing:a", "missing:gone"], ["enum:s", "missing:a.n", "missing:gone", "unique:a.tags"],
                   ["missing:gone", "null:a.tags[]", "pattern:a.tags[]"]]


def test_merge_gathers_lists_without_a_second_shuffle(spark, tmp_path):
    """Chunks numbered by a window over the item are merged where they are: one shuffle, no list aggregate over hashes."""
    from postlens.tables import Tables
    from postlens.views import lineitem_chunks

    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(o, n, 1, 2, float(n), None, 1.0, "AB"[n % 2], "X") for o in (1, 2, None) for n in range(3)], cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = lineitem_chunks(Tables(spark, str(tmp_path))).select("item_id", "chunk_no", F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("source_type"))
    out = merge.merge_chunks(c, median_cols=["score"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan
    assert {(r.item_id, r.n_chunks, r.score_median, r.label) for r in out.collect()} == {(1, 3, 1.0, "A"), (2, 3, 1.0, "A"), (None, 3, 1.0, "A")}
