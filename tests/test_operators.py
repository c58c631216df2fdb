"""Hand-made expectations (FIXTURES §4) and trap cases for the operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import batching, dashboard, merge, sampling, statelog, stats


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_trailing_count_boundary_and_cap(spark):
    # an event exactly at as_of - 24h counts; a 48 h period is capped to 24 h
    ev = spark.createDataFrame([("apple", ts("2024-01-01 00:00:00")), ("apple", ts("2024-01-01 23:00:00")),
                                ("apple", ts("2024-01-02 00:00:00")), ("banana", ts("2023-12-31 23:00:00"))],
                               "event_type string, ts timestamp_ntz")
    got = {r.key: r.n for r in stats.trailing_count(ev, as_of="2024-01-02 00:00:00", period_hours=48).collect()}
    assert got == {"apple": 3}
    got1 = {r.key: r.n for r in stats.trailing_count(ev, as_of="2024-01-02 00:00:00", period_hours=1).collect()}
    assert got1 == {"apple": 2}


def test_trailing_count_per_row_matches_brute_force(spark):
    rows = [(i, "k" if i % 3 else "j", ts("2024-01-01 00:00:00") + dt.timedelta(seconds=37 * i * i % 9000))
            for i in range(300)]
    ev = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz")
    got = {r.event_id: r.n for r in stats.trailing_count_per_row(ev, period_hours=1).collect()}
    for i, k, t in rows:
        exp = sum(1 for _, k2, t2 in rows if k2 == k and t - dt.timedelta(hours=1) <= t2 <= t)
        assert got[i] == exp


def test_last_n_is_per_key_min(spark):
    ev = spark.createDataFrame([("a",)] * 40 + [("b",)] * 3, "event_type string")
    got = {r.key: r.n_last for r in stats.last_n_count(ev, 30).collect()}
    assert got == {"a": 30, "b": 3}


def test_weighted_choice_example_only_b_wins(spark):
    layers = spark.createDataFrame(
        [(1, "A", 1, .5), (1, "B", 2, .7), (1, "C", 3, .3), (2, "A", None, 0.), (2, "B", None, .4),
         (2, "C", None, 0.), (3, "A", None, .9), (3, "B", None, .5), (3, "C", None, .1)],
        "layer_no int, key string, ord int, w double")
    w = sampling.combine_weights(layers)
    draws = spark.range(200).select(F.col("id"), (F.col("id") / 200.0).alias("u"))
    got = {r.choice for r in sampling.weighted_draw(draws, "u", w).collect()}
    assert got == {"B"}


def test_weighted_draw_all_zero_first_option(spark):
    w = spark.createDataFrame([("x", 2, 0.0), ("y", 1, 0.0)], "key string, ord int, weight double")
    draws = spark.range(5).select((F.col("id") / 5.0).alias("u"))
    assert {r.choice for r in sampling.weighted_draw(draws, "u", w).collect()} == {"y"}


def test_unknown_weight_key_raises(spark):
    layers = spark.createDataFrame([(1, "A", 1, 1.0), (2, "Z", None, 1.0)], "layer_no int, key string, ord int, w double")
    try:
        sampling.combine_weights(layers).collect()
        raise AssertionError("expected failure")
    except Exception as e:  # noqa: BLE001
        assert "unknown weight key" in str(e)


def test_keyword_draw_fallback_when_empty(spark):
    empty = spark.createDataFrame([], "keyword string, id long")
    draws = spark.range(3).select((F.col("id") / 3.0).alias("u"))
    got = [r.keyword for r in sampling.keyword_draw(draws, "u", empty, F.col("id") % 4).collect()]
    assert set(got) <= set(sampling.FALLBACK_KEYWORDS) and len(got) == 3


def test_merge_majority_tie_first_seen_and_max_score(spark):
    df = spark.createDataFrame([(1, 1, "x", .1), (1, 2, "y", .9), (1, 3, "y", .2), (1, 4, "x", .3)],
                               "item_id long, chunk_no long, label string, score double")
    r = merge.merge_majority(df).collect()[0]
    assert r.label == "x" and r.label_score == .9


def test_merge_embedding_median_and_tie(spark):
    df = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [10.0, 0.0]), (1, 3, [1.0, 1.0])],
                               "item_id long, chunk_no long, embedding array<double>")
    r = merge.merge_embedding(df).collect()[0]
    assert r.chunk_no == 1 and list(r.embedding) == [0.0, 0.0]


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 9.0)], "item_id long, v double")
    assert merge.merge_median(df, ["v"]).collect()[0].v_median == 3.0


def test_fold_state_example(spark):
    ups = ['{"a":{"x":1}}', '{"a":{"y":2}}', '{"a":3}', '{"a":{}}']
    expect = [{"a.x": "1"}, {"a.x": "1", "a.y": "2"}, {"a": "3"}, {"a": "{}"}]
    for n in range(1, 5):
        df = spark.createDataFrame([(1, i, u) for i, u in enumerate(ups[:n])], "key long, seq long, json string")
        got = {r.path: r.value for r in statelog.fold_state(df).collect()}
        assert got == expect[n - 1]


def _direct_fold(updates):
    state = {}

    def merge_into(t, s):
        for k, v in s.items():
            if k in t and isinstance(t[k], dict) and isinstance(v, dict):
                merge_into(t[k], v)
            else:
                t[k] = v if not isinstance(v, dict) else __import__("copy").deepcopy(v)
    for u in updates:
        merge_into(state, u)
    out = {}

    def leaves(d, p):
        for k, v in d.items():
            if isinstance(v, dict) and v:
                leaves(v, p + [k])
            elif isinstance(v, dict):
                out[".".join(p + [k])] = "{}"
            else:
                out[".".join(p + [k])] = str(v)
    leaves(state, [])
    return out


def test_fold_state_random_against_direct_fold(spark):
    import json
    import random
    rnd = random.Random(7)

    def rand_obj(depth):
        d = {}
        for _ in range(rnd.randint(0, 2)):
            k = rnd.choice("abc")
            r = rnd.random()
            d[k] = {} if r < .2 else (rand_obj(depth + 1) if r < .6 and depth < 3 else rnd.randint(0, 9))
        return d
    logs = {key: [rand_obj(0) for _ in range(rnd.randint(1, 6))] for key in range(40)}
    rows = [(k, i, json.dumps(u)) for k, us in logs.items() for i, u in enumerate(us)]
    df = spark.createDataFrame(rows, "key long, seq long, json string")
    got = {}
    for r in statelog.fold_state(df).collect():
        got.setdefault(r.key, {})[r.path] = r.value
    for k, us in logs.items():
        assert got.get(k, {}) == _direct_fold(us), (k, us)


def test_throttle_example(spark):
    base = ts("2024-01-01 00:00:00")
    rows = [(i, "t", base + dt.timedelta(minutes=5 * i)) for i in range(10)]
    rows.append((10, "t", base + dt.timedelta(hours=1, minutes=1)))
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz")
    kept = sorted(r.event_id for r in statelog.throttle(df, "event_type", "ts", "event_id", 1).collect())
    assert kept == [0, 10]


def test_time_grid_has_48_slots(spark):
    starts = spark.createDataFrame([(17,)], "m int")
    g = statelog.time_grid(starts, "m", 30).collect()
    assert len(g) == 48 and g[0].time == "00:17" and g[-1].time == "23:47"


def test_change_events_first_and_changes(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), 1, "a"), (1, ts("2024-01-02 00:00:00"), 2, "a"),
                                (1, ts("2024-01-03 00:00:00"), 3, "b"), (2, ts("2024-01-01 00:00:00"), 4, "a")],
                               "k long, t timestamp_ntz, id long, v string")
    got = sorted(r.id for r in statelog.change_events(df, "k", "t", "id", "v").collect())
    assert got == [1, 3, 4]


def test_relative_age_plural(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:30"),), (ts("2023-12-31 23:58:00"),),
                                (ts("2023-12-31 23:00:00"),), (ts("2023-11-01 00:00:00"),)], "t timestamp_ntz")
    got = [r.age for r in dashboard.relative_age(df, "t", F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")).collect()]
    assert got == ["Just now", "3 minutes ago", "1 hour ago", "2 months ago"]


def test_outdated_versions_numeric(spark):
    df = spark.createDataFrame([("1.9.9", "1.10.0"), ("v1.10.0", "1.10.0"), ("v2.0.0", "1.10.0")],
                               "installed string, latest string")
    assert [r.outdated for r in dashboard.outdated_versions(df).collect()] == [True, False, False]


def test_batches_respect_limits(spark):
    base = ts("2024-01-01 00:00:00")
    rows = [(i, 1, base + dt.timedelta(seconds=10 * i), 1 + i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, tokens long")
    a = batching.assemble_batches(df, "user_id", "ts", "event_id", "tokens", batch_size=8, max_tokens=20)
    per = batching.batch_close_reason(a).collect()
    assert all(r.n_chunks <= 8 for r in per)
    assert sum(r.n_chunks for r in per) == 100


def test_load_all_raises_for_a_missing_module(monkeypatch):
    from postlens.plans import registry
    monkeypatch.setattr(registry, "MODULES", (*registry.MODULES, "q_not_there"))
    with pytest.raises(ModuleNotFoundError):
        registry.load_all()


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from postlens.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_outdated_versions_flags_odd_parts(spark):
    from postlens.operators.dashboard import outdated_versions
    df = spark.createDataFrame([("1.2.3", "v1.10.0"), ("1.2.3rc1", "1.2.4"), ("2.0.0", "2.0.0")], "installed string, latest string")
    assert [r.outdated for r in outdated_versions(df).collect()] == [True, None, False]


def test_translation_keeps_what_fails(spark):
    from postlens.operators.chunking import route_translation

    def shout(pdf):
        if pdf["text"].str.contains("bad").any():
            raise ValueError("bad row")
        return pdf["text"].str.upper() + "\u2581x"

    rows = [(k, t, None, "fr") for k, t in enumerate(["un", "bad", None, "deux", "trois"])] + [(9, "one", None, "en")]
    df = spark.createDataFrame(rows, "id long, content string, title string, language string")
    got = {r.id: (r.translation, r.translated) for r in route_translation(df, "content", "title", "language", shout).collect()}
    assert got == {0: ("UN x", True), 1: ("bad", False), 2: (None, False), 3: ("DEUX x", True), 4: ("TROIS x", True), 9: ("one", False)}


def test_model_loads_once_per_worker(spark, tmp_path):
    from postlens.operators.scoring import score_with_model
    path = str(tmp_path)

    def load():
        import os
        import uuid
        open(os.path.join(path, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return 2

    def apply(model, pdf):
        return pdf.assign(y=pdf["id"] * model)[["y"]]

    df = spark.range(64).repartition(16)
    assert sorted(r.y for r in score_with_model(df, load, apply, "y long", name="twice").collect()) == list(range(0, 128, 2))
    pids = [x.name.split("-")[0] for x in tmp_path.iterdir()]
    assert len(pids) == len(set(pids))
    with pytest.raises(ValueError):
        score_with_model(df, lambda: 1, apply, "y long")


def test_split_joined_far_positions(spark):
    from postlens.operators.keywords import split_joined
    df = spark.createDataFrame([(1, 40_000_000, "abc#defg")], "doc_id long, pos int, kw string")
    assert [r.pos for r in split_joined(df).collect()] == [40_000_000_000_000, 40_000_000_000_001]


def _merged(state, update):
    for k, v in update.items():
        if isinstance(v, dict) and isinstance(state.get(k), dict):
            _merged(state[k], v)
        else:
            state[k] = _merged({}, v) if isinstance(v, dict) else v
    return state


def _state_rows(state, path=()):
    for k, v in state.items():
        if isinstance(v, dict) and v:
            yield from _state_rows(v, (*path, k))
        else:
            said = v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
            yield ".".join(x.replace("\\", "\\\\").replace(".", "\\.") for x in (*path, k)), said


def test_fold_state_matches_sequential_merge(spark):
    rng = random.Random(11)
    names = ["a", "b", "a.b", "c\\d", "e"]

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.75:
            return {rng.choice(names): value(depth - 1) for _ in range(rng.randrange(0, 3))}
        return rng.choice([None, 1, -2, True, "x", '{"b":1}', "{", [1, {"q": None}], {}, ""])

    rows, want = [], {}
    for seq in range(400):
        key, update = rng.randrange(6), {rng.choice(names): value(rng.choice([1, 2, 3, 12])) for _ in range(2)}
        rows.append((key, seq, json.dumps(update)))
        _merged(want.setdefault(key, {}), update)
    deep = {"x": 1}
    for _ in range(40):
        deep = {"n": deep}
    rows += [(9, 500, json.dumps(deep)), (9, 501, json.dumps(deep).replace('"x": 1', '"y": 2')), (10, 502, None), (10, 503, "not json")]
    got = statelog.fold_state(spark.createDataFrame(rows, "key long, seq long, json string").repartition(5)).collect()
    nine = ".".join(["n"] * 40)
    expect = {(k, p, v) for k, s in want.items() for p, v in _state_rows(s)} | {(9, nine + ".x", "1"), (9, nine + ".y", "2")}
    assert len(got) == len(expect) and {(r.key, r.path, r.value) for r in got} == expect


def test_throttle_chain_matches_sequential_rule(spark):
    rng = random.Random(5)
    base = ts("2024-01-01 00:00:00")
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold", None]), base + dt.timedelta(seconds=rng.randrange(0, 200_000) // 7 * 7))
            for i in range(600)] + [(900, "hot", None), (901, "once", base)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").repartition(4)
    for hours in (0.5, 3, 1000):
        want = set()
        for k in ("hot", "cold", None, "once"):
            last = None
            for t, i in sorted((t, i) for i, key, t in rows if key == k and t is not None):
                if last is None or (t - last).total_seconds() >= hours * 3600:
                    want.add(i)
                    last = t
        got = [r.event_id for r in statelog.throttle(df, "event_type", "ts", "event_id", hours).collect()]
        assert len(got) == len(want) and set(got) == want


def _sequential_batches(rows, batch_size, max_tokens, gap, min_early):
    out = {}
    for feed in {r[1] for r in rows}:
        b = n = s = 0
        last = None
        for i, _, t, tok in sorted((r for r in rows if r[1] == feed), key=lambda r: (r[2], r[0])):
            n, s = n + 1, s + (tok or 0)
            wide = last is not None and (t - last).total_seconds() > gap
            last = t
            why = "early" if wide and n >= min_early else "tokens" if s > max_tokens else "full" if n >= batch_size else None
            out[i] = (feed, b, n, s, why)
            if why:
                b, n, s = b + 1, 0, 0
    return out


@pytest.mark.parametrize("block_rows,fan", [(100_000, 1_000), (8, 2), (11, 3), (50, 1_000)])
def test_batches_of_a_hot_feed_match_the_sequential_rule(spark, block_rows, fan):
    rng = random.Random(block_rows)
    base, rows, t = ts("2024-01-01 00:00:00"), [], 0
    for i in range(400):
        t += rng.choice([1, 5, 30, 100, 4000])
        rows.append((i, rng.choice([1, 1, 1, 1, 2, None]), base + dt.timedelta(seconds=t), rng.choice([0, 1, 3, 9, 40, None])))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, tokens long").repartition(3)
    got = batching.assemble_batches(df, "user_id", "ts", "event_id", "tokens", 8, 40, 90, 3, block_rows, fan).collect()
    assert len(got) == len(rows)
    assert {r.row_id: (r.feed, r.batch_no, r.chunk_in_batch, r.tokens_in_batch, r.close_reason) for r in got} \
        == _sequential_batches(rows, 8, 40, 90, 3)


def test_items_source_batch_and_stream(spark, tmp_path):
    from postlens.sources import items_source
    from postlens.streaming import streams
    rows = [(i, f"https://a.org/{i}", None if i % 10 == 3 else f"<p>{'Bitcoin' if i % 3 else 'other'} {i}</p>") for i in range(60)]
    pages = str(tmp_path / "pages")
    spark.createDataFrame(rows, items_source.SCHEMA).repartition(5).write.parquet(pages)
    items_source.register(spark)
    want = sorted(i for i, _, h in rows if h and "bitcoin" in h.lower())
    for splits in ("1", "3"):
        options = {"path": pages, "keyword": "BITCOIN", "splitsPerFile": splits}
        assert sorted(r.page_id for r in spark.read.format("items").options(**options).load().collect()) == want
        out = streams.run_available(spark.readStream.format("items").options(**options).load(), name="items")
        assert sorted(r.page_id for r in out.collect()) == want


def test_oversized_batch_raises(spark):
    from postlens.sources import batches
    items = spark.range(30).selectExpr("id % 2 as batch_id", "id as item_no", "named_struct('url', 'u') as item")
    assert sorted(r.n_items for r in batches.batch_documents(items, max_items=15).collect()) == [15, 15]
    with pytest.raises(ValueError, match="more than 14"):
        batches.batch_documents(items, max_items=14)


def test_dedup_url_stream_over_files_in_any_order(spark, tmp_path):
    from postlens.streaming import streams
    base = ts("2024-01-01 00:00:00")
    path = str(tmp_path / "urls")
    for part in (3, 0, 2, 1):  # the last hours come first
        rows = [(f"u{(part * 7 + k) % 11}", base + dt.timedelta(hours=50 * part + k)) for k in range(20)]
        df = spark.createDataFrame(rows, "url string, ts timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(path)
    out = streams.run_available(streams.dedup_url_stream(streams.read_stream(spark, path, df.schema), "url").select("url"), name="urls")
    assert sorted(r.url for r in out.collect()) == sorted(f"u{k}" for k in range(11))


def test_fold_state_null_keys_hostile_documents_and_snapshots(spark, tmp_path):
    deep = '{"a":' * 100_000 + "[" * 3 + "1.50" + "]" * 3 + "}" * 100_000
    lists = '{"l":' + "[" * 50_000 + "]" * 50_000 + "}"
    rows = [(None, 0, '{"a":{"b":1}}'), (None, 1, '{"a":5}'), (1, 2, '{"s":"\\ud800","\\udfff":1}'), (2, 3, deep), (3, 4, lists),
            (4, 5, '{"a":' * 100_000 + "}" * 99_999), (5, 6, '{"x":{}}'), (5, 7, '{"x":{"y":2}}'), (5, 8, '{"x":{"z":{}}}'), (5, 9, '{"x":7}')]
    df = spark.createDataFrame(rows, "key long, seq long, json string")
    got = {(r.key, r.path): r.value for r in statelog.fold_state(df).collect()}
    cut = 100_000 - statelog.MAX_DEPTH
    assert got.pop((2, ".".join(["a"] * statelog.MAX_DEPTH))) == '{"a":' * cut + "[[[1.50]]]" + "}" * cut
    assert got.pop((3, "l")) == "[" * 50_000 + "]" * 50_000
    assert got == {(None, "a"): "5", (1, "s"): "�", (1, "�"): "1", (5, "x"): "7"}
    folder = str(tmp_path / "state")
    for upto in (1, 6, 8, 9):
        state = statelog.compact_state(df.where(F.col("seq") <= upto).where("key is null or key not in (2, 3)"), folder)
        want = statelog.fold_state(df.where(F.col("seq") <= upto).where("key is null or key not in (2, 3)")).collect()
        have = state.select("key", statelog.path_text(F.col("path")).alias("path"), "value").collect()
        assert sorted(map(str, have)) == sorted(map(str, want))
    assert statelog.compact_state(df.where("key is null or key not in (2, 3)"), folder).count() == 4


def test_deep_json_parser_agrees_with_the_standard_one():
    rng = random.Random(3)
    good = ['{"a": [1, {"b": null}, "x\\"y"], "c": {}}', "[]", '"s"', "1.0", '{"a":{"a":[[],[{}]]}}']
    for _ in range(3000):
        js = list(rng.choice(good))
        for _ in range(rng.randrange(3)):
            js[rng.randrange(len(js))] = rng.choice('{}[],:" a1')
        js = "".join(js)
        try:
            want = statelog._scalar(js)
        except ValueError:
            want = ValueError
        try:
            got = statelog._nested(js)
        except ValueError:
            got = ValueError
        assert got == want, js
