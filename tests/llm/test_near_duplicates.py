"""SimHash groups, line dedup, sentence spans, components and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import decontam, line_dedup, sentence_spans, simhash_groups
from postlens.llm.components import components
from postlens.llm.queries import op3, op5, op6, op8

from .conftest import SF


def _roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components ---------------------------------------------------------------------

@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 100)],
    [(random.Random(k).randrange(80), random.Random(1000 + k).randrange(80)) for k in range(60)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == _roots({x for e in real for x in e}, real)


@pytest.fixture
def many_partitions(spark):
    """A session whose shuffles end in 64 partitions whatever they hold; gives the count of checkpoint files."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    yield lambda: sum(1 for _ in folder.rglob("part-*"))
    for k, v in was.items():
        spark.conf.set(k, v)


def test_components_of_few_edges_take_few_files(spark, many_partitions):
    before, rounds = many_partitions(), []
    edges = [(i, i + 1) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), about=len(edges)).collect()}
    assert got == {i: 0 for i in range(41)}
    # several rounds, one file a core each
    assert many_partitions() - before <= 12 * spark.sparkContext.defaultParallelism


def test_near_duplicates_of_few_rows_take_few_files(spark, docs_of, many_partitions):
    docs = docs_of(*[(i, f"the same line in every one\nand a line of its own, number {i * 7919}") for i in range(30)]).repartition(4)
    before = many_partitions()
    lost = line_dedup.dedup_lines(docs).filter(F.size("removed") > 0).count()
    assert lost >= 29
    middle = many_partitions()
    # candidates and the places of lines fill the shuffle's partitions, what comes of them does not
    assert middle - before <= 2 * 64 + 12 * spark.sparkContext.defaultParallelism
    assert simhash_groups.groups(docs).count() == 30
    assert many_partitions() - middle <= 12 * spark.sparkContext.defaultParallelism


# ---- SimHash ------------------------------------------------------------------------

def _print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def _simhash_brute(rows):
    prints = [(i, _print(t)) for i, t in rows]
    ids = range(len(rows))
    links = [(a, b) for a in ids for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 4]
    root = _roots(ids, links)
    least = {}
    for a in ids:
        if prints[a][0] is not None:
            least[root[a]] = min(least.get(root[a], prints[a][0]), prints[a][0])
    return Counter((prints[a][0], f"{prints[a][1]:016x}", least.get(root[a])) for a in ids)


def test_simhash_query_matches_brute_force(spark, texts):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in op6(spark, SF).collect())
    assert got == _simhash_brute(list(texts.items()))


def test_simhash_cases(spark, docs_of):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \n "), (None, "A b"), (9, "a B"),
            (10, "one two three"), (11, "ÄB ab"), (12, "x " * 30_000)]
    got = Counter(tuple(r) for r in simhash_groups.groups(docs_of(*rows).withColumn("fp", F.lit("mine"))).select(
        "doc_id", simhash_groups.hex_digits(), "component_id").collect())
    assert got == _simhash_brute(rows)
    assert simhash_groups.groups(docs_of()).collect() == []


def test_gray_tree():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b for b in base}
    for b in base:  # chains and clusters
        x = b
        for _ in range(40):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = _roots(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 4])
    a, b = simhash_groups.link_large(np.array(fps, np.uint64), 4)
    assert _roots(fps, zip(a.tolist(), b.tolist())) == want
    a, b = simhash_groups.link_small(np.array(fps, np.uint64), np.array([len(fps)]), 4)
    assert _roots(fps, zip(a.tolist(), b.tolist())) == want


def test_groups_beyond_the_limit_are_dealt_again(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = _roots(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 1])
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").cache()
    for limit in (4, 10_000):
        edges = simhash_groups.links(signed, 1, max_group=limit).collect()
        assert _roots(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges]) == want


# ---- lines --------------------------------------------------------------------------

def _lines_brute(rows):
    """rows by doc_id; (doc_id, pos) of the lines that go."""
    lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(x) >= line_dedup.MIN_CHARS]
    distinct = sorted({x for *_, x in lines})
    sets = [frozenset(x[j:j + 8] for j in range(len(x) - 7)) for x in distinct]
    holds = defaultdict(list)
    pairs = []
    for a, s in enumerate(sets):
        for b, n in Counter(b for g in s for b in holds[g]).items():
            if n >= line_dedup.SIMILARITY * (len(s) + len(sets[b]) - n):
                pairs.append((a, b))
        for g in s:
            holds[g].append(a)
    root = _roots(range(len(sets)), pairs)
    number, seen, gone = {x: a for a, x in enumerate(distinct)}, {}, set()
    for i, k, x in sorted(lines, key=lambda r: r[:2]):
        if seen.setdefault(root[number[x]], (i, k)) != (i, k):
            gone.add((i, k))
    return gone


def test_line_dedup_query_matches_brute_force(spark, texts):
    got = op8(spark, SF).collect()
    gone = {(r["doc_id"], k) for r in got for k in r["removed"]}
    want = _lines_brute(list(texts.items()))
    assert len(want) > 50 and gone <= want and len(gone) >= 0.98 * len(want)  # banding may miss a pair
    for r in got:
        if texts[r["doc_id"]] is not None:
            kept = [x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in r["removed"]]
            assert r["text"] == "\n".join(kept)


def test_line_dedup_cases_and_blocks(spark, docs_of):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short\nshort"), (5, "\n".join(base)), (5, "\n".join(base))]
    for k in range(30):  # near copies of one line: one large band
        w = base[0].split()
        w[rng.randrange(40)] = rng.choice(words)
        rows.append((10 + k, " ".join(w) + "\nown " + " ".join(rng.choice(words) for _ in range(9))))
    rows.append((None, base[1] + "\n" + base[1]))
    docs = docs_of(*rows).withColumn("removed", F.lit("mine")).withColumn("line", F.lit(1))
    for block in (4_000, 4):
        got = line_dedup.dedup_lines(docs, block=block)
        assert got.columns.count("removed") == 1
        out = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
        by = {r["doc_id"]: r for r in out}
        assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[3]["text"] == "short\nshort"
        assert [r["removed"] for r in out if r["doc_id"] == 5] == [[], []]
        want = _lines_brute([r for r in rows if r[0] is not None])
        assert {(i, k) for i in by if i is not None and i != 5 for k in by[i]["removed"]} == {x for x in want if x[0] != 5}
        assert by[None]["removed"] == [0, 1]
    assert line_dedup.dedup_lines(docs_of()).collect() == []


def test_line_dedup_takes_short_lines(spark, docs_of):
    rights, menu = "All rights reserved.", "Menu >>"
    rows = [(1, f"{rights}\n{menu}\none of these stays"), (2, f"{rights}\n{menu}\n{' ' * 30}\n{' ' * 30}"), (3, f"own line\n{rights}"), (4, "Menu <<")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(docs_of(*rows)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [1], 4: []}


def test_sets_of_a_batch_are_made_in_pieces(monkeypatch):
    r = random.Random(8)
    # groups of three: the first is unlike the others, which are copies but for a word
    groups = []
    for _ in range(60):
        first, second = (" ".join("%06x" % r.randrange(1 << 24) for _ in range(60)) for _ in range(2))
        groups.append([first, second, second[:-6] + "ending"])
    sizes = []
    made = line_dedup.shingle_sets
    monkeypatch.setattr(line_dedup, "_FLAT", 4_000)
    monkeypatch.setattr(line_dedup, "shingle_sets", lambda lines: sizes.append(sum(map(len, lines))) or made(lines))
    row = pa.struct([("line", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])
    ids = iter(range(1000))
    first = pa.array([[{"line": x, "h1": next(ids), "h2": 0} for x in g] for g in groups], pa.list_(row))
    batch = pa.RecordBatch.from_arrays([first, pa.nulls(len(groups), pa.list_(row))], names=["first", "second"])
    (edges,) = line_dedup._verify_batches(0.8)([batch])
    assert sorted(zip(edges["a1"].to_pylist(), edges["b1"].to_pylist())) == [(3 * k + 1, 3 * k + 2) for k in range(60)]
    assert max(sizes) <= 4_000 and sum(sizes) == sum(len(x) for g in groups for x in g)


def test_a_task_forgets_no_line_that_it_has_not_sent(monkeypatch):
    monkeypatch.setattr(line_dedup, "_MET", 8)
    r = random.Random(9)
    # hashes that share places, one of them 0, and those that an empty place might be taken for
    hashes = [0, 8, 16, -8, *(~k for k in range(8)), *(r.randrange(-1 << 63, 1 << 63) for _ in range(100)), 0, 8, 0, 0, -1]
    sent = []
    for k in range(0, len(hashes), 7):
        own = hashes[k:k + 7]
        batch = pa.RecordBatch.from_arrays([pa.array([f"line number {h}" for h in own]), pa.array(own, pa.int64())], names=["line", "h1"])
        (out,) = line_dedup._band_batches([batch])
        sent += out["h1"].to_pylist()
    assert set(sent) == set(hashes) and Counter(sent)[0] == line_dedup.BANDS * 2  # each call is a task of its own
    copies = pa.RecordBatch.from_arrays([pa.array(["the same line"] * 3), pa.array([5, 5, 5], pa.int64())], names=["line", "h1"])
    assert [len(b) for b in line_dedup._band_batches([copies, copies])] == [line_dedup.BANDS, 0]


# ---- sentences ----------------------------------------------------------------------

def _spans_brute(rows, least=sentence_spans.MIN_WORDS):
    seen, gone = {}, defaultdict(set)
    for i, t in rows:
        words = [t[a:b].lower().split() for a, b in sentence_spans.sentences(t or "")]
        for a, b in sorted(sentence_spans.runs([len(w) for w in words], least)):
            key = tuple(tuple(w) for w in words[a:b + 1] if w)
            if seen.setdefault(key, (i, a)) != (i, a):
                gone[i] |= set(range(a, b + 1))
    return gone


def test_sentence_spans_query_matches_brute_force(spark, texts):
    want = _spans_brute(sorted(texts.items()))
    assert want
    for r in op5(spark, SF).collect():
        t, gone = texts[r["doc_id"]], want.get(r["doc_id"], set())
        cuts = sentence_spans.sentences(t or "")
        assert (r["n_sentences"], r["n_removed"]) == (len(cuts), len(gone))
        assert r["text"] == (t if not gone else "".join(t[a:b] for k, (a, b) in enumerate(cuts) if k not in gone))


def test_runs_reach_both_ends():
    rng = random.Random(2)
    for _ in range(200):
        counts = [rng.randrange(0, 15) for _ in range(rng.randrange(0, 12))]
        want = set()
        for i in range(len(counts)):
            j = next((j for j in range(i, len(counts)) if sum(counts[i:j + 1]) >= 20), None)
            want |= {(i, j)} if j is not None else set()
            k = next((k for k in range(i, -1, -1) if sum(counts[k:i + 1]) >= 20), None)
            want |= {(k, i)} if k is not None else set()
        assert sentence_spans.runs(counts, 20) == want


def test_sentence_spans_catch_an_inserted_passage(spark, docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(say(12) for _ in range(5))
    rows = [(k, f"{say(30)} {say(20)} and {passage} so {say(25)}") for k in (3, 4, 5)]
    rows += [(6, say(30)), (7, None), (8, ""), (9, "no end here"), (10, rows[0][1]), (10, rows[0][1]), (None, rows[1][1])]
    got = sentence_spans.remove_repeats(docs_of(*rows).withColumn("n_removed", F.lit("mine")).withColumn("h1", F.lit(0)))
    out = defaultdict(list)
    for r in got.collect():
        out[r["doc_id"]].append(r)
    assert out[3][0]["n_removed"] == 0 and out[6][0]["n_removed"] == 0 and out[7][0]["text"] is None
    for k in (4, 5):
        assert passage[90:] not in out[k][0]["text"] and rows[k - 3][1].split(".")[0] in out[k][0]["text"]
        assert out[k][0]["text"].endswith(rows[k - 3][1][-30:])
    assert out[10][0] == out[10][1] and out[10][0]["text"] == "" and out[None][0]["text"] == ""
    assert sentence_spans.remove_repeats(docs_of()).collect() == []


# ---- decontamination ----------------------------------------------------------------

def _tokens(t):
    return re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode().lower())


def _distance(item, text):
    """Least edit distance of a list to a part of another."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_query_matches_brute_force(spark, texts, con):
    items = {i: _tokens(t) for i, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()}
    want = set()
    for d, t in texts.items():
        words = _tokens(t)
        for i, w in items.items():
            most = int(decontam.MAX_EDITS * len(w))
            near = set(words)
            if len(w) >= decontam.MIN_ITEM_WORDS and len(set(w) - near) <= most and _distance(w, words) <= most:
                want.add((d, i))
    got = {(r["doc_id"], h["item_id"]) for r in op3(spark, SF).collect() for h in r["hits"]}
    assert want and got == want


def test_decontamination_recall_of_edited_items(spark, docs_of, texts, con):
    rng = random.Random(4)
    items = con.sql("SELECT item_id, text FROM benchmark ORDER BY 1").fetchall()
    pool = [w for t in texts.values() for w in (t or "").split()]
    rows = []
    for k in range(200):
        w = items[k % len(items)][1].split()
        for _ in range(len(w) // 10):
            p = rng.randrange(len(w))
            w[p:p + 1] = rng.choice([[], [rng.choice(pool)], [w[p], rng.choice(pool)]])
        a = rng.randrange(len(pool) - 200)
        rows.append((k, " ".join(pool[a:a + 80] + w + pool[a + 80:a + 150])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontam.find_items(docs_of(*rows), bench).collect()}
    assert sum(items[k % len(items)][0] in hits[k] for k in range(200)) >= 190


def test_decontamination_cases(spark, docs_of):
    item = " ".join(f"alpha{k} beta{k}" for k in range(12))
    bench = spark.createDataFrame([(7, item), (8, item), (8, item), (None, None), (9, "too short"), (None, "one two three four five six seven eight nine")],
                                  "item_id long, text string")
    long = " ".join(f"filler{k % 977}" for k in range(40_000))
    docs = docs_of((1, f"Before. {item.upper()}, after"), (2, None), (3, ""), (4, "alpha0 beta0"), (5, f"{long} {item} {long} {item}"),
                   (5, item), (None, "x one two three four five six seven eight nine")).withColumn("hits", F.lit("mine"))
    for block in (decontam.BLOCK_WORDS, 6):  # blocks of the benchmark give equal results
        got = defaultdict(list)
        for r in decontam.find_items(docs, bench, block_words=block).collect():
            got[r["doc_id"]].append(sorted((h["item_id"] or -1, h["start"], h["end"], h["distance"]) for h in r["hits"]))
        assert got[1] == [[(7, 1, 25, 0), (8, 1, 25, 0)]] and got[2] == got[3] == got[4] == [[]]
        assert sorted(map(len, got[5])) == [2, 4] and got[None] == [[(-1, 1, 10, 0)]]
    assert all(r["hits"] == [] for r in decontam.find_items(docs, bench.limit(0)).collect())
    assert decontam.find_items(docs_of(), bench).collect() == []


def test_walks_that_met_give_the_keys_of_lone_walks():
    rng = random.Random(12)
    texts = [b"", b"  ", " ".join(rng.choice(["a", "b", "c\n", "été", "d,e"]) for _ in range(700)).encode(), b"one", b"x" * 70_000 + b" y", b"Z z. "]
    hashes = decontam.words_of(texts)
    assert decontam.words_of([]) == []
    assert [x.tolist() for x in hashes] == [decontam.word_hashes(t).tolist() for t in texts]
    assert [len(x) for x in hashes] == [len(_tokens(t.decode())) for t in texts]
    words, widths = hashes[2], [8, 20]
    together = decontam.walk_keys(words, widths)
    for k in (0, 1, 350, len(words) - 1):  # one window alone never meets another
        for a, b in zip(together, decontam.walk_keys(words[k:k + 41], widths)):
            assert (a[:, k] == b[:, 0]).all()
        # the walk step by step, in whole numbers
        padded = np.concatenate([words, np.full(41, decontam._PAD)])
        for r, reads in enumerate(decontam.reading_plan(widths)):
            at, want = k, [[0] * decontam.TABLES for _ in widths]
            for j in range(40):
                for c, tables in reads.get(j, {}).items():
                    seen = padded[at] if at - k < widths[c] else decontam._PAD
                    for t, place in tables:
                        want[c][t - r * decontam.TABLES] += int(seen) * int(decontam._ODD[place])
                at += int(decontam._mix(padded[at:at + 1] ^ decontam._SEEDS[r, 0])[0]) >> j & 1
            for c, sums in enumerate(want):
                for t, x in enumerate(sums):
                    x %= 1 << 32
                    assert int(together[c][r * decontam.TABLES + t, k]) == (x ^ x >> 16) * 0x9E3779B1 % (1 << 32)


def test_what_a_walk_reads_is_planned_once_an_index(monkeypatch):
    item = decontam.word_hashes(" ".join(f"w{k}" for k in range(20)).encode())
    index = decontam.Index.build([1], [item])
    texts = [np.concatenate([item, decontam.word_hashes(f"other {k}".encode())]) for k in range(50)]
    planned, real = [], decontam.sampled_places
    monkeypatch.setattr(decontam, "sampled_places", lambda width: planned.append(width) or real(width))
    monkeypatch.setattr(decontam, "CHUNK", 64)
    assert all(len(hits) == 1 for hits in decontam.search(index, texts))
    assert len(planned) <= len(index.widths)


def test_decontamination_when_a_batch_ends_with_a_search(spark, docs_of, monkeypatch):
    item = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontam, "SEARCH_BYTES", 10)
    docs = docs_of(*[(k, f"other {k} {item}" if k % 2 else None) for k in range(6)]).coalesce(1)
    got = {r["doc_id"]: len(r["hits"]) for r in decontam.find_items(docs, bench).collect()}
    assert got == {k: k % 2 for k in range(6)}


def test_pairs_of_lines_at_once_match_plain_sets():
    from postlens.llm import line_dedup
    rng = random.Random(11)
    lines = []
    for k in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 200)))
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            b[rng.randrange(len(b))] = rng.choice("abcdefg")
        lines += [a, "".join(b) if k % 9 else "x" * rng.randrange(1, 50)]
    lines += ["日本語の文章です。" * 9, "日本語の文章です。" * 10, "short", "short", "a", "b"]

    def grams(x):
        return {x[i:i + 8] for i in range(max(1, len(x) - 7))}
    want = [len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for a, b in zip(lines[::2], lines[1::2])]
    assert line_dedup.similar_pairs(lines).tolist() == want and 50 < sum(want) < 350
