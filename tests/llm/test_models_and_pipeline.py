"""Language ID, toxicity, chat formatting and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm import chat_format, langid, toxicity
from postlens.llm.queries import op1, op7, op10

from .conftest import SF

MORE = "/root/testdata/sf0.01"


# ---- language -----------------------------------------------------------------------

def test_language_held_out_accuracy(spark, con):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = op1(spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_cases(spark, docs_of):
    train = [(k, t, l) for k, (t, l) in enumerate([("the cat and the dog are here", "en"), ("der Hund und die Katze sind hier", "de"),
                                                   ("le chat et le chien sont ici", "fr"), ("кошка и собака здесь", "xx")] * 5)]
    model = langid.fit(docs_of(*train, (90, "no label", None), (91, None, "en"), (92, "123", "en"), (None, "the", "en")))
    assert model.families.names == ["germanic", "romance", "xx"] and model.members["germanic"].names == ["de", "en"]
    ask = docs_of((1, "the dog"), (2, None), (3, ""), (4, "12 !?"), (5, "die Katze und der Hund"), (5, "die Katze und der Hund"),
                  (6, "le chien et le chat " * 20_000), (None, "собака и кошка"))
    got = [(r["doc_id"], r["p"]["lang_pred"], r["p"]["score"]) for r in ask.select("doc_id", langid.predict(model)("text").alias("p")).collect()]
    assert [x[1] for x in got] == ["en", "und", "und", "und", "de", "de", "fr", "xx"]
    assert all((s == 0) == (l == "und") and 0 <= s <= 1 for _, l, s in got)
    one = langid.fit(docs_of((1, "nur deutsch hier", "de")))
    assert [r["p"]["lang_pred"] for r in docs_of((1, "egal")).select(langid.predict(one)("text").alias("p")).collect()] == ["de"]
    none = langid.fit(docs_of())
    assert none is None and docs_of((1, "x")).select(langid.predict(none)("text").alias("p")).first()["p"]["lang_pred"] == "und"


# ---- toxicity -----------------------------------------------------------------------

def test_toxicity_held_out(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = op7(spark, MORE).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(r["predicted"] and toxic[r["doc_id"]] for r in held)
    assert hit >= 0.6 * sum(toxic[r["doc_id"]] for r in held) and hit >= 0.9 * sum(r["predicted"] for r in held)


def test_toxicity_cases(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1)], "doc_id long, toxic int")
    only = toxicity.fit(docs_of((1, "you idiot"), (2, "x"), (3, None)), labels)
    assert only.trees is None and only.base == 1.0  # one label only
    assert toxicity.fit(docs_of(), labels).base == 0.0
    empty = toxicity.score(docs_of(), only)
    assert empty.collect() == [] and "score" in empty.columns
    clean = "a quiet text about rivers and hills number"
    docs = docs_of(*[(k, f"{clean} {k}" if k % 3 else f"you are a stupid idiot {k}") for k in range(90)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ask = docs_of((1, clean), (2, "what a stupid idiot you are"), (3, None), (4, ""), (4, ""), (5, "! " * 50_000)).withColumn("score", F.lit("mine"))
    out = toxicity.score(ask.withColumn("p", F.lit(1)), model)
    assert out.columns.count("score") == 1 and out.filter("p = 1").count() == 6
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["score"])
    assert got[2][0] >= 0.5 > got[1][0] and got[4][0] == got[4][1] and all(0 <= x <= 1 for v in got.values() for x in v)


# ---- chat ---------------------------------------------------------------------------

TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|x", "a<", "|b", "<|", "\\", "\n", "", "<<|>|", "ünï <|im_end|>\n", "x\\n"]


def test_chat_round_trip_and_cases(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", s) for k in range(3) for t, s in enumerate(TRICKY[k:])]
    rows += [(50, 1, "assistant", None), (50, 0, None, "q"), (50, 1, "assistant", None), (51, None, "a\\n\nb<|", "z"), (None, 0, "user", "n"),
             (60, 0, "assistant", "long " * 200_000), (60, 1, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), "formatted",
                                               chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("said"), "loss").collect()}
    want = defaultdict(list)
    for c, t, r, s in rows:
        want[c].append((t is not None, t or 0, r or "", s or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(r, s) for *_, r, s in turns]
        assert got[c]["said"] == "".join(s for *_, r, s in turns if r == "assistant")
        assert len(got[c]["loss"]) == sum(r == "assistant" for *_, r, _ in turns)
        assert got[c]["formatted"].count("<|im_start|>") == got[c]["formatted"].count("<|im_end|>") == len(turns)
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_chat_query(spark, con):
    turns = defaultdict(list)
    for c, _, r, s in con.sql("SELECT conv_id, turn, role, text FROM conversations ORDER BY 1, 2").fetchall():
        turns[c].append((r or "", s or ""))
    turns[-1] = [("user", TRICKY[0]), ("assistant", TRICKY[0])]
    rows = op10(spark, SF).collect()
    assert {r["conv_id"] for r in rows} == set(turns)
    for r in rows:
        t = turns[r["conv_id"]]
        said = "".join(s for role, s in t if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"]) == (len(t), len(said))
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# ---- pipeline -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def stages(spark, sf_docs):
    docs, out = sf_docs, []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF).cache()
        out.append((name, docs, result))
        docs = result
    return out


def test_pipeline_stages_follow_their_operators(stages, spark):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns == corpus_pipeline.COLUMNS, name
    rows = {name: ({r["doc_id"]: r for r in b.collect()}, a.collect()) for name, b, a in stages}
    before, after = rows["toxicity"]
    assert 0.7 * len(before) < len(after) < len(before) and all(r == before[r["doc_id"]] for r in after)
    before, after = rows["line_dedup"]
    from .test_near_duplicates import _lines_brute, _simhash_brute
    gone = _lines_brute([(i, r["text"]) for i, r in before.items()])
    wrong = sum(r["text"] != "\n".join(x for k, x in enumerate((before[r["doc_id"]]["text"] or "").split("\n")) if (r["doc_id"], k) not in gone)
                for r in after)
    assert wrong <= 0.02 * len(after) and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = rows["simhash_near_dedup"]
    assert Counter(r["doc_id"] for r in after) == Counter({i for *_, i in _simhash_brute([(i, r["text"]) for i, r in before.items()])})
    before, after = rows["decontamination"]
    assert len(after) < len(before) and {r["doc_id"] for r in after} <= set(before)
    before, after = rows["mixing"]
    copies = Counter(r["doc_id"] for r in after)
    assert all(sorted(r["copy_no"] for r in after if r["doc_id"] == i) == list(range(1, n + 1)) for i, n in list(copies.items())[:50])
    assert max(copies.values()) <= 3


def test_pipeline_cases(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], [(None, None), (1, None), (1, ""), (2, "same words here and there"), (2, "same words here and there"),
                      (3, "same words here and there", None, "s")]):
        docs = docs_of(*rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert {r["doc_id"] for r in docs.collect()} <= {r[0] for r in rows}


def test_near_dedup_keeps_one_row_of_each_group(spark, docs_of):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (None, say(2), "en"),  # no id: two groups
            (1, say(3)), (1, say(4)), (1, say(4), "de"),  # one id: two groups
            (2, say(3)), (3, say(5)), (None, say(5)), (3, say(5)), (5, say(6)), (4, say(6)),
            (6, None, "en"), (6, "en"), (7, None)]
    got = corpus_pipeline.keep_one_of_group(spark, docs_of(*rows), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(
        [(None, say(1)), (None, say(2)), (1, say(3)), (1, say(4)), (3, say(5)), (4, say(6)), (6, None), (6, "en")])
