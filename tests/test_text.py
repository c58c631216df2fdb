"""Hand-made expectations for text, keyword and scoring operators (FIXTURES §4)."""

from decimal import Decimal

from pyspark.sql import functions as F

from postlens.operators import chunking, keywords as K, scoring as S


def _kw(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def _list(df):
    return [r.kw for r in df.orderBy("pos").collect()]


def test_tickers(spark):
    assert _list(K.tickers(_kw(spark, "Buy $BTC, now$ETH. $"), "doc_id", "text")) == ["$BTC", "$ETH"]


def test_split_joined(spark):
    c = spark.createDataFrame([(1, 0, "$RET#Renewable_Energy_Token"), (1, 1, "$BTC")], "doc_id long, pos long, kw string")
    assert _list(K.split_joined(c)) == ["RET", "Renewable_Energy_Token", "$BTC"]


def test_case_expand(spark):
    c = spark.createDataFrame([(1, i, k) for i, k in enumerate(["BTC", "Defi", "eth", "123"])],
                              "doc_id long, pos long, kw string")
    assert sorted(r.kw for r in K.case_expand(c).collect()) == sorted(["BTC", "btc", "defi", "eth", "123"])


def test_drop_invalid(spark):
    c = spark.createDataFrame([(1, i, k) for i, k in enumerate(["//CONNECT.COM", "https://x.io/a", "ab"])],
                              "doc_id long, pos long, kw string")
    assert _list(K.drop_invalid(c)) == ["CONNECT.COM"]


def test_noise_filter_counts_before_trim(spark):
    c = spark.createDataFrame([(1, 0, "éclair"), (1, 1, "ab1"), (1, 2, "a.b"), (1, 3, "well-known"), (1, 4, "abcd9")],
                              "doc_id long, pos long, kw string")
    got = _list(K.noise_filter(c))
    # edge accent trimmed, 'ab1' 1/2 non-letters > 20 %, punctuation kills 'a.b', hyphen ok but 1/9 non-letters
    assert got == ["clair", "well-known", "abcd9"]


def test_pack_paragraphs_greedy(spark):
    # token sizes 3, 3, 9, 1 with limit 6 -> [a b] [c] [d] (pieces of 5 chars or less dropped)
    sents = ["aa aa aa", "bb bb bb", "cc cc cc cc cc cc cc cc cc", "dddddd"]
    df = spark.createDataFrame([(1, sents)], "doc_id long, s array<string>")
    got = df.select(chunking.paragraphs(F.col("s"), 6).alias("p")).first().p
    assert got == ["aa aa aa bb bb bb", "cc cc cc cc cc cc cc cc cc", "dddddd"]


def test_chunks_keep_sentences(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(400))
    df = spark.createDataFrame([(1, text, "t", "a")], "item_id long, content string, title string, author string")
    rows = chunking.chunk_items(df).orderBy("chunk_no").collect()
    assert len(rows) > 1 and all(r.title is None for r in rows) and all(r.author == "a" for r in rows)
    assert " ".join(r.content for r in rows) == text


def test_blend_sentiment_example(spark):
    df = spark.createDataFrame([(Decimal("0.5"), Decimal("0.5"), Decimal("0.6"))], "g decimal(4,2), l decimal(4,2), f decimal(4,2)")
    v = df.select(S.blend_sentiment(F.col("g"), F.col("l"), F.col("f")).alias("s")).first().s
    assert v == Decimal("0.56")


def test_source_type_exact_match(spark):
    df = spark.createDataFrame([("reddit.com",), ("www.reddit.com",)], "domain string")
    assert [r.source_type for r in S.source_type(df).orderBy("domain").collect()] == ["social", "news"]


def test_near_dup_drops_similar_long_terms(spark):
    r = spark.createDataFrame([(1, "internationalization", 1), (1, "internationalisation", 2), (1, "cat", 3)],
                              "doc_id long, term string, rank int")
    assert sorted(x.term for x in K.near_dup(r).collect()) == ["cat", "internationalization"]


def test_extract_keywords_runs(spark):
    df = spark.createDataFrame([(1, "Bitcoin rallies as $BTC hits AI records. Investors buy Bitcoin and S&P500 futures.")],
                               "doc_id long, text string")
    kws = K.extract_keywords(df, "doc_id", "text").first().keywords
    assert "$BTC" in kws and "bitcoin" in kws and kws == sorted(set(kws))


def test_near_dup_is_greedy_and_fills_up_after_removal(spark):
    a, b, c = "abcdefghijklmnopqrst", "abcdefghijklmnopqrsX", "abcdefghijklmnopqrYX"  # a~b, b~c, not a~c
    rows = [(1, a, 1), (1, b, 2), (1, c, 3)] + [(2, f"term number {k} " + "xyz"[k % 3] * 9, k) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, term string, rank int")
    got = sorted((r.doc_id, r.rank) for r in K.near_dup(df).collect())
    assert [r for r in got if r[0] == 1] == [(1, 1), (1, 3)] and len([r for r in got if r[0] == 2]) == 3
    many = [(1, f"{k:02d}" * 9, k + 1) for k in range(21)] + [(1, "00" * 8 + "0x", 2)]
    many = [(d, t, i) for i, (d, t, _) in enumerate([many[0], many[-1], *many[1:-1]], 1)]
    kept = K.near_dup(spark.createDataFrame(many, "doc_id long, term string, rank int"), top=20).collect()
    assert len(kept) == 20 and 2 not in {r.rank for r in kept}


def _yake(sentences, window, longest):
    """The published features and scores, term by term over plain lists."""
    import math
    import re
    import statistics
    from collections import Counter

    from postlens.operators.termgraph import STOPWORDS
    toks = [re.findall(r"[^\W_]+", s) for s in sentences]
    ok = lambda t: t not in STOPWORDS and len(t) >= 3 and not t.isdigit()
    low = [[w.lower() for w in s] for s in toks]
    tf = Counter(t for s in low for t in s if ok(t))
    n = len(tf)
    mean = sum(tf.values()) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in tf.values()) / n)
    score = {}
    for t in tf:
        at = [(i, j) for i, s in enumerate(low) for j, x in enumerate(s) if x == t]
        left = [low[i][j - d] for i, j in at for d in range(1, window + 1) if j >= d]
        right = [low[i][j + d] for i, j in at for d in range(1, window + 1) if j + d < len(low[i])]
        rel = sum(len(set(x)) / len(x) for x in (left, right) if x)
        cap = sum(j > 0 and toks[i][j][0].isupper() for i, j in at)
        acr = sum(len(toks[i][j]) > 1 and toks[i][j].isupper() for i, j in at)
        sents = sorted({i for i, _ in at})
        t_rel = 1 + rel * tf[t] / max(tf.values())
        score[t] = t_rel * math.log(math.log(3 + statistics.median(sents))) / (
            max(cap, acr) / (1 + math.log(tf[t])) + tf[t] / (mean + sd) / t_rel + len(sents) / len(sentences) / t_rel)
    out = {t: s / (tf[t] * (1 + s)) for t, s in score.items()}
    if longest == 2:
        pairs = Counter((a, b) for s in low for a, b in zip(s, s[1:]) if ok(a) and ok(b))
        out |= {f"{a} {b}": score[a] * score[b] / (c * (1 + score[a] + score[b])) for (a, b), c in pairs.items()}
    return [t for t, _ in sorted(out.items(), key=lambda x: (round(x[1], 9), x[0]))]


TALK = ["Solar Power is the future of Berlin Energy", "the BTC price and solar power prices rise", "Berlin sells solar power to the BTC miners",
        "nobody in Berlin doubts the future of energy"]


def test_term_scores_match_the_published_formula(spark):
    df = spark.createDataFrame([(1, ". ".join(TALK) + "."), (2, None), (3, ""), (4, "?? !!"), (5, ". ".join(reversed(TALK)) + ".")], "doc_id long, text string")
    for window in (1, 2, 7):
        for longest, stats in ((1, K.unigram_stats), (2, K.bigram_stats)):
            rows = sorted((r.doc_id, r["rank"], r.term) for r in stats(df, "doc_id", "text", window, None).collect())
            assert [t for d, _, t in rows if d == 1] == _yake(TALK, window, longest)
            assert [t for d, _, t in rows if d == 5] == _yake(list(reversed(TALK)), window, longest)
            assert {d for d, *_ in rows} == {1, 5}


def test_semantic_candidates_enter_before_the_noise_filter(spark):
    from postlens.operators import termgraph as G
    import hashlib
    other = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:7].translate(str.maketrans("0123456789", "ghijklmnop")) + "." for i in range(40))
    text = "Grid operators plan. " + "Photovoltaic photovoltaics photovoltaically grown. " * 5 + other
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    near = {r.doc_id: [x.term for x in r.similar] for r in G.candidates(df, "doc_id", "text", similar=(5, 0.175)).collect()}
    assert near[2] == near[3] == [] and set(near[1][:2]) <= {"photovoltaic", "photovoltaics", "photovoltaically"} and len(near[1]) <= 5
    kws = {r.doc_id: r.keywords for r in K.extract_keywords(df, "doc_id", "text").collect()}
    assert set(near[1]) <= set(kws[1]) and kws[2] == kws[3] == []


def test_keyword_chain_has_no_shuffle_and_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "Solar $BTC rises. U.S.A. today"), (1, "Solar"), (None, "Moon landing of NASA")], "doc_id long, text string")
    out = K.extract_keywords(df, "doc_id", "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "1", "None"]
    assert {"$BTC", "$btc"} & set(out.where("size(keywords) > 3").first().keywords)


def test_many_documents_of_one_batch_are_the_same_as_alone(spark, monkeypatch):
    from postlens.operators import termgraph as G
    rows = [(i, ". ".join(TALK[: i % 5]) + "." * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    together = {r.doc_id: (r.a, r.similar) for r in G.candidates(df.coalesce(1), "doc_id", "text", {"a": (7, 2)}, (5, 0.1)).collect()}
    monkeypatch.setattr(G, "_WORDS", 1)
    alone = {r.doc_id: (r.a, r.similar) for r in G.candidates(df.coalesce(1), "doc_id", "text", {"a": (7, 2)}, (5, 0.1)).collect()}
    assert together == alone


def test_chunks_that_reach_the_gate_and_items_without_chunk(spark):
    small = " ".join(f"Sentence number {i} has some words in it." for i in range(100))
    long_one = " ".join(f"w{i}" for i in range(600)) + "."
    rows = [(1, "short"), (2, small), (3, small + " " + long_one + " " + small), (4, "ab. " * 600), (5, long_one + " " + small),
            (6, "! " * 240 + "?" * 10), (7, None), (8, ""), (9, ". " * 245 + "." * 10)]
    df = spark.createDataFrame(rows, "item_id long, content string")
    report = {r.item_id: (r.n_chunks, r.n_oversize, r.n_strict, r.status) for r in chunking.chunk_report(df).collect()}
    assert set(report) == set(range(1, 10))
    assert report[1] == report[7] == report[8] == (1, 0, 1, "whole")
    assert report[2][1:] == (0, report[2][0], "split") and report[4] == (0, 0, 0, "no_chunk")
    assert report[3][1] == 1 and 0 < report[3][2] < report[3][0] and report[3][3] == "cut"
    assert report[5][1] == 1 and report[5][2] < report[5][0] and report[5][3] == "cut"
    for strict, n in ((False, 0), (True, 2)):
        got = {}
        for r in chunking.chunk_items(df, strict_prefix=strict).collect():
            got.setdefault(r.item_id, []).append(r.chunk_no)
        for i, want in report.items():
            assert sorted(got.get(i, [])) == list(range(want[n]))


def test_detect_language_sums_logarithms(spark):
    import math
    train = [(1, "the cat and the hat", "en"), (2, "le chat et le chapeau", "fr"), (3, "der hund und die katze", "de"), (4, "zzz zzz zzz", None)]
    ask = [(1, "the chat"), (1, "and"), (2, "die katze und le chat"), (3, "qqqqqq"), (4, None), (5, "ab"), (None, "le chapeau"), (6, "the the qqq")]
    schema = "doc_id long, text string"
    prof = chunking.train_language_profiles(spark.createDataFrame(train, schema + ", lang string"), "text", "lang")
    got = {r.doc_id: r.detected for r in chunking.detect_language(spark.createDataFrame(ask, schema), "doc_id", "text", prof).collect() if r.doc_id}
    grams = lambda t: [t[i:i + 3] for i in range(len(t) - 2)]
    count = {lang: {} for _, _, lang in train if lang}
    for _, t, lang in train:
        for g in grams(t) if lang else []:
            count[lang][g] = count[lang].get(g, 0) + 1
    v = len({g for c in count.values() for g in c})

    def best(texts):
        gs = [g for t in texts if t for g in grams(t)]
        if not any(g in c for g in gs for c in count.values()):
            return None
        return max(sorted(count), key=lambda x: sum(math.log((count[x].get(g, 0) + 1) / (sum(count[x].values()) + v)) for g in gs))
    assert got == {k: best([t for i, t in ask if i == k]) for k in range(1, 7)}


def test_noise_filter_and_url_rule_run_once_a_row(spark):
    """A rule that is computed for a filter and again for its result costs twice; plain words need none of it."""
    c = spark.createDataFrame([(1, 0, "word"), (1, 1, "word"), (1, 2, "word\n"), (None, 0, "é-bc"), (1, 3, "a1"), (1, 4, None)], "doc_id long, pos long, kw string")
    got = {(r.doc_id, r.pos, r.kw) for r in K.noise_filter(c).collect()}
    assert got == {(1, 0, "word")}
    for made, rule in ((K.noise_filter(c), "^[A-Za-z]+"), (K.drop_invalid(c), "https?://")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count(rule) == 1


def test_strict_prefix_of_texts_with_and_without_a_split(spark):
    """Against the rule piece by piece: whole texts at and over the gate, split ones with a large piece first, later or never."""
    long, short = " ".join(["w"] * 520), " ".join(["word"] * 200)
    texts = [None, "", "one two", " ".join(["w"] * 100), long + ".", ". ".join([short] * 4), short + ". " + long + ". " + short, long + ". " + short]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, content string")
    every, strict = ({}, {})
    for out, flag in ((every, False), (strict, True)):
        for r in chunking.chunk_items(df, strict_prefix=flag).withColumn("n", chunking.token_count("content")).orderBy("item_id", "chunk_no").collect():
            out.setdefault(r.item_id, []).append((r.content, r.n))
    for i, pieces in every.items():
        big = [k for k, (_, n) in enumerate(pieces) if n >= chunking.TOKEN_GATE]
        assert strict.get(i, []) == (pieces[:big[0]] if big else pieces)
    plan = chunking.chunk_items(df, strict_prefix=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(content") == plan.count("regexp_replace(content") == 1


def test_detect_language_meets_one_row_a_trigram(spark, monkeypatch):
    """Weights as columns and as rows give the same languages: repeated and null ids, texts of no known trigram, ties."""
    train = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("chat chat", None), (None, "en"), ("zz", "xx")]
    prof = chunking.train_language_profiles(spark.createDataFrame(train, "text string, lang string"), "text", "lang")
    ask = spark.createDataFrame([(1, "the dog"), (1, "und die"), (2, "chien"), (3, "QQQQ"), (4, None), (5, "ab"), (None, "the"), (6, "Katze\nund"), (7, "cha")], "doc_id long, text string")

    def found():
        return sorted(((r.doc_id, r.detected) for r in chunking.detect_language(ask, "doc_id", "text", prof).collect()), key=str)
    plan = chunking.detect_language(ask, "doc_id", "text", prof)._jdf.queryExecution().optimizedPlan().toString()
    wide = found()
    monkeypatch.setattr(chunking, "MAX_WIDE_LANGUAGES", 0)
    assert wide == found() and dict(wide)[2] == "fr" and dict(wide)[3] is None
    assert "map_from_entries" not in plan


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _greedy(terms, threshold):
    """The terms that stay, one after another against all better ones."""
    out = []
    for b in terms:
        for a in out:
            longer = max(len(a), len(b))
            near = longer > int(1 / (1 - threshold)) and abs(len(a) - len(b)) < longer * (1 - threshold)
            if 1.0 - _levenshtein(a, b) / longer > threshold if near else a == b:
                break
        else:
            out.append(b)
    return out


def _similar_terms(n, seed):
    import random
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        t = list(rng.choice(out)) if out and rng.random() < 0.7 else [rng.choice("abé😀") for _ in range(rng.choice([1, 3, 9, 10, 11, 12, 19, 20, 21, 25, 31, 45]))]
        for _ in range(rng.randrange(4) if out else 0):
            k = rng.randrange(len(t) + 1)
            t[k:k + rng.randrange(2)] = rng.choice([[], ["x"], ["b"]])
        out.append("".join(t) or "a")
    return out


def test_near_dup_is_the_greedy_rule_without_a_join(spark):
    lists = {d: _similar_terms(90, d) for d in range(12)}
    rows = [(d, t, k + 1) for d, ts in lists.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows + [(None, "lone", 1), (50, None, 1), (50, "some", None), (50, "same", 2), (50, "same", 2), (50, "same", 3)],
                               "doc_id long, term string, rank int")
    for threshold, top in ((0.9, None), (0.9, 7), (0.8, None)):
        out = K.near_dup(df, threshold=threshold, top=top)
        got = {}
        for r in out.orderBy("doc_id", "rank").collect():
            got.setdefault(r.doc_id, []).append((r.term, r["rank"]))
        assert got.pop(50) == [("same", 2), ("same", 2)]
        assert got == {d: [(t, ts.index(t) + 1) for t in _greedy(ts, threshold)[:top]] for d, ts in lists.items()}
        more = K.near_dup(df.withColumn("tf", F.lit(3)), threshold=threshold, top=top)
        assert more.columns == ["doc_id", "term", "rank", "tf"] and sorted(more.drop("tf").collect()) == sorted(out.collect())
    plan = K.near_dup(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "levenshtein" not in plan


def test_best_terms_are_those_of_the_whole_lists(spark, monkeypatch):
    from postlens.operators import termgraph as G
    near = "internationalisation internationalization internationalisations internationalizations "
    texts = [". ".join(TALK), near * 3 + "of " + near, None, "", " ".join(_similar_terms(80, 3)) + ". " + " of ".join(_similar_terms(60, 4)), "? !"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (4, 1):
        monkeypatch.setattr(G, "_HEAD", head)
        for window, longest, top in ((1, 1, 20), (7, 2, 10), (1, 1, 2)):
            for r in G.candidates(df, "doc_id", "text", {"all": (window, longest)}, None, {"best": (window, longest, top, 0.9)}).collect():
                assert r.best == _greedy([x.term for x in r.all], 0.9)[:top]
    plan = K.extract_keywords(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan


def test_unfiltered_candidates_of_the_chain_are_those_of_the_operators(spark):
    import random
    rng = random.Random(5)
    bits = ["$", "$BTC", "a$b", "S&P500", "U.S.", "NASA", "\U0001D400x", "É-É", "word", "Word,", ",A", "(AB/c)", " ", "  ", "\n", "\n\n", "\t", "\r\n", "A", "$,.", "x", "\u00a0", "aB"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for rule in (K.tickers, K.special_tokens, K.acronyms):
        c = rule(df, "doc_id", "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "kw")
        for r in K.case_expand(K.drop_invalid(K.split_joined(c))).collect():
            want.setdefault(r.doc_id, set()).add(r.kw)
    plain = {r.doc_id: r.best + [x.term for x in r.similar] for r in K.candidates(
        df, "doc_id", "text", None, (5, 0.175), {"best": (1, 1, 20, 0.9)}).collect()}
    for r in K.extract_keywords(df, "doc_id", "text").collect():
        assert want.get(r.doc_id, set()) <= set(r.keywords)
        assert all(k.lower() == k and k.isalpha() or " " in k or k in want.get(r.doc_id, ()) or k in plain[r.doc_id] for k in r.keywords)
