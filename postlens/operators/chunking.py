"""Text preparation, token counts, sentence splitting, paragraph packing,
chunking, language detection and translation routing (§2.2).

Everything per document stays inside the document's row: sentences and
paragraphs are arrays built and folded with higher-order functions
(``split``/``filter``/``aggregate``), so chunking needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import py_strip
from postlens.session import checkpoint_dir

# Gates of the reference (token gate 500, paragraph size 500,
# minimum sentence/paragraph length 5 characters, excluded).
TOKEN_GATE = 500
PARAGRAPH_TOKENS = 500
MIN_PIECE_CHARS = 5

# Default tokenizer: runs of letters/digits, or single other non-space characters.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
SENT_MARK = "\u0001"
#: Largest profile table (a language and trigram each) that is sent to every executor.
MAX_BROADCAST_PROFILE = 100_000
#: Languages whose weights are columns of one row a trigram; with more of them a row a language and trigram is joined.
MAX_WIDE_LANGUAGES = 100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Drop '#', literal ``\\uXXXX`` escapes and words (split on single spaces)
    starting with '@' or 'http'; strip.  (Defined but not called by the
    reference pipeline; offered as an operator.)"""
    x = F.regexp_replace(F.replace(_c(c), F.lit("#"), F.lit("")), r"\\u[0-9a-fA-F]{4}", "")
    words = F.filter(F.split(x, " "), lambda w: ~(w.startswith("@") | w.startswith("http")))
    return py_strip(F.array_join(words, " "))


def token_count(c, tokenizer: str | Callable | None = None) -> Column:
    """Tokens per text; null text counts 0.

    Default: the regex tokenizer above, JVM-side.  ``tokenizer`` may be a
    function ``str -> int`` (for example a BPE encoder) applied through a
    pandas UDF (Arrow batches)."""
    if tokenizer is None or tokenizer == "regex":
        return F.coalesce(F.regexp_count(_c(c), F.lit(TOKEN_PATTERN)), F.lit(0))
    fn = tokenizer

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return 0 if x is None else int(fn(x))
            except Exception:  # noqa: BLE001 - the reference counts failures as 0
                return 0
        return s.map(one).astype("int64")
    return _count(_c(c))


def route_oversize(df: DataFrame, text: str, token_limit: int = TOKEN_GATE, char_limit: int = PARAGRAPH_TOKENS
                   ) -> DataFrame:
    """Flags: ``too_big`` (tokens >= limit: the split gate) and ``split_by_chars``
    (characters > limit: the splitter's own gate).  Both are kept (they differ)."""
    return (df.withColumn("n_tokens", token_count(text))
            .withColumn("too_big", F.col("n_tokens") >= token_limit)
            .withColumn("split_by_chars", F.coalesce(F.length(text) > char_limit, F.lit(False))))


def sentences(c, splitter: Callable | None = None) -> Column:
    """Ordered sentences of a text: a break after '.', '!' or '?' followed by
    whitespace, and at newlines; pieces of 5 characters or less are dropped.
    ``splitter`` (``str -> list[str]``) replaces the rule through a pandas UDF."""
    if splitter is not None:
        fn = splitter

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def _split(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [p for p in (fn(x) if x else []) if p and len(p) > MIN_PIECE_CHARS])
        return _split(_c(c))
    marked = F.regexp_replace(_c(c), r"([.!?])[ \t\r\n]+|\n+", "$1" + SENT_MARK)
    parts = F.transform(F.split(marked, SENT_MARK), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) > MIN_PIECE_CHARS)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: ``key, sent_no, sentence``."""
    return df.select(key, F.posexplode(sentences(text)).alias("sent_no", "sentence"))


def paragraphs(sents: Column, size: int = PARAGRAPH_TOKENS) -> Column:
    """Greedy packing of sentences into paragraphs of at most ``size`` tokens:
    flush when ``tokens + next > size`` (a sentence is never split); newlines
    are removed inside sentences; pieces of 5 characters or less are dropped."""
    st = T.StructType([T.StructField("paras", T.ArrayType(T.StringType())),
                       T.StructField("cur", T.ArrayType(T.StringType())),
                       T.StructField("tok", T.LongType())])
    init = F.struct(F.array().cast("array<string>").alias("paras"), F.array().cast("array<string>").alias("cur"),
                    F.lit(0).cast("long").alias("tok")).cast(st)

    def step(acc, x):
        s, t = x["s"], x["t"]
        flush = acc["tok"] + t > size
        return F.struct(
            F.when(flush, F.concat(acc["paras"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["paras"])
            .alias("paras"),
            F.when(flush, F.array(s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
            F.when(flush, t).otherwise(acc["tok"] + t).alias("tok"))

    def finish(acc):
        last = F.when(F.size(acc["cur"]) > 0, F.array(F.array_join(acc["cur"], " "))).otherwise(
            F.array().cast("array<string>"))
        return F.filter(F.concat(acc["paras"], last), lambda p: F.length(p) > MIN_PIECE_CHARS)

    plain = F.transform(sents, lambda s: F.replace(s, F.lit("\n"), F.lit("")))
    counted = F.transform(plain, lambda s: F.struct(s.alias("s"), F.regexp_count(s, F.lit(TOKEN_PATTERN)).cast("long").alias("t")))
    return F.aggregate(counted, init, step, finish)  # a sentence is counted once, not at each use in a step


def pack_paragraphs(df: DataFrame, key: str, text: str, size: int = PARAGRAPH_TOKENS) -> DataFrame:
    """One row per paragraph: ``key, para_no, paragraph``."""
    return df.select(key, F.posexplode(paragraphs(sentences(text), size)).alias("para_no", "paragraph"))


CHUNK_KEEP = ["content", "author", "created_at", "domain", "url"]


def _with_pieces(items: DataFrame, content: str, token_limit: int, max_token_count: int) -> DataFrame:
    """Tokens (``_tokens``, counted once), whether a text is split (``_split``), and its ``_pieces`` (a text that is not split is one piece)."""
    def once(c: Column, name: str) -> Column:  # the optimizer would put a plain column's expression at each of its uses
        return F.explode(F.array(c)).alias(name)
    x = items.select("*", once(token_count(content), "_tokens"))
    x = x.withColumn("_split", (F.col("_tokens") >= token_limit) & (F.length(content) > max_token_count))
    return x.select("*", once(F.when(F.col("_split"), paragraphs(sentences(content), max_token_count)).otherwise(F.array(F.col(content))), "_pieces"))


def _small_prefix(token_limit: int) -> Column:
    """The ``_pieces`` before the first one of ``token_limit`` tokens or more; only pieces of a split text are counted again."""
    pieces = F.col("_pieces")
    first = F.array_position(F.transform(pieces, lambda p: token_count(p) >= token_limit), F.lit(True))
    split = F.transform(F.array(first), lambda f: F.when(f > 0, F.slice(pieces, F.lit(1), (f - 1).cast("int"))).otherwise(pieces))
    return F.when(F.col("_split"), F.get(split, F.lit(0))).when(F.col("_tokens") >= token_limit, F.slice(pieces, 1, 0)).otherwise(pieces)


def chunk_items(items: DataFrame, key: str = "item_id", content: str = "content",
                token_limit: int = TOKEN_GATE, max_token_count: int = PARAGRAPH_TOKENS,
                strict_prefix: bool = False) -> DataFrame:
    """Items -> chunk rows ``(key, chunk_no, ...)``.  Items under the token gate
    pass whole (all fields); bigger items whose text is longer than
    ``max_token_count`` characters become paragraphs that keep only content,
    author, created_at, domain and url.  No union, no shuffle: one explode.

    A piece may itself reach the token gate (one long sentence, or a big text of few characters):
    it is kept, unless ``strict_prefix`` is set, which keeps an item's pieces up to the first such
    one only.  Items that are left without a chunk are listed by :func:`chunk_report`."""
    x = _with_pieces(items, content, token_limit, max_token_count)
    if strict_prefix:
        x = x.withColumn("_pieces", _small_prefix(token_limit))
    x = x.select("*", F.posexplode("_pieces").alias("chunk_no", "_piece")).drop("_pieces", "_tokens")
    dropped = [c for c in items.columns if c not in CHUNK_KEEP and c != key]
    x = x.withColumn(content, F.col("_piece"))
    for c in dropped:
        x = x.withColumn(c, F.when(F.col("_split"), F.lit(None).cast(items.schema[c].dataType)).otherwise(F.col(c)))
    return x.drop("_piece").withColumnRenamed("_split", "was_split")


def chunk_report(items: DataFrame, key: str = "item_id", content: str = "content",
                 token_limit: int = TOKEN_GATE, max_token_count: int = PARAGRAPH_TOKENS) -> DataFrame:
    """What :func:`chunk_items` makes of every item: ``(key, n_chunks, n_oversize, n_strict, status)``.

    ``n_oversize`` counts chunks of ``token_limit`` tokens or more, ``n_strict`` the chunks left under
    ``strict_prefix``.  ``status`` is ``whole``, ``split``, ``cut`` (whole or split, but the strict form loses
    chunks) or ``no_chunk`` (only pieces of 5 characters or fewer: the item has no chunk at all)."""
    x = _with_pieces(items.select(key, content), content, token_limit, max_token_count)
    x = x.select(key, "_split", F.size("_pieces").cast("long").alias("n_chunks"),
                 F.size(F.filter("_pieces", lambda p: token_count(p) >= token_limit)).cast("long").alias("n_oversize"),
                 F.size(_small_prefix(token_limit)).cast("long").alias("n_strict"))
    return x.withColumn("status", F.when(F.col("n_chunks") == 0, "no_chunk").when(F.col("n_strict") < F.col("n_chunks"), "cut")
                        .when(F.col("_split"), "split").otherwise("whole")).drop("_split")


def normalise_for_grams(c) -> Column:
    return F.lower(F.regexp_replace(_c(c), "\n", " "))


def char_trigrams(col: str) -> Column:
    """All overlapping character trigrams of a normalised text column, in one
    regex pass (a zero-width lookahead captures each window); per-position
    ``substring`` would rescan the UTF-8 bytes for every position."""
    return F.regexp_extract_all(F.col(col), F.lit("(?s)(?=(.{3}))"), 1)


def _grams(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Occurrences ``(by, gram, n)`` of character trigrams, counted before they are shuffled."""
    return (docs.select(F.col(by).alias(by), normalise_for_grams(text).alias("_t"))
            .select(by, F.explode(char_trigrams("_t")).alias("gram")).where(F.length("gram") == 3)
            .groupBy(by, "gram").agg(F.count(F.lit(1)).alias("n")))


def train_language_profiles(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Every character trigram of every language with its occurrences ``(lang, gram, n)``,
    from labelled texts; rows without a label are left out."""
    return _grams(docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("_x")), "lang", "_x")


#: Logarithms are summed as whole numbers of this unit, so that the sum does not depend on the order.
LOG_UNIT = 1_000_000


def _ln(c: Column) -> Column:
    return F.round(F.log(c.cast("double")) * LOG_UNIT).cast("long")


def detect_language(docs: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """Best language per text: the greatest sum of ``log p`` over all its trigram occurrences,
    ``p = (n + 1) / (N + V)`` (``n`` of the trigram and ``N`` of all trigrams in the language, ``V``
    different trigrams in all).  Ties go to the smallest code; null for a text of which no language
    knows a trigram.  Rows of one id are one text; rows without an id get null.

    As ``log p = log(n + 1) - log(N + V)``, only trigrams that a language knows are joined and the
    rest is a figure a language and text length.  The profile is computed once and counted; up to
    ``MAX_BROADCAST_PROFILE`` rows it is sent to the executors, so that only aggregates
    per text leave the map side.  Beyond that the join is the planner's.  Up to ``MAX_WIDE_LANGUAGES``
    languages are joined as one row a trigram, so that a trigram meets one row and not one a language."""
    checkpoint_dir(docs.sparkSession)
    profiles = profiles.select("lang", "gram", "n").checkpoint()
    per_lang = profiles.groupBy("lang").agg(F.sum("n").alias("_all"))
    vocabulary = profiles.select("gram").distinct().count()
    floor = per_lang.select("lang", _ln(F.col("_all") + vocabulary).alias("floor"))
    known = profiles.select("lang", "gram", _ln(F.col("n") + 1).alias("w"))
    first = floor.orderBy("lang").take(MAX_WIDE_LANGUAGES + 1)
    wide = 0 < len(first) <= MAX_WIDE_LANGUAGES
    if wide:
        known = known.groupBy("gram").agg(*[F.sum(F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.col("w"))).alias(f"w{i}")
                                            for i, r in enumerate(first)])
    if profiles.count() <= MAX_BROADCAST_PROFILE:
        known = F.broadcast(known)
    norm = docs.select(key, normalise_for_grams(text).alias("_t"))
    grams = norm.select(key, F.explode(char_trigrams("_t")).alias("gram")).where(F.length("gram") == 3)
    if wide:
        # every trigram is counted, so the lengths need no second pass
        sums = grams.join(known.withColumn("met", F.lit(True)), "gram", "left").groupBy(key).agg(
            F.count(F.lit(1)).alias("n"), F.count("met").alias("met"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(first))])
        losses = F.array(*[F.struct((F.col("n") * r["floor"] - F.coalesce(f"w{i}", F.lit(0))).alias("loss"), F.lit(r["lang"]).alias("lang"))
                           for i, r in enumerate(first)])
        best = sums.where(F.col("met") > 0).select(key, F.array_min(losses)["lang"].alias("detected"))
        return docs.select(key).join(best, key, "left")
    sums = grams.join(known, "gram").groupBy(key, "lang").agg(F.sum("w").alias("w"))
    length = norm.groupBy(key).agg(F.sum(F.greatest(F.length("_t") - 2, F.lit(0))).alias("n"))
    # a language that knows no trigram of a text has the sum 0 there, beside those that know one
    langs = floor.agg(F.collect_list(F.struct("lang", "floor"))).scalar()
    met = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "w"))).alias("met"))
    loss = F.transform(F.col("langs"), lambda x: F.struct(
        (F.col("n") * x["floor"] - F.coalesce(F.try_element_at("met", x["lang"]), F.lit(0))).alias("loss"), x["lang"].alias("lang")))
    best = (met.join(length, key).withColumn("langs", langs)
            .select(key, F.array_min(loss)["lang"].alias("detected")))
    return docs.select(key).join(best, key, "left")


def _translated(fn: Callable[[pd.DataFrame], pd.Series], ask: pd.DataFrame) -> pd.Series:
    """``fn`` over a batch; if the batch fails, over its halves, so that only the rows that
    fail by themselves stay without a translation (null)."""
    try:
        return pd.Series(list(fn(ask)), index=ask.index, dtype=object)
    except Exception:  # noqa: BLE001 - a translator may fail in any way; the source text is kept
        if len(ask) == 1:
            return pd.Series([None], index=ask.index, dtype=object)
        half = len(ask) // 2
        return pd.concat([_translated(fn, ask.iloc[:half]), _translated(fn, ask.iloc[half:])])


def route_translation(df: DataFrame, content: str, title: str, lang: str,
                      fn: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Text = content else title; English passes; other languages go to the
    translator ``fn`` (a pandas function over batches with ``text`` and
    ``language`` columns, run with ``mapInPandas``).  Without a translator, for a null
    text, or for a row that it fails on, the source text is kept and ``translated`` is false.  The
    '▁' word marker of subword translators is replaced by a space."""
    text = F.coalesce(F.nullif(F.col(content), F.lit("")), F.nullif(F.col(title), F.lit("")))
    x = df.withColumn("text", text).withColumn("route", F.when(F.col(lang) == "en", "passthrough")
                                              .otherwise("translate"))
    if fn is None:
        return x.withColumn("translation", F.col("text")).withColumn("translated", F.lit(False))
    out_schema = T.StructType(x.schema.fields + [T.StructField("translation", T.StringType()),
                                                 T.StructField("translated", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["translation"] = pdf["text"]
            pdf["translated"] = False
            todo = pdf["route"] == "translate"
            ask = pdf.loc[todo & pdf["text"].notna(), ["text", lang]].rename(columns={lang: "language"})
            done = _translated(fn, ask) if len(ask) else pd.Series(dtype=object)
            done = done[done.notna()]
            pdf.loc[done.index, "translation"] = done.map(lambda t: str(t).replace("▁", " "))
            pdf.loc[done.index, "translated"] = True
            yield pdf
    return x.mapInPandas(run, schema=out_schema)
