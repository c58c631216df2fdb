"""Keyword extraction (§2.3).

Candidates are rows ``(doc_id, pos, kw)``; every rule of the reference chain
is a row filter or rewrite on them, and the final keyword set is
``sort_array(collect_set(kw))`` per document.  Statistical candidates use the
published YAKE features (term frequency, casing, sentence position and spread,
neighbour diversity), semantic ones the cosine of hashed embeddings; both come out of
one pass (:mod:`postlens.operators.termgraph`), near duplicates among them are dropped there too, and ``extract_keywords`` applies the
same rules to arrays inside the document's row, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.termgraph import candidates, stay_of_lists

MAX_KEYWORD_LENGTH = 100
NOISE_MAX_PERCENT = 20      # the code's threshold (its comment says 30 %)
UPPER_RATIO = 0.3
DEDUP_SIMILARITY = 0.9
SEMANTIC_THRESHOLD, SEMANTIC_TOP = 0.175, 5
# ASCII punctuation except '-', as a character class (any of them kills a candidate).
PUNCT_NO_HYPHEN = r"[!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~]"


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Space-split words with their position (the reference's ``text.split(" ")``)."""
    return df.select(key, F.posexplode(F.split(F.col(text), " ")).alias("pos", "kw"))


# ---- filters ---------------------------------------------------------------------------------

def noise_filter(c: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reference noise rule on statistical candidates: no ASCII punctuation but
    '-'; non-letters counted **before** trimming, length **after**; edge
    characters outside ``[A-Za-z0-9 ]`` trimmed (so accented letters go too);
    ``\\uXXXX`` removed; a letter required; at most 20 % non-letters; first-seen dedup."""
    return first_seen(c.select(key, "pos", _kept(_quiet(F.col("kw")))), key)


def _kept(kw: Column) -> Column:
    """The column ``kw`` without its nulls, computed once a row (a filter would compute it again)."""
    return F.explode(F.array_compact(F.array(kw))).alias("kw")


def _quiet(kw: Column) -> Column:
    """A candidate trimmed, or null if the noise rule drops it."""
    return F.when(kw.rlike(r"^[A-Za-z]+\z"), kw).otherwise(_quiet_marked(kw))  # most words: nothing to trim or count


def _quiet_marked(kw: Column) -> Column:
    special = F.length(F.regexp_replace(kw, r"\p{L}", ""))  # non-letters of the untrimmed word
    trimmed = F.regexp_replace(F.regexp_replace(kw, "^[^A-Za-z0-9 ]+|[^A-Za-z0-9 ]+$", ""), r"\\u[0-9a-fA-F]{4}", "")
    return F.when(~kw.rlike(PUNCT_NO_HYPHEN) & (F.length(trimmed) > 0) & (special * 100 <= NOISE_MAX_PERCENT * F.length(trimmed))
                  & trimmed.rlike(r"\p{L}"), trimmed)


def first_seen(c: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep the first occurrence of each keyword per document (an aggregate,
    combined map-side)."""
    return c.groupBy(key, "kw").agg(F.min("pos").alias("pos")).select(key, "pos", "kw")


def tickers(df: DataFrame, key: str, text: str) -> DataFrame:
    """'$' words: a space is put before every '$' and after every newline, the
    text is split on spaces, words starting with '$' (longer than 1) are kept
    without ',' and '.'."""
    w = df.select(key, F.posexplode(F.split(_spaced(F.col(text)), " ")).alias("pos", "kw"))
    return w.where(_is_ticker(F.col("kw"))).withColumn("kw", F.regexp_replace("kw", "[,.]", ""))


#: What a '$' begins in :func:`_spaced`, up to the next space, '$' or newline (which stays).
TICKER = r"\$[^ $\n]*+\n?"


def _spaced(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\n ")), F.lit("$"), F.lit(" $"))


def _is_ticker(kw: Column) -> Column:
    return kw.startswith("$") & (F.length(kw) > 1)


def _upper_ratio_ok(c: Column) -> Column:
    # upper / length >= 0.3, in integers (10 * upper >= 3 * length) so no engine rounds differently
    return F.regexp_count(c, F.lit(r"\p{Lu}")) * 10 >= F.length(c) * 3


TOKEN_EDGES = "^[.,;:!?\"'()\\[\\]{}]+|[.,;:!?\"'()\\[\\]{}]+$"


def special_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens with >= 30 % upper-case letters, a character outside word/space/comma,
    and more than one letter.  Tokenisation (a library tokenizer in the
    reference) is re-aimed as: split on whitespace, strip edge punctuation."""
    t = df.select(key, F.posexplode(F.split(F.col(text), r"[ \t\r\n]+")).alias("pos", "kw"))
    return t.withColumn("kw", F.regexp_replace("kw", TOKEN_EDGES, "")).where(_is_special(F.col("kw")))


def _is_special(kw: Column) -> Column:
    return ((F.length(kw) > 0) & _upper_ratio_ok(kw) & kw.rlike(r"[^\p{L}\p{N}_ \t\r\n,]")
            & (F.regexp_count(kw, F.lit(r"\p{L}")) > 1))


def acronyms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Space-split words longer than 1, without ',' and '.', with >= 30 % upper
    case, at least one letter and at least 2 characters."""
    w = words(df, key, text).where(F.length("kw") > 1).withColumn("kw", F.regexp_replace("kw", "[,.]", ""))
    return w.where(_is_acronym(F.col("kw")))


def _is_acronym(kw: Column) -> Column:
    return _upper_ratio_ok(kw) & kw.rlike(r"\p{L}") & (F.length(kw) >= 2)


MAX_PARTS = 1_000_000  # room for the parts of one keyword between the positions of two


def split_joined(c: DataFrame, key: str = "doc_id") -> DataFrame:
    """``A#B$C`` -> parts longer than 2 characters; a single part keeps the original."""
    return c.select(key, "pos", F.posexplode(_parts(F.col("kw"))).alias("_sub", "kw")).withColumn(
        "pos", F.col("pos").cast("long") * MAX_PARTS + F.col("_sub")).drop("_sub")


def _parts(kw: Column) -> Column:
    parts = F.filter(F.split(kw, "[$#]+"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.filter(parts, lambda p: F.length(p) > 2)).otherwise(F.array(kw))


def drop_invalid(c: DataFrame, key: str = "doc_id") -> DataFrame:
    """Remove '//' and URLs to the end of the line; keep 3..100 characters; first-seen dedup."""
    x = c.select(key, "pos", F.explode(F.array(_without_urls(F.col("kw")))).alias("kw"))  # computed once a row
    return first_seen(x.where(_is_valid(F.col("kw"))), key)


def _without_urls(kw: Column) -> Column:
    return F.regexp_replace(kw, r"//|https?://.*[\r\n]*", "")


def _is_valid(kw: Column) -> Column:
    return (F.length(kw) > 2) & (F.length(kw) <= MAX_KEYWORD_LENGTH)


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_lower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def case_expand(c: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fully upper -> itself and its lower form; otherwise not lower -> lower;
    lower stays; duplicates removed."""
    x = c.select(key, "pos", F.posexplode(_cases(F.col("kw"))).alias("_sub", "kw")).withColumn(
        "pos", F.col("pos").cast("long") * 2 + F.col("_sub")).drop("_sub")
    return first_seen(x, key)


def _cases(kw: Column) -> Column:
    return F.when(is_upper(kw), F.array(kw, F.lower(kw))).when(~is_lower(kw), F.array(F.lower(kw))).otherwise(F.array(kw))


# ---- statistical and semantic candidates -------------------------------------------------------

def _ranked(df: DataFrame, key: str, text: str, window: int, longest: int, top: int | None) -> DataFrame:
    got = candidates(df.select(key, text), key, text, {"terms": (window, longest)})
    terms = F.col("terms") if top is None else F.slice("terms", 1, top)
    return got.select(key, F.posexplode(terms).alias("_at", "_t")).select(
        key, "_t.*", (F.col("_at") + 1).alias("rank"))


def unigram_stats(df: DataFrame, key: str, text: str, window: int = 1, top: int | None = 20) -> DataFrame:
    """Per document and candidate term: features, published score (lower is better) and rank; the
    ``top`` best are kept, all of them with None.

    Features: tf; tf of capitalised (not sentence-initial) and of all-caps occurrences;
    median sentence index; distinct left/right neighbours within ``window`` over all such
    co-occurrences; share of sentences containing it.  With S the single-term score a term
    scores S / (tf (1 + S)).
    """
    return _ranked(df, key, text, window, 1, top)


def bigram_stats(df: DataFrame, key: str, text: str, window: int = 7, top: int | None = 10) -> DataFrame:
    """Candidates of up to two terms (adjacent words of a sentence, no stop word among them):
    two terms score ``S1 S2 / (tf (1 + S1 + S2))``, single ones as in :func:`unigram_stats`."""
    return _ranked(df, key, text, window, 2, top).select(key, "term", "tf", "score", "rank")


def near_dup(ranked: DataFrame, key: str = "doc_id", threshold: float = DEDUP_SIMILARITY, top: int | None = None) -> DataFrame:
    """Greedy removal in order of ``rank``: a term goes if it is more than ``threshold`` similar
    (``1 - levenshtein / max length``) to a better term of its document that stays; the first
    ``top`` that stay are returned with their ranks.  The ranked terms of one document are
    compared in one row of an Arrow batch (a document bounds them); null keys, ranks and terms
    are left out."""
    ranks = F.array_sort(F.collect_list(F.struct("rank", "term")))
    lists = ranked.where(F.col(key).isNotNull()).groupBy(key).agg(ranks.alias("_terms"))
    stays = stay_of_lists(lists, threshold, top)
    if len(ranked.columns) == 3:  # nothing but what the lists hold
        return stays.select(*ranked.columns)
    return ranked.join(stays, [key, "term", "rank"], "left_semi")


def semantic_candidates(cands: DataFrame, docs: DataFrame, key: str, cand: str, vec: str,
                        threshold: float = SEMANTIC_THRESHOLD, top: int = 5) -> DataFrame:
    """Candidates whose vector has cosine similarity above ``threshold`` with the
    document vector; the ``top`` most similar per document."""
    dv = docs.select(key, F.col(vec).alias("_dv"))
    j = cands.select(key, cand, vec).join(dv, key)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                           lambda s, v: s + v)
    sim = dot(F.col(vec), F.col("_dv")) / (F.sqrt(dot(F.col(vec), F.col(vec))) * F.sqrt(dot(F.col("_dv"), F.col("_dv"))))
    j = j.withColumn("similarity", sim).where(F.col("similarity") > threshold)
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), F.col(cand)))
    return j.withColumn("rank", r).where(F.col("rank") <= top).drop("_dv")


def extract_keywords(df: DataFrame, key: str, text: str) -> DataFrame:
    """The full chain: statistical candidates (1-gram top 20 and 2-gram top 10, near duplicates
    removed before the cut) and semantic ones (top 5 above the threshold) through the noise
    filter; tickers, special tokens and acronyms added unfiltered; joined tags split; invalid
    ones dropped; case expansion; one sorted distinct array per row of ``df``.

    Everything stays in the document's row.  Null and wordless texts have no keywords; rows of
    one key are rows of their own.
    """
    found = candidates(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", None,
                       (SEMANTIC_TOP, SEMANTIC_THRESHOLD), {"one": (1, 1, 20, DEDUP_SIMILARITY), "two": (7, 2, 10, DEDUP_SIMILARITY)})
    ranked = F.concat("one", F.transform("similar", lambda x: x["term"]), "two")
    stat = F.filter(F.transform(ranked, _quiet), lambda k: k.isNotNull())
    t = F.coalesce("text", F.lit(""))

    def no_marks(k: Column) -> Column:
        return F.regexp_replace(k, "[,.]", "")

    def upper(blank: str) -> Column:  # the words of a split at blanks that have an upper-case letter
        return F.regexp_extract_all(t, F.lit(rf"(?<![^{blank}])[^{blank}\p{{Lu}}]*+\p{{Lu}}[^{blank}]*+"), 0)

    extra = F.concat(
        F.transform(F.filter(F.regexp_extract_all(t, F.lit(TICKER), 0), _is_ticker), no_marks),
        F.filter(F.transform(upper(r" \t\r\n"), lambda k: F.regexp_replace(k, TOKEN_EDGES, "")), _is_special),
        F.filter(F.transform(F.filter(upper(" "), lambda k: F.length(k) > 1), no_marks), _is_acronym))
    found = found.select("key", stat.alias("stat"), extra.alias("extra"))
    parts = F.flatten(F.transform(F.array_distinct(F.concat("stat", "extra")), _parts))
    valid = F.filter(F.transform(parts, _without_urls), _is_valid)
    return found.select(F.col("key").alias(key), F.sort_array(F.array_distinct(F.flatten(F.transform(valid, _cases)))).alias("keywords"))
