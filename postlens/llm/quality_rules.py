"""Quality rules, line first, with DataFrame functions only.

Every line of a text is held against punctuation, navigation and boilerplate rules;
lines that fail go, and a document that loses too much of its text is rejected.
Everything happens inside the document's row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, replace_columns, text_or_empty

#: Symbols counted by n_symbols.
SYMBOLS = r"[#*$%&|<>]"
#: A line whose share of punctuation and symbols is larger fails.
MAX_PUNCTUATION = 0.2
#: A short line without an end of sentence fails if it holds menu words or separators.
MAX_NAVIGATION_WORDS = 12
NAVIGATION = (r"(?i)(?:[|»›•·]|(?:^|\s)(?:>|/|::)\s|(?:^|[^\p{L}])(?:home|next|previous|prev|menu|login|log in|sign in|sign up|"
              r"register|subscribe|share|tweet|search|contact us|about us|skip to content|back to top|read more)(?:[^\p{L}]|$))")
BOILERPLATE = (r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|uses cookies|"
               r"accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|lorem ipsum|"
               r"copyright (?:\(c\)|©|\d{4})|©\s*\d{4}|licensed under|powered by|click here|follow us on)")
#: A document that keeps a smaller share of its characters (white space aside) is rejected.
MIN_KEPT = 0.5


def line_fails(line: Column) -> Column:
    """True if a line (with at least one word) breaks a rule."""
    solid = F.regexp_replace(line, SPACE, "")
    marks = F.regexp_count(solid, F.lit(r"[^\p{L}\p{M}\p{N}]"))
    words = F.regexp_count(line, F.lit(WORD))
    punctuation = marks > MAX_PUNCTUATION * F.length(solid)
    navigation = ((words <= MAX_NAVIGATION_WORDS) & ~line.rlike(r"[.!?…\"”’)]\s*$") & line.rlike(NAVIGATION))
    # a boilerplate phrase condemns a short line only: in long prose it may be the subject
    boilerplate = (words <= 2 * MAX_NAVIGATION_WORDS) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def word_windows(words: Column, n: int = 5) -> Column:
    """64-bit hashes of all n-word windows of an array of words; null if it has fewer words."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))),
                                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])))


def _ranked(grams: Column) -> Column:
    """Windows by hash, if any hash repeats, else null."""
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams),
                  F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _covered(ranked: Column, n: int = 5) -> Column:
    """Words that lie in a window whose hash repeats."""
    again = F.transform(ranked, lambda e, k: F.when(
        (F.get(ranked, k - 1)["h"] == e["h"]) | (F.get(ranked, k + 1)["h"] == e["h"]), e["i"]))
    at = F.array_sort(F.filter(again, lambda x: x.isNotNull()))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, zero, lambda a, p: F.struct(
        (a["n"] + (p + n - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + n).alias("end")), lambda a: a["n"])


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and clean_text (the lines that pass, joined by newlines; null for a null text).

    base_failed: fewer than 10 words, or over 20 % of the words repeat.  kept: not
    base_failed, and the passing lines hold MIN_KEPT of the characters.  Null and empty
    texts have 0 words and fail.  Rows stand alone, so repeated rows get equal results.
    Columns named like the added ones are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    rest = [c for c in docs.columns if c not in names]
    t = F.col("_pl_t")
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns], text_or_empty(F.col(f"`{text}`")).alias("_pl_t"))
    df = df.select("*", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_pl_words"),
                   F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_pl_lines"))
    df = df.select("*", word_windows(F.col("_pl_words")).alias("_pl_grams"),
                   F.filter("_pl_lines", lambda x: ~line_fails(x)).alias("_pl_good"))
    df = df.select("*", _ranked(F.col("_pl_grams")).alias("_pl_ranked"))
    solid = F.length(F.regexp_replace(t, SPACE, "")).cast("long")
    new = {
        "n_words": F.size("_pl_words").cast("long"),
        "word_chars": solid,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_pl_lines") - F.size(F.array_distinct("_pl_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_covered(F.col("_pl_ranked")), F.lit(0).cast("long")),
    }
    df = df.select(*[F.col(f"`{c}`") for c in docs.columns], "_pl_good",
                   *[v.alias(f"_pl_{k}") for k, v in new.items()])
    n, rep = F.col("_pl_n_words"), F.col("_pl_n_repeat_words")
    failed = (n < 10) | (100 * rep > 20 * n)
    left = F.length(F.regexp_replace(F.array_join("_pl_good", ""), SPACE, ""))
    out = {k: F.col(f"_pl_{k}") for k in new} | {
        "base_failed": failed,
        "kept": ~failed & (left >= MIN_KEPT * F.col("_pl_word_chars")),
        "clean_text": F.when(F.col(f"`{text}`").isNotNull(), F.array_join("_pl_good", "\n")),
    }
    return df.select(*[F.col(f"`{c}`") for c in rest], *[out[k].alias(k) for k in names])
