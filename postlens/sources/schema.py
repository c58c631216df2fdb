"""Schema of items, analyses and batch documents (strict, nested, fixed).

The item struct is the union of the fields of the protocol model and of the
JSON schema (``raw_content``/``translated_content`` exist only in the model,
``location`` only in the schema); ``external_id`` is nullable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field lists of the analysis families, in the reference's order.
EMOTIONS = ["love", "admiration", "joy", "approval", "caring", "excitement", "gratitude", "desire", "anger",
            "optimism", "disapproval", "grief", "annoyance", "pride", "curiosity", "neutral", "disgust",
            "disappointment", "realization", "fear", "relief", "confusion", "remorse", "embarrassment",
            "surprise", "sadness", "nervousness"]
TEXT_TYPES = ["assumption", "anecdote", "none", "definition", "testimony", "other", "study"]
AGES = ["below_twenty", "twenty_thirty", "thirty_forty", "forty_more"]
GENDERS = ["male", "female"]
IRONY = ["irony", "non_irony"]
BATCH_KINDS = ["SPOTTING", "VALIDATION"]

# Patterns of the JSON schema (the '.' before the fraction is unescaped there).
ISO_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(.[0-9]{1,6})?Z$"
URL_PATTERN = (r"^https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,32}\b"
               r"(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)$")

ITEM_FIELDS = ["created_at", "title", "raw_content", "translated_content", "summary", "picture", "author",
               "username", "userprofile_url", "location", "external_id", "external_parent_id", "domain", "url",
               "language"]
ITEM_REQUIRED = ["created_at", "language", "domain", "url"]
ANALYSIS_REQUIRED = ["classification", "language_score", "sentiment", "embedding", "gender", "source_type",
                     "text_type", "emotion", "irony", "age", "top_keywords"]
PROCESSED_REQUIRED = ["item", "analysis", "collection_client_version", "collection_module", "collected_at"]


def _doubles(names):
    return T.StructType([T.StructField(n, T.DoubleType(), True) for n in names])


ITEM = T.StructType([T.StructField(n, T.StringType(), True) for n in ITEM_FIELDS])
CLASSIFICATION = T.StructType([T.StructField("label", T.StringType(), True),
                               T.StructField("score", T.DoubleType(), True)])
ANALYSIS = T.StructType([
    T.StructField("classification", CLASSIFICATION, True),
    T.StructField("top_keywords", T.ArrayType(T.StringType()), True),
    T.StructField("language_score", T.DoubleType(), True),
    T.StructField("sentiment", T.DoubleType(), True),
    T.StructField("embedding", T.ArrayType(T.DoubleType()), True),
    T.StructField("gender", _doubles(GENDERS), True),
    T.StructField("source_type", T.StringType(), True),
    T.StructField("text_type", _doubles(TEXT_TYPES), True),
    T.StructField("emotion", _doubles(EMOTIONS), True),
    T.StructField("irony", _doubles(IRONY), True),
    T.StructField("age", _doubles(AGES), True),
])
PROCESSED = T.StructType([
    T.StructField("item", ITEM, True),
    T.StructField("analysis", ANALYSIS, True),
    T.StructField("collection_client_version", T.StringType(), True),
    T.StructField("collection_module", T.StringType(), True),
    T.StructField("collected_at", T.StringType(), True),
])
BATCH = T.StructType([
    T.StructField("items", T.ArrayType(PROCESSED), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])
