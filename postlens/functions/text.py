"""Column expressions for text, URLs and timestamps (all JVM-side built-ins).

Regexes are written to mean the same in Java and RE2 (the oracle engine):
no look-behind, no back-references, explicit ASCII classes where Java and
Python disagree on ``\\w``/``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.sources.schema import ISO_PATTERN

# HTML entities decoded by pages_to_items.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
WS = "[ \t\r\n]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(c) -> Column:
    c = _c(c)
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_html(c) -> Column:
    """Visible text of an HTML page: scripts, styles and comments removed, then
    tags, then entities decoded and whitespace collapsed."""
    c = _c(c)
    c = F.regexp_replace(c, r"(?s)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?s)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    c = decode_entities(c)
    return F.trim(F.regexp_replace(c, WS, " "))


def html_title(c) -> Column:
    return F.trim(decode_entities(F.regexp_extract(_c(c), r"(?s)<title[^>]*>(.*?)</title>", 1)))


def html_lang(c) -> Column:
    return F.regexp_extract(_c(c), r"<html[^>]*[ ]lang=\"([^\"]+)\"", 1)


def url_host(c) -> Column:
    """Host part of a URL (``parse_url(url, 'HOST')``)."""
    return F.parse_url(_c(c), F.lit("HOST"))


def py_strip(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace (Spark ``trim`` only trims spaces)."""
    return F.regexp_replace(_c(c), r"^[ \t\r\n\x0b\x0c]+|[ \t\r\n\x0b\x0c]+$", "")


def is_iso(c) -> Column:
    return _c(c).rlike(ISO_PATTERN)


def format_iso(c) -> Column:
    """UTC timestamp -> ``yyyy-MM-ddTHH:mm:ss.ffffffZ`` (true UTC, unlike the reference's local time)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(c) -> Column:
    """ISO text -> timestamp (null when the pattern check fails or it does not parse)."""
    c = _c(c)
    body = F.regexp_replace(F.replace(c, F.lit("T"), F.lit(" ")), "Z$", "")
    return F.when(is_iso(c), F.try_to_timestamp(body).cast("timestamp_ntz"))


def sha1_text(c) -> Column:
    return F.sha1(F.encode(_c(c), "UTF-8"))
