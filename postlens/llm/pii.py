"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one pattern, validated (Luhn, calendar, number plan, octets),
and permuted by a keyed Feistel network inside their own format: digits stay digits,
separators stay in place, a card stays a valid card and a date a valid date.  The
permutation depends on key, kind and value alone, so equal values stay linked across
documents and different values of a format never meet.  E-mail addresses and secrets,
which have no numeric format, become keyed hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, replace_columns, text_or_empty

# labels are taken possessively, as a repeat that Java may take back needs stack for each of them
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-][A-Za-z0-9.-]*?\.[A-Za-z]{2})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = (r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?)"
          r"[A-Za-z0-9_+/.-]{8,}[\"']?")
PHONE = r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
# a card may stand beside a CVV, an expiry date or an order number: all digit groups up to the next
# other value are taken, and ``cards`` finds the cards among them (possessive: long runs need no stack)
_OTHER = "|".join([EMAIL, PHONE, SSN, DATE, IP])
_GROUPS = rf"\d++(?:-(?!{_OTHER})\d++)*+(?!\w|-(?!{_OTHER}))"
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_GROUPS}(?: (?!{_OTHER}){_GROUPS})*+"
#: Issuers' leading digits and lengths: of overlapping readings such a one is taken first.
ISSUED = (r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[068]\d{12}|35\d{14}|6(?:011|4|5)\d+|62\d{14,17})$")
PATTERN = "|".join([EMAIL, KEY_ID, SECRET, PHONE, SSN, DATE, IP, CARD])

FIRST_DAY, N_DAYS = "1900-01-01", 73049  # to 2099-12-31
ROUNDS = 8
WALK = 48  # steps of cycle walking; the chance that a value needs more is below 1e-9


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    said = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """Keyed Feistel permutation of 0 .. a * b - 1 (all longs)."""
    def step(s, i):
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + _hash(key, F.lit(kind), i, a, b, s["r"]) % a, a).alias("l"),
                                           s["r"].alias("r"))) \
                .otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _hash(key, F.lit(kind), i, a, b, s["l"]) % b, b).alias("r")))

    left = F.floor((x - F.pmod(x, b)).cast("decimal(20,0)") / b).cast("long")
    start = F.struct(left.alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _walk(x: Column, valid, one) -> Column:
    """Permute until the value is valid again: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), one(x), lambda s, _: F.when(valid(s), s).otherwise(one(s)))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """The characters of ``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    return let(digits, lambda d: F.aggregate(F.split(shape, ""), start, lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["o"], F.substr(d, s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k"))), lambda s: s["o"]))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is a check digit."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))


def card(d: Column, key: str) -> Column:
    """Digits of a valid card, permuted."""
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    n = F.length(body)
    half = F.floor(n / 2).cast("int")
    a = F.rpad(F.lit("1"), half + 1, F.lit("0")).cast("long")
    b = F.rpad(F.lit("1"), n - half + 1, F.lit("0")).cast("long")
    return let(F.lpad(permute(body.cast("long"), a, b, "card", key).cast("string"), n, F.lit("0")), lambda new: F.concat(
        new, ((10 - _luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10).cast("string")))


def readings(m: Column) -> Column:
    """The cards in a run of digit groups: (rank, short, i, j, at, d), groups i to j, digits ``d`` from place ``at`` on.

    A card is a number of whole neighbouring groups with 13 to 19 digits that passes Luhn.  Of
    readings that overlap, one that an issuer could give goes first, then the longest, then the first.
    """
    def valid(g):
        last = F.size(g) - 1
        spans = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(
            F.sequence(i, F.least(i + 18, last)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(g, i + 1, j - i + 1), "").alias("d")))))
        on = F.filter(spans, lambda w: F.length(w["d"]).between(13, 19) & (_luhn_sum(w["d"]) % 10 == 0))
        return F.array_sort(F.transform(on, lambda w: F.struct(
            F.when(w["d"].rlike(ISSUED), 0).otherwise(1).alias("rank"), (-F.length(w["d"])).alias("short"), w["i"].alias("i"), w["j"].alias("j"),
            F.length(F.array_join(F.slice(g, F.lit(1), w["i"]), "")).alias("at"), w["d"].alias("d"))))

    return let(F.split(m, "[ -]"), lambda g: let(valid(g), lambda ws: F.aggregate(ws, F.slice(ws, 1, 0), lambda acc, w: F.when(
        F.exists(acc, lambda x: (x["i"] <= w["j"]) & (w["i"] <= x["j"])), acc).otherwise(F.concat(acc, F.array(w))))))


def cards(m: Column, key: str) -> Column:
    """(new, n): a run of digit groups with its cards permuted, and their number; null without a card."""
    return let(readings(m), lambda ws: F.when(F.size(ws) > 0, F.struct(_refill(m, F.aggregate(
        ws, _digits(m), lambda s, w: F.overlay(s, card(w["d"], key), w["at"] + 1))).alias("new"), F.size(ws).alias("n"))))


def phone(m: Column, key: str) -> Column:
    d = _digits(m)
    lead = F.substr(d, F.lit(1), F.length(d) - 10)
    x = F.substr(d, F.length(d) - 9, F.lit(10)).cast("long")

    def valid(v):
        return (v >= 2_000_000_000) & (F.floor(v / 1_000_000).cast("long") % 10 >= 2)

    # a number outside the plan is permuted among such numbers, never among the valid ones
    new = let(x, lambda v: let(valid(v), lambda was: _walk(
        v, lambda y: valid(y) == was, lambda y: permute(y, _long(100_000), _long(100_000), "phone", key))))
    return _refill(m, F.concat(lead, F.lpad(new.cast("string"), 10, "0")))


def ssn(m: Column, key: str) -> Column:
    x = _digits(m).cast("long")

    def valid(v):
        area, group = F.floor(v / 1_000_000).cast("long"), F.floor(v / 10_000).cast("long") % 100
        return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (v % 10_000 > 0)

    new = let(x, lambda v: _walk(v, valid, lambda y: permute(y, _long(10_000), _long(100_000), "ssn", key)))
    return F.when(valid(x), _refill(m, F.lpad(new.cast("string"), 9, "0")))


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    x = F.aggregate(parts, _long(0), lambda a, p: a * 256 + p)
    out = let(permute(x, _long(65536), _long(65536), "ip", key), lambda y: F.concat_ws(
        ".", *[(F.shiftright(y, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda p: p < 256), out)


def slash_date(m: Column, key: str) -> Column:
    """31/12/1999 and 12/31/1999 are both in use, so one permutation runs over all strings that are
    a date in either order: different strings never meet."""
    p, q, year = (F.substr(m, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 2), (4, 2), (7, 4)))
    years = 200
    x = ((p - 1) * 31 + q - 1) * years + year - 1900

    def split(v):
        rest = F.floor(v / years).cast("long")
        return F.floor(rest / 31).cast("long") + 1, rest % 31 + 1, v % years + 1900

    def fits(day, month, of):
        leap = (of % 4 == 0) & ((of % 100 != 0) | (of % 400 == 0))
        return (month <= 12) & (day <= F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31))

    def valid(v):
        a, b, of = split(v)
        return fits(a, b, of) | fits(b, a, of)

    new = _walk(x, valid, lambda v: permute(v, _long(961), _long(years), "date slash", key))
    made = let(new, lambda v: F.concat_ws("/", *[F.lpad(n.cast("string"), w, "0") for n, w in zip(split(v), (2, 2, 4))]))
    return F.when(p.between(1, 31) & q.between(1, 31) & year.between(1900, 2099) & valid(x), made)


def date(m: Column, key: str) -> Column:
    out = F.when(m.rlike(r"^\d{2}/"), slash_date(m, key))
    for lead, fmt in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(fmt)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        ok = (day >= 0) & (day < N_DAYS)
        new = _walk(day, lambda v: v < N_DAYS, lambda v: permute(v, _long(271), _long(270), "date " + fmt, key))
        made = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), fmt)
        out = F.coalesce(out, F.when(m.rlike(lead) & ok, made))
    return out


def email(m: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def secret(m: Column, key: str) -> Column:
    lead = F.regexp_extract(m, r"^(.*?[=:]\s?[\"']?)", 1)
    tail = F.regexp_extract(m, r"([\"']?)$", 1)
    value = F.substr(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(tail))
    made = F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), F.ceil(F.length(value) / 64).cast("int"))
    return F.concat(lead, F.substr(made, F.lit(1), F.length(value)), tail)


def _kind(m: Column) -> Column:
    def whole(p):
        return m.rlike(f"^(?:{p})$")

    return (F.when(m.contains("@") & whole(EMAIL), "email").when(m.rlike("^[A-Za-z]"), "secret")
            .when(whole(PHONE), "phone").when(whole(SSN), "ssn").when(whole(DATE), "date")
            .when(whole(IP), "ip").otherwise("card"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every personal value in ``text`` replaced, and ``pii``: the kinds found, in order.

    Defined cases: null text stays null with an empty list; texts without personal data stay
    as they are; numbers that fail their validation (Luhn, calendar, octets, number plan of
    social security) are left alone; dates outside 1900-2099 too.  Rows stand alone: no shuffle, so
    repeated rows come out alike, an empty table stays empty, and texts of any length are read whole
    (no pattern takes stack per character).  A column ``pii`` of ``docs`` is replaced.
    """
    make = {"email": email, "secret": secret, "phone": phone, "ssn": ssn, "date": date, "ip": ip}

    def single(m: Column, kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for k, f in make.items():
            new = F.when(kind == k, f(m, key)).otherwise(new)
        return let(new, lambda v: F.when(v.isNotNull(), F.struct(v.alias("new"), F.lit(1).alias("n"))))

    def one(m: Column) -> Column:
        return let(_kind(m), lambda kind: let(F.when(kind == "card", cards(m, key)).otherwise(single(m, kind)), lambda x: F.struct(
            F.coalesce(x["new"], m).alias("new"), F.array_repeat(kind, F.coalesce(x["n"], F.lit(0))).alias("kinds"))))

    t = F.col(f"`{text}`")
    df = docs.select("*", F.regexp_extract_all(text_or_empty(t), F.lit(PATTERN), F.lit(0)).alias("_pl_found"))
    df = df.select("*", F.when(F.size("_pl_found") > 0, F.transform("_pl_found", one)).alias("_pl_made"))
    gaps = F.split(t, PATTERN, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_pl_made"), i)["new"], F.lit("")))), "")
    new = {text: F.when(F.col("_pl_made").isNull(), t).otherwise(joined),
           "pii": F.coalesce(F.flatten(F.transform("_pl_made", lambda x: x["kinds"])), F.array().cast("array<string>"))}
    return df.select(replace_columns(docs, new))
