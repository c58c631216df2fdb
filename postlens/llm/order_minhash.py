"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text is taken as its k-mers of code points, each numbered by how often it came before
(so ``aa`` has the pairs (a, 1) and (a, 2)).  A hash gives every pair a priority; its
leading bits deal the pairs into bins (the one-permutation form of MinHash), and in each
bin the few pairs of least priority are selected.  The selected k-mers of a bin are put
back in the order in which they stand in the text, and the hash of that tuple is the bin's
entry.  Two texts share an entry only if they share the k-mers *and* their order, so the
share of common entries follows the edit distance and not only the sets of k-mers.

Everything happens inside the row: k-mers are hashes of slices of the text's UTF-32 bytes
(constant time each), packed with their place into longs and sorted once, so that equal
k-mers (by the leading 32 bits of the hash) stand together and are numbered by runs.  One row needs some 100 bytes of memory
per character while it is worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, replace_columns, text_or_empty

K = 12  # code points of a k-mer
PAIRS = 2  # pairs selected per bin
BIN_BITS = 6  # 64 bins
#: Text bytes of a stretch of neighbouring documents that one task orders, and the largest number of stretches.
STRETCH_BYTES, MAX_STRETCHES = 2 << 20, 1 << 16
_FAN = 256
#: So many times the wanted number of hashes are looked at first in a long text.
_LIKELY = 5


def _other_bin(x: Column, y: Column, bin_bits: int) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), 64 - bin_bits) != 0


def _packed(b: Column, first: Column, last: Column, k: int) -> Column:
    """The k-mers that start at the bytes from ``first`` to ``last`` (from 1) of UTF-32 text: the
    leading half of the hash, and in the trailing half the place."""
    return F.transform(F.sequence(first, last, F.lit(4)),
                       lambda s: F.xxhash64(F.substring(b, s, 4 * k)).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(s))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _signature(b: Column, v: Column, k: int, pairs: int, bin_bits: int) -> Column:
    """The fingerprint of a text, ``b`` being its UTF-32 bytes, from its sorted packed k-mers."""
    full = pairs << bin_bits

    def as_before(v: Column, x: Column, j: Column) -> Column:  # null for the first element
        return F.shiftrightunsigned(x.bitwiseXOR(F.get(v, j - 1)), 32) == 0

    def least(v: Column) -> Column:
        """Of sorted priorities the first ``pairs`` of every bin."""
        return F.filter(v, lambda x, j: (j < pairs) | _other_bin(x, F.get(v, j - pairs), bin_bits))

    def firsts(v: Column) -> Column:
        """The least first occurrences of every bin: their priority is the k-mer's hash."""
        return let(let(v, lambda v: F.filter(v, lambda x, j: (j == 0) | ~as_before(v, x, j))), least)

    def chosen_firsts(v: Column) -> Column:
        # of a long text only hashes near the lower end of their bin are looked at; if that leaves a bin short, all are
        within = (1 << 64 - bin_bits) - 1
        most = F.least(F.lit(float(within)), F.lit(float(_LIKELY * full * within)) / F.size(v)).cast("long")
        near = let(most, lambda m: F.filter(v, lambda x: x.bitwiseAND(F.lit(within)) <= m))
        return let(near, lambda w: let(firsts(w), lambda f: F.when(
            (F.size(f) == full) | (F.size(w) == F.size(v)), f).otherwise(firsts(v))))

    def later(r: Column) -> Column:
        """Second and further occurrences, with a priority of their own: a hash of k-mer and number."""
        changes = F.filter(F.sequence(F.lit(0), F.size(r)), lambda j: ~as_before(r, F.get(r, j), j))
        return let(F.concat(F.array(F.lit(0)), changes, F.array(F.size(r))), lambda h: F.flatten(F.transform(
            F.slice(h, 1, F.size(h) - 1), lambda a, t: F.transform(F.slice(r, a + 1, F.get(h, t + 1) - a), lambda x, o: F.xxhash64(
                F.shiftrightunsigned(x, 32), o).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(_place(x))))))

    def entries(chosen: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda j: (j == 0) | _other_bin(
            F.get(chosen, j), F.get(chosen, j - 1), bin_bits))

        def entry(a: Column) -> Column:
            head = F.get(chosen, a)
            own = F.filter(F.slice(chosen, a + 1, pairs), lambda x: ~_other_bin(x, head, bin_bits))
            in_order = F.transform(F.sort_array(F.transform(own, _place)), lambda s: F.xxhash64(F.substring(b, s, 4 * k)))
            return F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(head, 64 - bin_bits))), 2, "0"),
                            F.substring(F.lpad(F.lower(F.hex(F.xxhash64(in_order))), 16, "0"), 1, 8))
        return F.array_join(F.transform(heads, entry), " ")

    repeats = let(let(v, lambda v: F.filter(v, lambda x, j: as_before(v, x, j))), later)
    return let(let(F.sort_array(F.concat(chosen_firsts(v), repeats)), least), entries)


def _last(n: Column, k: int) -> Column:
    """Where the last k-mer of n code points starts; a shorter text is one k-mer."""
    return F.greatest(F.lit(1), (n - k) * 4 + 1)


def _none_if_empty(fingerprint: Column, n: Column) -> Column:
    return F.substring(fingerprint, F.lit(1), F.when(n == 0, 0).otherwise(1 << 30))


def fingerprint(text: Column | str, k: int = K, pairs: int = PAIRS, bin_bits: int = BIN_BITS) -> Column:
    """Order MinHash of a text as a string: per bin that has k-mers, in order, two hex digits
    of the bin's number and eight of its entry, parted by blanks.

    Null and empty texts have the empty string; a text shorter than ``k`` is one k-mer.
    """
    t = text_or_empty(text)
    made = let(F.encode(t, "UTF-32"), lambda b: let(F.sort_array(_packed(b, F.lit(1), _last(F.length(t), k), k)),
                                                    lambda v: _signature(b, v, k, pairs, bin_bits)))
    return _none_if_empty(made, F.length(t))


def _with_pair(rows: DataFrame, text: Column, edited: Column, same: Column, k: int, pairs: int, bin_bits: int) -> DataFrame:
    """``rows`` with the fingerprints ``_pl_fp`` and ``_pl_edited_fp`` of a text and of another one that
    shares its first ``same`` code points: k-mers within these are hashed once.

    The sorted k-mers are columns of their own, as only there Spark sorts longs as such.
    """
    last = _last(F.length(edited), k)
    since = F.greatest(F.lit(1), F.least((same - k + 1) * 4 + 1, last))  # the first k-mer that may be another one
    own = let(F.encode(text, "UTF-32"), lambda b: _packed(b, F.lit(1), _last(F.length(text), k), k))
    rows = rows.withColumn("_pl_v", F.sort_array(own))
    shared = let(since, lambda s: F.filter("_pl_v", lambda x: _place(x) < s))
    rows = rows.withColumn("_pl_w", F.sort_array(F.concat(shared, let(F.encode(edited, "UTF-32"), lambda c: _packed(c, since, last, k)))))

    def signature(t: Column, v: str) -> Column:
        return _none_if_empty(let(F.encode(t, "UTF-32"), lambda b: _signature(b, F.col(v), k, pairs, bin_bits)), F.length(t))
    return rows.withColumn("_pl_fp", signature(text, "_pl_v")).withColumn("_pl_edited_fp", signature(edited, "_pl_w")).drop("_pl_v", "_pl_w")


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with the same entry, of the bins that either fingerprint has; two empty ones are alike."""
    x, y = F.split(a, " "), F.split(b, " ")

    def bins(z):
        return F.transform(z, lambda e: F.substring(e, 1, 2))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(F.array_union(bins(x), bins(y))))


def _order(doc_id: str, text: str) -> Column:
    """The place of a row among the documents: ascending id, null last; rows of one id by a hash of the text."""
    d, t = F.col(f"`{doc_id}`"), text_or_empty(F.col(f"`{text}`"))
    return F.struct(d.isNull().alias("none"), d.alias("id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"))


def in_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """``docs`` dealt into stretches of neighbours in ascending order of id, with ``_pl_no`` (the stretch),
    ``_pl_after`` and ``_pl_k`` (the order in it), so that a window over a stretch sees every row's next one.

    Rows picked by a hash of their key are the boundaries (at most about MAX_STRETCHES keys, one
    small array); every row finds its stretch by two steps of counting boundaries.  The row that a
    boundary names stands, with ``_pl_after``, at the end of the stretch before as well, and the
    first row of all at the end of the last.  So every text is shuffled once, and no task sees
    more than a stretch.
    """
    key = _order(doc_id, text)
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty(F.col(f"`{text}`"))))).first()
    stretches = min(MAX_STRETCHES, 1 + (size or 0) // stretch_bytes)
    keys = docs.select(key.alias("k"))
    picked = keys.filter(F.pmod(F.xxhash64("k"), F.lit(max(1, n // stretches))) == 0) if stretches > 1 else keys.limit(0)
    least = keys.agg(F.min("k").alias("k")).filter("k is not null")
    bounds = picked.unionByName(least).distinct().agg(F.sort_array(F.collect_list("k")).alias("b"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / _FAN).cast("int")), lambda i: F.slice("b", i * _FAN + 1, _FAN))
    bounds = bounds.select(F.struct(F.size("b").alias("n"), chunks.alias("chunks"), F.transform(chunks, lambda c: F.get(c, 0)).alias("heads")))

    def places(k: Column, b: Column) -> Column:
        def in_chunk(chunk: Column) -> Column:
            at = F.size(F.filter(F.get(b["chunks"], chunk), lambda x: x <= k)) - 1

            def stands(at: Column) -> Column:
                here = F.struct((chunk * _FAN + at).alias("no"), F.lit(False).alias("after"))
                end = F.struct(F.pmod(chunk * _FAN + at - 1, b["n"]).alias("no"), F.lit(True).alias("after"))
                return F.when(F.get(F.get(b["chunks"], chunk), at) == k, F.array(here, end)).otherwise(F.array(here))
            return let(at, stands)
        return let(F.size(F.filter(b["heads"], lambda x: x <= k)) - 1, in_chunk)

    at = docs.withColumn("_pl_k", key).withColumn("_pl_b", bounds.scalar()).withColumn("_pl_p", F.explode(let(
        F.col("_pl_b"), lambda b: let(F.col("_pl_k"), lambda k: places(k, b)))))
    return at.withColumn("_pl_no", F.col("_pl_p.no")).withColumn("_pl_after", F.col("_pl_p.after")).drop("_pl_p", "_pl_b")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, pairs: int = PAIRS,
                 bin_bits: int = BIN_BITS) -> DataFrame:
    """``docs`` with ``n_chars`` (code points) and ``fingerprint``.

    Defined cases: null and empty texts have 0 code points and the empty fingerprint; texts of
    fewer than ``k`` code points are one k-mer; equal texts have equal fingerprints, whatever
    their rows; very long texts are worked on whole (memory grows with the text); an empty
    table gives no rows.  Columns named like the added ones are replaced, others kept.
    """
    t = F.col(f"`{text}`")
    return docs.select(replace_columns(docs, {"n_chars": F.length(text_or_empty(t)).cast("long"),
                                              "fingerprint": fingerprint(t, k, pairs, bin_bits)}))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 4, k: int = K,
                        pairs: int = PAIRS, bin_bits: int = BIN_BITS, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """``docs`` with ``n_chars`` and ``fingerprint``, and with ``edited``: the text whose last
    floor(n_chars / share) code points are replaced by the first as many (or all) of the next
    document, in ascending order of id; ``edited_fingerprint``, and ``near_edited`` and
    ``near_next``, the likeness of the fingerprint to those of the edited text and of the
    next document.

    Defined cases as in :func:`fingerprints`; rows without an id come last; rows of one id
    follow each other by a hash of the text, so equal rows have one another as the next; a
    single document is its own next one.
    """
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = in_stretches(plain, name[doc_id], name[text], stretch_bytes)
    w = Window.partitionBy("_pl_no").orderBy("_pl_after", "_pl_k")
    t = text_or_empty(name[text])
    n, tail = F.length(t), F.floor(F.length(t) / share).cast("int")
    rows = rows.withColumn("_pl_next", F.lead(t).over(w))
    # the row after the end has no next one here, and stands in its own stretch as well
    edited = F.concat(F.substring(t, F.lit(1), n - tail), F.substring(F.coalesce("_pl_next", F.lit("")), F.lit(1), tail))
    rows = rows.withColumn("_pl_edited", edited).drop("_pl_next")
    rows = _with_pair(rows, t, F.col("_pl_edited"), n - tail, k, pairs, bin_bits)
    rows = rows.withColumn("_pl_next_fp", F.lead("_pl_fp").over(w)).filter(~F.col("_pl_after"))
    own, other = F.col("_pl_fp"), F.col("_pl_edited_fp")
    new = {"n_chars": n.cast("long"), "fingerprint": own, "edited": F.col("_pl_edited"), "edited_fingerprint": other,
           "near_edited": likeness(own, other), "near_next": likeness(own, F.col("_pl_next_fp"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(name[c]).alias(c) for c in docs.columns],
                       *[v.alias(c) for c, v in new.items() if c not in docs.columns])
