"""Statistical and semantic keyword candidates of whole documents in one pass.

Sentences are cut into words by Spark; an Arrow kernel then takes a batch of documents and
builds, with numpy over all of them at once, the sparse co-occurrence counts of their terms,
the published YAKE features, and a sparse hashed embedding of every term and document.  There
is no shuffle and no self join: everything that a document needs is in its row.
"""

from __future__ import annotations

import sys
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.chunking import sentences

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# A small English stop list for statistical candidates.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her",
             "his", "i", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they",
             "this", "to", "was", "we", "were", "which", "with", "you"]
#: Buckets of the hashed character trigrams of a term.
EMBEDDING_DIM = 4093
#: Words of a batch that are worked on at a time (a longer document alone).
_WORDS = 200_000
#: So many times the terms that are asked for are compared before the whole list is.
_HEAD = 4

TERM = "array<struct<term: string, tf: long, tf_u: long, tf_a: long, sf: long, score: double>>"
SIMILAR = "array<struct<term: string, similarity: double>>"
_TERM = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("tf_u", pa.int64()), ("tf_a", pa.int64()),
                            ("sf", pa.int64()), ("score", pa.float64())]))
_SIMILAR = pa.list_(pa.struct([("term", pa.string()), ("similarity", pa.float64())]))


def sentence_words(text: Column | str) -> Column:
    """Words (runs of letters and digits) by sentence; null text has none."""
    return F.coalesce(F.transform(sentences(text), lambda s: F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+)"), 1)),
                      F.array().cast("array<array<string>>"))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending (sorted: numpy's own hashes them, which takes several times as long)."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def _edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance of two strings, or ``most + 1`` if it is more than that."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    row, far = list(range(len(b) + 1)), most + 1
    for i, x in enumerate(a, 1):  # only cells within ``most`` of the diagonal can count
        first, last = max(1, i - most), min(len(b), i + most)
        if first > last:
            return far
        new = [far] * (len(b) + 1)
        new[0] = i
        for j in range(first, last + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new[first - 1:last + 1]) > most:
            return far
        row = new
    return min(row[-1], far)


class Similar:
    """Which distinct terms of a vocabulary are more than ``threshold`` similar (1 - Levenshtein / longer length,
    of terms whose lengths differ by less than the rest of the longer one)."""

    def __init__(self, vocab: pa.Array, threshold: float):
        self.names, self.threshold = vocab.to_pylist(), threshold
        self.lengths = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        self.least = int(1 / (1 - threshold))  # shorter terms can't be that similar to a different one
        points = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.cumsum(self.lengths) - self.lengths
        some = self.lengths > 0
        self.marks = []
        for flat in (points, np.append(points[:-1] * np.uint64(0x9E3779B1) + points[1:], np.uint64(0))):  # characters, pairs of them
            bits = np.left_shift(np.uint64(1), ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)))
            if len(self.marks):  # the last of a term pairs with the next term
                bits[(start + self.lengths - 1)[some]] = 0
            mark = np.zeros(len(self.names), np.uint64)
            if some.any():
                mark[some] = np.bitwise_or.reduceat(bits, start[some])
            self.marks.append(mark)
        self.known: dict[tuple[int, int], bool] = {}

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False only where the terms are not similar; an edit changes at most two characters and four pairs."""
        ok = np.ones(len(a), bool)
        for mark, most in zip(self.marks, (2, 4)):
            i = np.flatnonzero(ok)
            least = -(-np.bitwise_count(mark[a[i]] ^ mark[b[i]]).astype(np.int64) // most)
            longer = np.maximum(self.lengths[a[i]], self.lengths[b[i]])
            ok[i] = 1.0 - least / longer > self.threshold
        return ok

    def sure(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            longer = max(self.lengths[a], self.lengths[b])
            most = int(longer * (1 - self.threshold)) + 1
            got = self.known[a, b] = bool(1.0 - _edits(self.names[a], self.names[b], most) / longer > self.threshold)
        return got

    def stays(self, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of terms by document in order of rank those that are neither equal nor similar to a better one
        that stays."""
        n, size = len(code), max(1, len(self.names))
        kept = np.zeros(n, bool)
        order = np.argsort(doc * size + code, kind="stable")
        key = (doc * size + code)[order]
        kept[order[np.concatenate([np.ones(min(1, n), bool), key[1:] != key[:-1]])]] = True
        at = np.flatnonzero(kept & (self.lengths[code] >= self.least))
        at = at[np.lexsort((self.lengths[code[at]], doc[at]))]  # by length inside a document
        d, c, length = doc[at], code[at], self.lengths[code[at]]
        i, step, pairs = np.arange(len(at)), 1, [np.zeros((2, 0), np.int64)]
        while len(i):
            i = i[:np.searchsorted(i, len(at) - step)]
            j = i + step
            near = (d[i] == d[j]) & (length[j] - length[i] < length[j] * (1 - self.threshold))
            i, j = i[near], j[near]  # where this one is too long all later ones are
            some = self.may(c[i], c[j]) & (length[j] > self.least)
            pairs.append(np.stack([at[i[some]], at[j[some]]]))
            step += 1
        pairs = np.sort(np.concatenate(pairs, 1), 0)
        for p, q in pairs[:, np.lexsort(pairs)].T.tolist():  # ascending by the worse one of a pair
            if kept[p] and kept[q] and self.sure(*sorted((int(code[p]), int(code[q])))):
                kept[q] = False
        return kept


class _Words:
    """The words of some documents as numbers: ``pair`` is the (document, term) of each occurrence."""

    def __init__(self, nested: pa.ListArray):
        per_doc = pc.list_value_length(nested).to_numpy(zero_copy_only=False)
        sents = nested.flatten()
        per_sent = pc.list_value_length(sents).to_numpy(zero_copy_only=False)
        words = sents.flatten()
        self.docs = len(nested)
        self.sent = np.repeat(np.arange(len(sents)), per_sent)
        doc_of_sent = np.repeat(np.arange(self.docs), per_doc)
        self.doc = doc_of_sent[self.sent]
        self.sent_no = self.sent - (np.cumsum(per_doc) - per_doc)[self.doc]
        tok_no = np.arange(len(self.sent)) - (np.cumsum(per_sent) - per_sent)[self.sent]
        lower = pc.utf8_lower(words).dictionary_encode()
        self.code, self.vocab = lower.indices.to_numpy(zero_copy_only=False).astype(np.int64), lower.dictionary
        self.size = max(1, len(self.vocab))
        stop = pc.or_(pc.is_in(self.vocab, pa.array(STOPWORDS)), pc.less(pc.utf8_length(self.vocab), 3))
        self.stop = np.asarray(pc.or_(stop, pc.match_substring_regex(self.vocab, r"^\p{N}+$")), bool)
        seen = words.dictionary_encode()
        at, forms = seen.indices.to_numpy(zero_copy_only=False), seen.dictionary
        upper = np.asarray(pc.match_substring_regex(forms, r"^\p{Lu}"), bool)
        acronym = np.asarray(pc.and_(pc.greater(pc.utf8_length(forms), 1), pc.and_not(
            pc.match_substring_regex(forms, r"\p{Lu}"), pc.match_substring_regex(forms, r"\p{Ll}"))), bool)
        distinct, self.pair = np.unique(self.doc * self.size + self.code, return_inverse=True)
        self.pair_doc, self.pair_code = distinct // self.size, distinct % self.size
        self.n = len(distinct)
        self.cand = ~self.stop[self.pair_code] if len(distinct) else np.zeros(0, bool)
        self.tf = np.bincount(self.pair, minlength=self.n)
        self.tf_u = np.bincount(self.pair[upper[at] & (tok_no > 0)], minlength=self.n)
        self.tf_a = np.bincount(self.pair[acronym[at]], minlength=self.n)
        order = pc.sort_indices(self.vocab).to_numpy()
        self.place = np.empty(len(order), np.int64)  # of a term among all, bytewise
        self.place[order] = np.arange(len(order))

    def neighbours(self, window: int) -> np.ndarray:
        """Distinct over all co-occurrences to the left, plus the same to the right, per pair."""
        ratio = np.zeros(self.n)
        for left in (True, False):
            own, other = [], []
            for d in range(1, window + 1):
                i = np.flatnonzero(self.sent[d:] == self.sent[:-d])
                a, b = (i + d, i) if left else (i, i + d)
                own.append(self.pair[a])
                other.append(self.code[b])
            own, other = np.concatenate(own), np.concatenate(other)
            some = self.cand[own] if self.n else np.zeros(0, bool)
            own, other = own[some], other[some]
            total = np.bincount(own, minlength=self.n)
            distinct = np.bincount(_distinct(own * self.size + other) // self.size, minlength=self.n)
            ratio += np.divide(distinct, total, out=np.zeros(self.n), where=total > 0)
        return ratio

    @cached_property
    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences of every pair, their median, and the sentences of every document."""
        n_sents = np.ones(self.docs, np.int64)
        np.maximum.at(n_sents, self.doc, self.sent_no + 1)
        span = int(n_sents.max()) if len(self.doc) else 1
        held = _distinct(self.pair * span + self.sent_no)
        sf = np.bincount(held // span, minlength=self.n)
        first = np.cumsum(sf) - sf
        return sf, (held[first + (sf - 1) // 2] % span + held[first + sf // 2] % span) / 2.0, n_sents

    def scores(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The single-term score S and the number of sentences of every pair."""
        sf, median, n_sents = self._held
        c, d, tf = self.cand, self.pair_doc, self.tf
        count = np.maximum(np.bincount(d[c], minlength=self.docs), 1)
        one = np.bincount(d[c], tf[c], minlength=self.docs)
        two = np.bincount(d[c], tf[c] * tf[c], minlength=self.docs)
        most = np.ones(self.docs, np.int64)
        np.maximum.at(most, d[c], tf[c])
        spread = np.sqrt(np.maximum(count * two - one * one, 0)) / count
        t_case = np.maximum(self.tf_u, self.tf_a) / (1.0 + np.log(tf))
        t_norm = tf / np.maximum(one / count + spread, 1e-300)[d]
        t_rel = 1.0 + self.neighbours(window) * tf / most[d]
        return t_rel * np.log(np.log(3.0 + median)) / (t_case + t_norm / t_rel + sf / n_sents[d] / t_rel), sf

    def _lists(self, doc: np.ndarray, key: np.ndarray, then: tuple[np.ndarray, ...], fields: list, kind, top: int | None = None) -> pa.ListArray:
        """One list per document, ascending by ``key`` (9 decimals) and the arrays ``then``."""
        order = np.lexsort((*reversed(then), np.round(key, 9), doc))
        counts = np.bincount(doc, minlength=self.docs)
        if top is not None:
            rank = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc[order]]
            order, counts = order[rank < top], np.minimum(counts, top)
        values = pa.StructArray.from_arrays([pc.take(pa.array(f) if isinstance(f, np.ndarray) else f, pa.array(order)) for f in fields],
                                            fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    def _ranked(self, window: int, longest: int) -> tuple:
        """Document, score, first and second term (or -1) and counts of all candidates of one term, and of two
        if ``longest`` is 2: the published score, product of S over tf times one plus the sum of S."""
        s, sf = self.scores(window)
        c = np.flatnonzero(self.cand)
        doc, key = self.pair_doc[c], s[c] / (self.tf[c] * (1.0 + s[c]))
        one, two = self.pair_code[c], np.full(len(c), -1)
        cols = [self.tf[c], self.tf_u[c], self.tf_a[c], sf[c]]
        if longest > 1:
            i = np.flatnonzero(self.sent[1:] == self.sent[:-1])
            i = i[self.cand[self.pair[i]] & self.cand[self.pair[i + 1]]] if self.n else i
            both, first, tf = np.unique(self.pair[i] * self.size + self.code[i + 1], return_index=True, return_counts=True)
            a, b = self.pair[i[first]], self.pair[i[first] + 1]
            doc = np.concatenate([doc, self.pair_doc[a]])
            key = np.concatenate([key, s[a] * s[b] / (tf * (1.0 + s[a] + s[b]))])
            one, two = np.concatenate([one, self.pair_code[a]]), np.concatenate([two, self.pair_code[b]])
            cols = [np.concatenate([x, y]) for x, y in zip(cols, [tf, *[np.zeros(len(tf), np.int64)] * 3])]
        return doc, key, one, two, cols

    def _tie(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Orders candidates like their terms, bytewise."""
        return self.place[one] * (self.size + 1) + np.where(two < 0, 0, self.place[two] + 1) if len(one) else one

    def _names(self, one: np.ndarray, two: np.ndarray) -> pa.Array:
        first = pc.take(self.vocab, pa.array(one))
        if not (two >= 0).any():
            return first
        return pc.binary_join_element_wise(first, pc.take(self.vocab, pa.array(two, mask=two < 0)), " ", null_handling="skip")

    def terms(self, window: int, longest: int) -> pa.ListArray:
        """All candidates with their counts, best first."""
        doc, key, one, two, cols = self._ranked(window, longest)
        return self._lists(doc, key, (self._tie(one, two),), [self._names(one, two), *[x.astype(np.int64) for x in cols], key], _TERM)

    def best(self, window: int, longest: int, top: int, threshold: float) -> pa.ListArray:
        """The first ``top`` candidates that are not too similar to a better one that stays."""
        doc, key, one, two, _ = self._ranked(window, longest)
        order = np.lexsort((self._tie(one, two), np.round(key, 9), doc))
        doc, one, two = doc[order], one[order], two[order]
        counts = np.bincount(doc, minlength=self.docs)
        rank = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
        todo, picked = np.ones(self.docs, bool), []
        for head in (_HEAD * top, len(doc) + 1):  # few documents need more than the head of their list
            at = np.flatnonzero(todo[doc] & (rank < head))
            names = self._names(one[at], two[at]).dictionary_encode()
            at = at[Similar(names.dictionary, threshold).stays(doc[at], names.indices.to_numpy(zero_copy_only=False).astype(np.int64))]
            n = np.bincount(doc[at], minlength=self.docs)
            done = todo & ((n >= top) | (counts <= head))
            at = at[(np.arange(len(at)) - (np.cumsum(n) - n)[doc[at]] < top) & done[doc[at]]]
            picked.append(at)
            todo &= ~done
            if not todo.any():
                break
        at = np.sort(np.concatenate(picked))
        ends = np.cumsum(np.bincount(doc[at], minlength=self.docs))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), self._names(one[at], two[at]))

    def similar(self, top: int, threshold: float) -> pa.ListArray:
        """Candidates by the cosine of their embedding to the document's (the sum over its candidates)."""
        padded = pc.binary_join_element_wise("<", self.vocab, ">", "")
        lengths = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.ones(len(points), bool)  # where a trigram of the same term begins
        inside[start[1:] - 1] = inside[start[1:] - 2] = False
        i = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(lengths)), lengths)[i]
        bucket = (points[i] * 961 + points[i + 1] * 31 + points[i + 2]) % EMBEDDING_DIM
        flat, count = np.unique(word * EMBEDDING_DIM + bucket, return_counts=True)
        word, bucket = flat // EMBEDDING_DIM, flat % EMBEDDING_DIM
        per_word = np.bincount(word, minlength=self.size)
        first = np.cumsum(per_word) - per_word
        squares = np.bincount(word, count * count, minlength=self.size)
        c = np.flatnonzero(self.cand)
        doc, code = self.pair_doc[c], self.pair_code[c]
        n = per_word[code] if len(c) else np.zeros(0, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[code], n)  # entries of each pair's term
        of = np.repeat(np.arange(len(c)), n)
        keys, where = np.unique(doc[of] * EMBEDDING_DIM + bucket[at], return_inverse=True)  # the documents' sparse vectors
        vector = np.bincount(where, count[at] * self.tf[c][of], minlength=len(keys))
        norms = np.bincount(keys // EMBEDDING_DIM, vector * vector, minlength=self.docs)
        dot = np.bincount(of, count[at] * vector[where], minlength=len(c))
        cosine = dot / (np.sqrt(squares[code]) * np.sqrt(norms[doc]))
        some = cosine > threshold
        c, doc, code, cosine = c[some], doc[some], code[some], cosine[some]
        return self._lists(doc, -cosine, (self.place[code],), [pc.take(self.vocab, pa.array(code)), cosine], _SIMILAR, top)


def _cuts(ends: np.ndarray, most: int):
    """Slices (lo, hi) of rows, whose sizes add up to ``ends``, of at most ``most`` in all, a larger row alone."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _pieces(nested: pa.ListArray):
    """Slices of a batch of at most _WORDS words, a longer document alone."""
    per_sent = pc.list_value_length(nested.flatten()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(nested).to_numpy(zero_copy_only=False))
    upto = np.concatenate([[0], np.cumsum(per_sent)])[ends]  # words up to the end of each document
    for lo, hi in _cuts(upto, _WORDS):
        yield lo, nested.slice(lo, hi - lo)


def candidates(df: DataFrame, key: str, text: str, sets: dict[str, tuple[int, int]] | None = None,
               similar: tuple[int, float] | None = None, best: dict[str, tuple[int, int, int, float]] | None = None) -> DataFrame:
    """``df`` without shuffling, and per entry of ``sets`` (name: (window, longest)) an array of ranked terms;
    per entry of ``best`` (name: (window, longest, top, threshold)) an array of the ``top`` best terms, none more than
    ``threshold`` similar to a better one of them; with ``similar`` (top, threshold) an array ``similar`` of the terms
    nearest to the document.

    A term's rank is its place in the array, from 1.  Null and wordless texts have empty arrays.
    """
    sets, best = sets or {}, best or {}
    src = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)], sentence_words(F.col(f"`{text}`")).alias("_sents"))
    own = [f for f in src.schema.fields if f.name != "_sents"]
    names = [*sets, *best]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own), *(f"_s_{n} {TERM}" for n in sets),
                        *(f"_s_{n} array<string>" for n in best), *([f"_similar {SIMILAR}"] if similar else [])])

    def run(batches):
        for batch in batches:
            nested = batch.column(len(own))
            for lo, part in _pieces(nested):
                w = _Words(part)
                made = [*[w.terms(*p) for p in sets.values()], *[w.best(*p) for p in best.values()], *([w.similar(*similar)] if similar else [])]
                cols = [batch.column(i).slice(lo, len(part)) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*[f.name for f in own], *[f"_s_{n}" for n in names], *(["_similar"] if similar else [])])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(f"_s_{n}").alias(n) for n in names],
                      *([F.col("_similar").alias("similar")] if similar else []))


def stay_of_lists(lists: DataFrame, threshold: float, top: int | None) -> DataFrame:
    """Of rows (key, array<struct<rank, term>> in order of rank) the elements (key, rank, term) that are not more than
    ``threshold`` similar to a better one that stays, the first ``top`` of them; equal elements stay together."""
    key, inner = lists.schema.fields[0], lists.schema.fields[1].dataType.elementType
    rows = T.StructType([key, *inner.fields])

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            for lo, hi in _cuts(ends, _WORDS):
                part = batch.slice(lo, hi - lo)
                n = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                flat, doc = part.column(1).flatten(), np.repeat(np.arange(hi - lo), n)
                rank, names = flat.field(0), flat.field(1).dictionary_encode()
                term = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                real, kept = term >= 0, np.ones(len(doc), bool)
                kept[real] = Similar(names.dictionary, threshold).stays(doc[real], term[real])
                if top is not None:
                    upto = np.cumsum(kept)
                    start = np.cumsum(n) - n
                    kept &= upto - np.concatenate([[0], upto])[start][doc] <= top
                place = rank.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]) | (place[1:] != place[:-1])
                at = np.cumsum(new) - 1
                keep = (np.bincount(at, kept) > 0)[at] & real & (place >= 0) if len(doc) else new
                i = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([pc.take(part.column(0), pa.array(doc[keep])), pc.take(rank, i), pc.take(flat.field(1), i)], names=rows.names)

    return lists.mapInArrow(run, rows)
