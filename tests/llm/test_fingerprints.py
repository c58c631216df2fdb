"""Order MinHash against a brute-force version and hand-made cases."""

import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import order_minhash as O
from postlens.llm.common import read
from postlens.llm.queries import op11

from .conftest import SF


def _xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def _fingerprint(text, k=O.K, pairs=O.PAIRS, bits=O.BIN_BITS):
    """Every pair of a k-mer and its number gets a priority; per bin the least, in text order."""
    n = len(text)
    if not n:
        return ""
    low = (1 << 32) - 1
    seen, best = {}, {}
    for i in range(max(1, n - k + 1)):
        h = _xx(text[i:i + k].encode("utf-32-be"))
        top = h & ~low & (1 << 64) - 1
        seen[top] = seen.get(top, 0) + 1
        place = 4 * i + 1
        if seen[top] == 1:
            p = top | place
        else:  # later ones: a hash of the leading half and the number of the occurrence
            p = _xx(struct.pack("<i", seen[top] - 2), _xx(struct.pack("<q", top >> 32))) & ~low & (1 << 64) - 1 | place
        best.setdefault(p >> 64 - bits, []).append(p - (1 << 64) if p >> 63 else p)
    out = []
    for b in sorted(best, key=lambda b: b - (1 << bits) if b >> bits - 1 else b):
        h = 42
        for place in sorted(p & low for p in sorted(best[b])[:pairs]):
            i = (place - 1) // 4
            h = _xx(struct.pack("<Q", _xx(text[i:i + k].encode("utf-32-be"))), h)
        out.append(f"{b:02x}{h:016x}"[:10])
    return " ".join(out)


TEXTS = ["", "a", "abc", "x" * 500, "ab" * 300, "the cat sat on the mat. " * 40, "日本語の文章です。" * 30, "á😀" * 50,
         "".join(chr(97 + i * i % 26) for i in range(3000)), " \n\t "]


def test_fingerprint_matches_brute_force(spark, docs_of, texts):
    docs = docs_of(*enumerate(TEXTS + list(texts.values())[:60]), (None, None))
    got = {r["doc_id"]: r["fingerprint"] for r in O.fingerprints(docs).collect()}
    assert got.pop(None) == ""
    for i, t in enumerate(TEXTS + list(texts.values())[:60]):
        assert got[i] == _fingerprint(t), t[:60]


def test_small_bins_and_other_lengths(spark, docs_of):
    docs = docs_of(*enumerate(TEXTS))
    for k, pairs, bits in ((3, 3, 2), (1, 1, 4), (5, 4, 1)):
        got = {r["doc_id"]: r["fingerprint"] for r in O.fingerprints(docs, k=k, pairs=pairs, bin_bits=bits).collect()}
        assert got == {i: _fingerprint(t, k, pairs, bits) for i, t in enumerate(TEXTS)}


def _near(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) / len({e[:2] for e in x | y})


@pytest.mark.parametrize("stretch", [1 << 11, 1 << 30])
def test_edited_texts_and_next_documents(spark, sf_docs, texts, stretch):
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in O.edited_fingerprints(sf_docs, stretch_bytes=stretch).collect()}
    assert sorted(rows) == ids
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        r = rows[d]
        assert (r["n_chars"], r["edited"], r["fingerprint"]) == (len(t), edited, _fingerprint(t))
        assert r["edited_fingerprint"] == _fingerprint(edited)
        assert abs(r["near_edited"] - _near(_fingerprint(t), _fingerprint(edited))) < 1e-12
        assert abs(r["near_next"] - _near(_fingerprint(t), _fingerprint(nxt))) < 1e-12
    long = [r for r in rows.values() if r["n_chars"] >= 200]
    assert all(r["near_edited"] > r["near_next"] or r["near_next"] > 0.5 for r in long)


def test_order_matters(spark, docs_of):
    """Blocks that change places keep nearly all k-mers; the likeness falls all the same."""
    blocks = [" ".join(hashlib.md5(f"{b}-{i}".encode()).hexdigest() for i in range(12)) for b in range(6)]
    one, other = " ".join(blocks), " ".join(reversed(blocks))
    a, b = O.fingerprints(docs_of((0, one), (1, other))).orderBy("doc_id").collect()
    assert _near(a["fingerprint"], b["fingerprint"]) < 0.75
    assert _near(a["fingerprint"], a["fingerprint"]) == 1.0


def test_query_cases(spark, docs_of, tmp_path):
    assert O.edited_fingerprints(docs_of()).collect() == []
    one = O.edited_fingerprints(docs_of((7, "abcdefgh"))).collect()[0]
    assert (one["edited"], one["near_next"]) == ("abcdefab", 1.0)
    docs = docs_of((2, "aaaa"), (1, None), (None, "zz"), (2, "aaaa"), (3, ""), (2, "bbbb"), (None, None))
    clash = docs.withColumn("fingerprint", F.lit("mine")).withColumn("_pl_k", F.lit(1)).withColumn("k", F.lit(2)).withColumn("edited", F.lit(0))
    out = O.edited_fingerprints(clash)
    rows = out.collect()
    assert len(rows) == 7 and out.columns.count("edited") == 1 and {r["_pl_k"] for r in rows} == {1} and {r["k"] for r in rows} == {2}
    assert sorted(r["edited"] for r in rows if r["doc_id"] == 2) in (["aaaa", "aaab", "bbb"], ["aaaa", "aaa", "bbba"])
    df = op11(spark, SF)
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert df.count() == read(spark, SF, "documents").count()


def test_very_long_text(spark, docs_of):
    text = " ".join(str(i * i) for i in range(200_000))
    r = O.fingerprints(docs_of((1, text))).collect()[0]
    assert r["n_chars"] == len(text) and r["fingerprint"] == _fingerprint(text)
