"""Merkle manifest against a brute-force tree and its SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from postlens.llm import merkle as M
from postlens.llm.queries import op13
from postlens.llm.registry import ORACLES

from .conftest import SF


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves, fan):
    """The root and, per leaf, its siblings as (left, right) level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // fan * fan
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1:run + fan])))
        level = [_h(*level[i:i + fan]) for i in range(0, len(level), fan)]
        at = [k // fan for k in at]
    return level[0], paths


def _manifest(rows, fan):
    """rows: (doc_id, source, leaf) -> sorted (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for d, s, leaf in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf, d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(groups[s])], fan) for s in names]
    root, over = _tree([t[0] for t in trees], fan)
    out = []
    for s, (sub, paths), top in zip(names, trees, over):
        out += [(x[3], x[2], sub, root, p + top) for x, p in zip(sorted(groups[s]), paths)]
    return out


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_matches_brute_force(spark, fan):
    rows = [(i, f"s{'x' * (i % 3)}" if i % 7 else None, _h(str(i))) for i in range(300)]
    rows += [(5, "one", _h("a")), (None, "two", _h("b")), (None, "two", _h("b")), (7, "two", _h("d")), (7, "two", _h("c"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, h string").repartition(7)
    got = M.manifest(df, F.col("h"), "source", ["doc_id"], fan).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    want = sorted(_manifest(rows, fan), key=key)
    assert sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in got], key=key) == want


def test_groups_as_many_as_rows_and_one_group(spark):
    for rows in ([(i, f"u{i:03}", _h(str(i))) for i in range(40)], [(i, "a", _h(str(i))) for i in range(257)], [(1, "a", _h("x"))]):
        got = M.manifest(spark.createDataFrame(rows, "doc_id long, source string, h string"), F.col("h"), "source", ["doc_id"])
        got = got.withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()
        assert sorted((r["doc_id"], r["subroot"], r["root"]) for r in got) == sorted((x[0], x[2], x[3]) for x in _manifest(rows, 16))
        assert all(r["folded"] == r["root"] for r in got)


def test_cases(spark, docs_of):
    assert M.manifest(docs_of(), F.lit("x"), "source", ["doc_id"]).collect() == []
    docs = docs_of((1, None, None, None), (None, "", "en", "a"), (3, "X" * 100_000, "en", "a"), (3, "X" * 100_000, "en", "a"))
    for c in ("hash", "lo", "width", "_group", "leaf", "rank", "path", "_c0", "_pl_0"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = M.manifest(docs, M.sha(M.canonical("doc_id", "text")), "source", ["doc_id"])
    rows = out.collect()
    assert len(rows) == 4 and out.columns.count("leaf") == 1 and {r["width"] for r in rows} == {"mine"} == {r["_c0"] for r in rows}
    assert {r["leaf"] for r in rows} == {_h("1:1", "-"), _h("-", "0:"), _h("1:3", "100000:" + "X" * 100_000)}


def test_query_matches_brute_force_and_sql(spark, con, sf_docs):
    docs = [tuple(r) for r in sf_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    leaf = {d[0]: _h(*map(_field, d)) for d in docs}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = {d[0]: _h(*map(_field, (*d[:4], d[4].translate(low) if d[4] is not None else None)))
             if zlib.crc32(str(d[0]).encode()) % 5 == 0 else leaf[d[0]] for d in docs}
    want = set()
    for d, h, sub, root, path in _manifest([(d[0], d[1], leaf[d[0]]) for d in docs], 16):
        folded = found[d]
        for a, b in path:
            folded = _h(a, folded, b)
        want.add((d, h, sub, root, _h(*[a + b for a, b in path]), folded, folded == root))
    df = op13(spark, SF)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = df.collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want
    assert len({r["verified"] for r in got}) == 2
    assert {tuple(r) for r in con.sql(ORACLES["op13_merkle_manifest"]).fetchall()} == want
