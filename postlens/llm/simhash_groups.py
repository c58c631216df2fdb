"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of word shingles.  Two fingerprints at distance d agree
on at least two of d + 2 bit blocks, so every linked pair meets in a group of fingerprints
that share two blocks; groups are the unit that Spark deals out.  Inside a group the
fingerprints are sorted by Gray rank (neighbours share most bits) and indexed as a tree:
a node stores the bits that all below it share and that no node above it has stored; a
search adds up the differences on its way down and leaves a whole subtree as soon as they
exceed the bound.  A group that is too large for one task is dealt again by a further
block of its remaining bits, in which a linked pair must agree as well.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches, checkpoint_about
from .components import components

BITS = 64
LEAF = 32  # fingerprints below a lowest node
FAN = 8  # nodes below an upper node
#: Fingerprints of a group that go to one task; larger groups are dealt again (exactly).
MAX_GROUP = 20_000
SMALL = 500  # small groups compared at a time: at most SMALL * LEAF ** 2 pairs in memory
CHUNK = 20_000  # shingles hashed at a time


# ---- fingerprints -------------------------------------------------------------------

def fingerprint(text: bytes | None, n: int = 4) -> int:
    """SimHash of one text: bit set if set in over half the shingles' hashes; 0 without a word."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(doc_id, fp, *more): one row per input row; fp a long with the 64 bits."""
    @pandas_udf("long")
    def simhash(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, n) for x in s], dtype="int64")

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), simhash(F.col(f"`{text}`").cast("binary")).alias("fp"), *more)


# ---- the index of one group ---------------------------------------------------------

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code."""
    r = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


class GrayTree:
    """Levels of (mask, pattern); a node's mask holds the shared bits not stored above it."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        n = len(self.fps)
        sizes, starts = [LEAF], [np.arange(0, n, LEAF)]
        while len(starts[-1]) > FAN:
            sizes.append(sizes[-1] * FAN)
            starts.append(np.arange(0, n, sizes[-1]))
        every, self.levels, self.steps = np.uint64(0xFFFFFFFFFFFFFFFF), [], []
        ands, ors = np.bitwise_and.reduceat(self.fps, starts[0]), np.bitwise_or.reduceat(self.fps, starts[0])
        shared = []
        for k, s in enumerate(starts):
            if k:
                at = np.arange(0, len(ands), FAN)
                ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
            shared.append((~(ands ^ ors) & every, ands))
        for k, (mask, pattern) in enumerate(shared):
            if k + 1 < len(shared):
                above = np.repeat(shared[k + 1][0], FAN)[: len(mask)]
                mask = mask & ~above
            self.levels.append((mask, pattern & mask))
        self.levels.reverse()  # top first

    def near(self, queries: np.ndarray, alive: np.ndarray, most: int) -> np.ndarray:
        """Positions of the alive fingerprints within ``most`` bits of any query."""
        found = np.zeros(len(self.fps), bool)
        for c in range(0, len(queries), 128):
            q = queries[c:c + 128]
            mask, pattern = self.levels[0]
            qi, node = (x.ravel() for x in np.meshgrid(np.arange(len(q)), np.arange(len(mask)), indexing="ij"))
            diff = np.zeros(len(qi), np.uint8)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    qi, diff = np.repeat(qi, FAN), np.repeat(diff, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = node < len(mask)
                    qi, node, diff = qi[inside], node[inside], diff[inside]
                diff = diff + np.bitwise_count((q[qi] ^ pattern[node]) & mask[node])
                on = diff <= most
                qi, node, diff = qi[on], node[on], diff[on]
            at = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            qi = np.repeat(qi, LEAF)
            inside = at < len(self.fps)
            at, qi = at[inside], qi[inside]
            on = alive[at] & ~found[at]
            at, qi = at[on], qi[on]
            found[at[np.bitwise_count(q[qi] ^ self.fps[at]) <= most]] = True
        return np.flatnonzero(found)


def link_large(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (fingerprint, first of its component) of one large group: components
    are walked one at a time, each fingerprint searched against those not reached yet."""
    tree = GrayTree(fps)
    alive = np.ones(len(fps), bool)
    a, b = [], []
    for k in range(len(fps)):
        if not alive[k]:
            continue
        alive[k] = False
        front = np.array([k])
        while len(front):
            front = tree.near(tree.fps[front], alive, most)
            alive[front] = False
            if len(front):
                a.append(tree.fps[front])
                b.append(np.full(len(front), tree.fps[k]))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_small(flat: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups of at most LEAF fingerprints (each a single leaf) at once."""
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(sizes, sizes)
    left = np.repeat(np.arange(len(flat)), rows)
    right = np.arange(len(left)) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(np.repeat(starts, sizes), rows)
    on = (left < right)
    left, right = left[on], right[on]
    on = np.bitwise_count(flat[left] ^ flat[right]) <= most
    left, right = left[on], right[on]
    label = np.arange(len(flat))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(flat)))
    return flat[moved], flat[label[moved]]


def _link_batches(most: int):
    def run(batches):
        for pdf in batches:
            groups = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["fps"]]
            small = [g for g in groups if len(g) <= LEAF]
            out = [link_large(g, most) for g in groups if len(g) > LEAF]
            for k in range(0, len(small), SMALL):
                some = small[k:k + SMALL]
                out.append(link_small(np.concatenate(some), np.array([len(g) for g in some]), most))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()
    return run


# ---- dealing groups out -------------------------------------------------------------

def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def first_masks(most: int) -> list[int]:
    """Two of most + 2 blocks: a pair within ``most`` bits agrees on at least one choice."""
    blocks = _cut(list(range(BITS)), most + 2)
    return [x | y for x, y in combinations(blocks, 2)]


def finer_masks(mask: int, most: int) -> list[int]:
    """A mask joined with each of most + 1 runs of the bits that it leaves."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | m for m in _cut(rest, most + 1)] if len(rest) > most else []


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                      for i, m in enumerate(masks)])
    return fps.select("fp", F.inline(pairs))


def links(fps: DataFrame, most: int = 4, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints in ``fp``, which are read several times."""
    edges = None
    many = fps.count()
    work, masks = fps.select("fp"), first_masks(most)
    members = _keyed(work, masks)
    while True:
        count = checkpoint_about(members.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                                 many * len(first_masks(most)) // 2)
        fits = members.join(count.filter(F.col("n") <= max_group).drop("n"), ["mask", "key"])
        found = (fits.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
                 .mapInPandas(_link_batches(most), "a long, b long").distinct())
        edges = found if edges is None else edges.unionByName(found)
        hot = count.filter(F.col("n") > max_group)
        finer = {i: finer_masks(m, most) for i, m in enumerate(masks)} if hot.head(1) else {}
        if not finer:
            return edges
        if not any(finer.values()):
            raise ValueError("more fingerprints than a group can hold share all bits")
        members = members.join(hot.select("mask", "key"), ["mask", "key"])
        masks, flat = [m for i in finer for m in finer[i]], []
        for i in finer:
            flat += [(i, m) for m in finer[i]]
        nexts = F.filter(F.array(*[F.struct(F.lit(i).alias("old"), F.lit(j).alias("mask"),
                                            F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                                   for j, (i, m) in enumerate(flat)]), lambda x: x["old"] == F.col("mask"))
        members = members.select("fp", nexts.alias("x")).select("fp", F.inline("x")).drop("old").checkpoint()


def keepers(docs: DataFrame, order: Column, n: int = 4, most: int = 4, doc_id: str = "doc_id", text: str = "text",
            max_group: int = MAX_GROUP) -> DataFrame:
    """(least, n): of each component of ``groups`` the least value of ``order`` and the rows that have it.

    ``order`` must be orderable and tell rows of a component apart; rows that share a value
    should be equal rows.  Hot groups are combined before the shuffle.
    """
    bound_batches(docs.sparkSession)
    prints = fingerprints(docs, n, doc_id, text, order.alias("least")).checkpoint()
    alike = prints.groupBy("fp", "least").agg(F.count(F.lit(1)).alias("n"))
    many = prints.count()
    distinct = checkpoint_about(alike.groupBy("fp").agg(F.min(F.struct("least", "n")).alias("first")), many)
    roots = components(links(distinct, most, max_group), about=many)
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return joined.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*")


def groups(docs: DataFrame, n: int = 4, most: int = 4, doc_id: str = "doc_id", text: str = "text",
           max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of ``most`` or fewer
    differing bits reach, itself included.

    Defined cases: null, empty and wordless texts have fingerprint 0 and link to each
    other like any; fewer than n words make one shingle; repeated rows are rows of one
    fingerprint; a null doc_id takes part and never is a component's id, unless all of
    the component's ids are null; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    prints = fingerprints(docs, n, doc_id, text).checkpoint()
    many = prints.count()
    distinct = checkpoint_about(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), many)
    roots = components(links(distinct, most, max_group), about=many)
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.filter("root is not null").join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
