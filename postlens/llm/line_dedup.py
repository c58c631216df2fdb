"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles.  MinHash signatures are cut into bands;
lines that share a band are compared by the exact Jaccard similarity of their shingle
sets; similar lines are joined to components by a distributed union-find, and of each
component the first line (by document, then position) stays in the corpus.

Equal lines are one line throughout (a hash of 128 bits stands for them), so thousands of
copies cost a row per task.  Lines of one band are walked component by component, each
line against those not reached yet: no list of all pairs is made.  A band with more lines
than one task takes is split into blocks, and every pair of blocks is walked by a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint_about, hash_filter, may_hold, replace_columns, row_key
from .components import components

SHINGLE = 8  # characters
SIMILARITY = 0.8
BANDS, ROWS = 10, 5
#: Shorter lines (characters) are left alone: single words, numbers and marks.  A line of fewer
#: than SHINGLE characters is one shingle, so that only exact copies of it are similar.
MIN_CHARS = 6
#: Lines of one band that one task compares; larger bands are compared block by block.
BLOCK = 4_000
FEW = 24  # lines of a group that are compared as plain sets
_FLAT = 1 << 16  # shingles hashed at a time
_MET = 1 << 20  # line hashes that a task remembers, each at the place of its trailing bits
_MULTIPLIERS = (np.random.default_rng(20240607).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingle_values(lines: list[str], kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of all character shingles (a shorter line is one shingle), and where each line's begin."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    pool = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(kind, copy=False)
    h = pool[: len(pool) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= kind(0x01000193)
        h += pool[k: len(pool) - SHINGLE + 1 + k]
    h ^= h >> kind(15)
    h *= kind(0x94D049BB133111EB & np.iinfo(kind).max)
    h ^= h >> kind(13)
    width = np.array([len(x) for x in padded])
    last = np.cumsum(width)
    inside = np.ones(len(pool), bool)  # a shingle does not run over the end of its line
    for k in range(1, SHINGLE):
        inside[last - k] = False
    sizes = width - SHINGLE + 1
    return h[inside[: len(h)]], np.cumsum(sizes) - sizes


def band_keys(lines: list[str]) -> np.ndarray:
    """One 64-bit key per line and band."""
    h, starts = shingle_values(lines, np.uint32)
    out = np.zeros((len(lines), BANDS), np.uint64)
    product = np.empty_like(h)
    for p, a in enumerate(_MULTIPLIERS):
        low = np.minimum.reduceat(np.multiply(h, a, out=product), starts).astype(np.uint64)
        k = p // ROWS
        out[:, k] = (out[:, k] ^ (low + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] ^= out[:, k] >> np.uint64(31)
    return out


def _band_batches(batches):
    # the last line of this task met at each place; a line that another one took the place of is only sent once more
    met = ~np.arange(_MET, dtype=np.int64)  # what no line at that place can be
    for batch in batches:
        h1 = batch.column(1).to_numpy()
        new = np.zeros(len(h1), bool)
        new[np.unique(h1, return_index=True)[1]] = True
        new &= met[h1 & (_MET - 1)] != h1
        h1 = h1[new]
        met[h1 & (_MET - 1)] = h1
        lines, lo, keys = batch.column(0).filter(pa.array(new)).to_pylist(), 0, [np.zeros((0, BANDS), np.uint64)]
        while lo < len(lines):
            hi, size = lo, 0
            while hi < len(lines) and (hi == lo or size + len(lines[hi]) <= _FLAT):
                size += len(lines[hi])
                hi += 1
            keys.append(band_keys(lines[lo:hi]))
            lo = hi
        yield _table(np.concatenate(keys).view(np.int64).ravel(), np.repeat(h1, BANDS))


def _table(band: np.ndarray, h1: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(band), pa.array(h1)], names=["band", "h1"])


def _gathered(batches, rows: int):
    """Small batches of numbers as (rows, 2) arrays of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        n += len(batch)
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _shared_batches(batches):
    """Of rows (band, h1) in order of band, those whose band has more than one line."""
    open_ = np.zeros((0, 2), np.int64)  # distinct rows of the last band met, which may go on
    for v in _gathered(batches, _FLAT):
        v = np.concatenate([open_, v])
        first = np.flatnonzero(np.concatenate([[True], v[1:, 0] != v[:-1, 0]]))
        open_ = np.unique(v[first[-1]:], axis=0)
        v, first = v[: first[-1]], first[:-1]
        if len(v):
            several = np.minimum.reduceat(v[:, 1], first) != np.maximum.reduceat(v[:, 1], first)
            on = np.repeat(several, np.diff(np.concatenate([first, [len(v)]])))
            if on.any():
                some = np.unique(v[on], axis=0)
                yield _table(some[:, 0], some[:, 1])
    if len(open_) > 1:
        yield _table(open_[:, 0], open_[:, 1])


def similar(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Of the sets numbered ``at``, those whose Jaccard similarity to the set ``one`` is enough."""
    at = at[np.minimum(sizes[at], len(one)) >= least * np.maximum(sizes[at], len(one))]
    if not len(at):
        return at
    n = sizes[at]
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
    values = flat[index]
    where = np.minimum(np.searchsorted(one, values), len(one) - 1)
    both = np.add.reduceat((one[where] == values).astype(np.int64), np.cumsum(n) - n)
    return at[both >= least * (n + len(one) - both)]


def shingle_sets(lines: list[str]) -> list[frozenset]:
    """The shingles of every line as hash values of 64 bits."""
    out, lo = [], 0
    while lo < len(lines):
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size + len(lines[hi]) <= _FLAT):
            size += len(lines[hi])
            hi += 1
        values, starts = shingle_values(lines[lo:hi])
        flat, ends = values.tolist(), [*starts.tolist()[1:], len(values)]
        out += [frozenset(flat[a:b]) for a, b in zip(starts.tolist(), ends)]
        lo = hi
    return out


def _link_few(sets: list[frozenset], split: int | None, least: float) -> list[tuple[int, int]]:
    left, out = list(range(len(sets))), []
    while left:
        front = [left.pop(0)]
        while front:
            i = front.pop()
            for j in [j for j in left if split is None or (i < split) != (j < split)]:
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    continue
                both = len(a & b)
                if both >= least * (len(a) + len(b) - both):
                    left.remove(j)
                    out.append((i, j))
                    front.append(j)
    return out


def link_lines(lines: list[str], split: int | None = None, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning edges of the components of similar lines.  With ``split`` only pairs of one
    line before and one line from that place on count."""
    if len(lines) <= FEW:
        return _link_few(shingle_sets(lines), split, least)
    values, at = shingle_values(lines)
    sets = [np.unique(x) for x in np.split(values, at[1:])]
    sizes = np.array([len(x) for x in sets])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    left = np.ones(len(lines), bool)
    side = np.arange(len(lines)) >= (len(lines) if split is None else split)
    out = []
    for k in range(len(lines)):
        if not left[k]:
            continue
        left[k] = False
        front = [k]
        while front:
            i = front.pop()
            at = np.flatnonzero(left if split is None else left & (side != side[i]))
            for j in similar(flat, starts, sizes, sets[i], at, least).tolist():
                left[j] = False
                out.append((i, j))
                front.append(j)
    return out


_NEAR = 44  # bits of a shingle's hash beside the number of its line


def similar_pairs(lines: list[str], least: float = SIMILARITY) -> np.ndarray:
    """Whether lines 0 and 1, 2 and 3, ... are similar: all pairs at once.

    Shared shingles are counted by 44 bits of their hash; a pair near the bound is
    compared again by all of them.
    """
    values, starts = shingle_values(lines)
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    own = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes) << np.uint64(_NEAR)
    keys = np.sort(own | values >> np.uint64(64 - _NEAR))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    line = keys >> np.uint64(_NEAR)
    n = np.bincount(line.astype(np.int64), minlength=len(lines))
    low = np.uint64((1 << _NEAR) - 1)
    pair = np.sort(line >> np.uint64(1) << np.uint64(_NEAR) | keys & low)
    twice = pair[1:][pair[1:] == pair[:-1]] >> np.uint64(_NEAR)
    both = np.bincount(twice.astype(np.int64), minlength=len(lines) // 2)
    gap = both - least * (n[::2] + n[1::2] - both)
    ends = np.concatenate([starts, [len(values)]]).tolist()
    for p in np.flatnonzero(np.abs(gap) < 2).tolist():
        sets = [frozenset(values[ends[i]:ends[i + 1]].tolist()) for i in (2 * p, 2 * p + 1)]
        gap[p] = 0.0 if _link_few(sets, None, least) else -1.0
    return gap >= 0


def _sets_by_group(lines: pa.Array, lengths: np.ndarray, places: list[np.ndarray]):
    """The shingle sets of each group of lines; those of about _FLAT characters are in memory at a time."""
    lo = 0
    while lo < len(places):
        hi, size = lo, 0
        while hi < len(places) and (hi == lo or size + lengths[places[hi]].sum() <= _FLAT):
            size += lengths[places[hi]].sum()
            hi += 1
        sets = iter(shingle_sets(lines.take(pa.array(np.concatenate(places[lo:hi]))).to_pylist()))
        for at in places[lo:hi]:
            yield [next(sets) for _ in at]
        lo = hi


def _verify_batches(least: float):
    def run(batches):
        for batch in batches:
            first, second = batch.column(0), batch.column(1)
            n1 = pc.list_value_length(first).to_numpy(zero_copy_only=False).astype(np.int64)
            n2 = pc.fill_null(pc.list_value_length(second), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            split = np.asarray(pc.is_valid(second), bool)
            a, b = first.flatten(), second.flatten()
            rows = [pa.concat_arrays([a.field(k), b.field(k)]) for k in range(3)]
            h1, h2 = rows[1].to_numpy(), rows[2].to_numpy()
            at1, at2 = np.cumsum(n1) - n1, np.cumsum(n2) - n2 + len(a)
            edges = [np.zeros((0, 2), np.int64)]
            # small groups: every line against the first; if all are similar to it, that is the component
            few = np.flatnonzero(((n1 > 1) & (n1 <= FEW) & ~split) | ((n1 == 1) & (n2 == 1)))
            others = np.where(split[few], 1, n1[few] - 1)
            of = np.repeat(few, others)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(others) - others, others)
            pairs = np.stack([at1[of], np.where(split[of], at2[of], at1[of] + 1) + nth], 1)
            lengths = pc.utf8_length(rows[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.cumsum(lengths[pairs].sum(axis=1)) // _FLAT
            near = [similar_pairs(rows[0].take(pa.array(part.ravel())).to_pylist(), least)
                    for part in (np.split(pairs, np.flatnonzero(np.diff(piece)) + 1) if len(pairs) else [])]
            near = np.concatenate([np.zeros(0, bool), *near])
            edges.append(pairs[near])
            # if a line is not like the first, it may be like another one; larger groups are walked anyway
            open_ = n1 + n2 > 1
            open_[few] = (others > 1) & (np.bincount(of, ~near, minlength=len(n1))[few] > 0)
            walked = np.flatnonzero(open_)
            places = [np.concatenate([np.arange(at1[g], at1[g] + n1[g]), np.arange(at2[g], at2[g] + n2[g])]) for g in walked.tolist()]
            sets = _sets_by_group(rows[0], lengths, [at for at in places if len(at) <= FEW])
            for g, at in zip(walked.tolist(), places):
                cut = int(n1[g]) if split[g] else None
                if len(at) <= FEW:
                    found = _link_few(next(sets), cut, least)
                else:
                    found = link_lines(rows[0].take(pa.array(at)).to_pylist(), cut, least)
                edges.append(at[np.array(found, np.int64).reshape(-1, 2)])
            i, j = np.concatenate(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[i], h2[i], h1[j], h2[j])], names=["a1", "a2", "b1", "b2"])
    return run


def lines_of(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, _key, pos, line, h1, h2): the lines that are compared."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(f"`{doc_id}`", f"`{text}`").alias("_key"),
                    F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))
    # most lines are long: no need to count their code points, or to look beyond their first word
    d = d.filter(((F.octet_length("line") >= 4 * min_chars) | (F.length("line") >= min_chars))
                 & (F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""))
    return d.select("doc_id", "_key", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_roots(lines: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(h1, h2, r1, r2): the component of every line that is similar to another one."""
    # half of the hash is enough for candidates: they are compared by their texts below
    shared = (lines.select("line", "h1").mapInArrow(_band_batches, "band long, h1 long")
              .repartition("band").sortWithinPartitions("band")
              .mapInArrow(_shared_batches, "band long, h1 long").checkpoint())
    # bands with the same lines are compared once
    sums = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("s1"),
                                      F.bit_xor(F.xxhash64("h1")).alias("x1"))
    once = sums.groupBy("n", "s1", "x1").agg(F.min("band").alias("band")).select("band", "n")
    members = shared.join(once, "band")
    # only texts of lines in such bands are shuffled (and the few that the filter lets through besides)
    texts = lines.select("h1", "h2", "line").filter(may_hold(hash_filter(shared, "h1"), F.col("h1"))).dropDuplicates(["h1", "h2"])
    members = members.join(texts, "h1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.col("h1"), blocks)).otherwise(F.lit(0)).cast("int")
    # a line goes to the pair of its block with every block
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = members.select("band", "h1", "h2", "line", own.alias("own"), other.alias("other"))
    members = members.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                             (F.col("own") > F.col("other")).alias("late"), F.struct("line", "h1", "h2").alias("row"))
    pairs = members.groupBy("band", "x", "y").agg(F.collect_list(F.when(~F.col("late"), F.col("row"))).alias("first"),
                                                  F.collect_list(F.when(F.col("late"), F.col("row"))).alias("second"))
    pairs = pairs.select("first", F.when(F.col("x") != F.col("y"), F.col("second")).alias("second"))
    edges = pairs.mapInArrow(_verify_batches(similarity), "a1 long, a2 long, b1 long, b2 long")
    edges = edges.select(F.struct(F.col("a1").alias("p"), F.col("a2").alias("q")).alias("a"),
                         F.struct(F.col("b1").alias("p"), F.col("b2").alias("q")).alias("b"))
    return components(edges, about=shared.count()).select(F.col("node.p").alias("h1"), F.col("node.q").alias("h2"),
                                    F.col("root.p").alias("r1"), F.col("root.q").alias("r2"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, block: int = BLOCK,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that repeat an earlier line taken out of ``text``, and
    n_lines (lines of the text) and removed (positions of the lines taken out).

    The line that stays is the first of its component: smallest doc_id, then position; rows
    without an id come last, ordered by a hash.  Ids are integers.  Defined cases: null text stays null, with 0
    lines; blank and short lines stay; rows of one doc_id are one document, and a line that
    stands at one position of several of them counts once; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    lines = lines_of(docs, doc_id, text, min_chars)
    roots = line_roots(lines, similarity, block)
    # a place is one number: hash aggregates keep a minimum of numbers, not of structs, in place
    span = F.lit(1 << 31).cast("decimal(20,0)")
    number = F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("decimal(20,0)")).otherwise(
        F.lit(str(1 << 64)).cast("decimal(38,0)") + F.col("_key"))
    places = lines.select("doc_id", "_key", "pos", "h1", "h2", (number * span + F.col("pos")).cast("decimal(38,0)").alias("place"))
    # one row per distinct line and task goes into the shuffle; lines met once that are like no other end here
    seen = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = seen.join(roots, ["h1", "h2"], "left").filter("n > 1 or r1 is not null").select(
        "h1", "h2", F.coalesce("r1", "h1").alias("r1"), F.coalesce("r2", "h2").alias("r2"), "first", "n").checkpoint()
    many, stand = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = rooted.groupBy("r1", "r2").agg(F.min("first").alias("stays"))
    repeated = checkpoint_about(rooted.select("h1", "h2", "r1", "r2").join(least, ["r1", "r2"]).select("h1", "h2", "stays"), many)
    gone = places.filter(may_hold(hash_filter(repeated, "h1"), F.col("h1"))).join(repeated, ["h1", "h2"]).filter("place != stays")
    lists = gone.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set("pos")).alias("_pl_gone"))  # bounded by one document
    lists = checkpoint_about(lists.select(F.col("doc_id").alias("_pl_doc"), F.col("_key").alias("_pl_key"), "_pl_gone"), stand)
    own = docs.withColumn("_pl_own", row_key(f"`{doc_id}`", f"`{text}`"))
    # documents that surely lose no line aren't shuffled
    loses = may_hold(hash_filter(lists, "_pl_key"), F.col("_pl_own"))
    some = own.filter(loses).join(lists, F.col(f"`{doc_id}`").eqNullSafe(F.col("_pl_doc")) & (F.col("_pl_own") == F.col("_pl_key")), "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema.fields]
    joined = some.unionByName(own.filter(~loses).select("*", *none))
    t, split = F.col(f"`{text}`"), F.split(F.col(f"`{text}`"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_pl_split") - 1), "_pl_gone")
    made = joined.withColumn("_pl_split", split)
    return made.select(replace_columns(docs, {
        text: F.when(F.col("_pl_gone").isNull(), t).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("_pl_split", i)), "\n")),
        "n_lines": F.when(t.isNull(), 0).otherwise(F.size("_pl_split")),
        "removed": F.coalesce("_pl_gone", F.array().cast("array<int>"))}))
