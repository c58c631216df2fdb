"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words.  The CGK random walk reads a window of words with a pointer
that moves on by a random bit of (step, word): two windows at a small edit distance walk
together again soon after each edit, so their outputs differ in few places (a Hamming
distance).  Bit sampling then hashes a few places of the output per table, for several
tables and several independent walks.  Windows are as long as the shortest item of a
class of benchmark items of like size; every window of every item is in the tables and
every window of every document is looked up, so one little-edited stretch of an item is
enough.  A hit is verified exactly: the edit distance of the whole item to the best place
of the document around it, in words.

The tables of the benchmark are built in blocks of a bounded number of words and sent to
the executors; documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from .common import bound_batches

#: An item is found where at most this share of its words is inserted, deleted or replaced.
MAX_EDITS = 0.2
#: Items with fewer words are not looked for: such phrases occur by chance.
MIN_ITEM_WORDS = 8
WALKS, TABLES, PLACES = 2, 5, 5  # independent walks, tables of each, sampled places of a table
#: Words of the benchmark whose tables are held at a time; a larger one is taken in blocks.
BLOCK_WORDS = 500_000
CHUNK = 1 << 14  # words of documents walked at a time
SEARCH_BYTES = 1 << 20  # bytes of documents hashed and searched together (a longer one alone)
STEP = 3  # candidate places this close are verified together
#: Letters (ASCII in lower case), digits and bytes beyond ASCII; all else becomes a space.
_LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_PAD = np.uint64(0xD1B54A32D192ED03)
_SEEDS = np.random.default_rng(41).integers(1, 1 << 63, (WALKS, 64), dtype=np.uint64)
_ODD = np.random.default_rng(43).integers(1, 1 << 32, 64, dtype=np.uint32) | np.uint32(1)
_PAD32 = _PAD.astype(np.uint32)
#: Steps after which windows whose walks have met are walked as one.
MEETINGS = (3, 9, 21)
PIECE = 1 << 16  # bytes of a text whose words are hashed at a time
MIN_BITMAP, MAX_BITMAP = 16, 28  # bits of a key that a bitmap of the keys looks at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    p = 0x9E3779B97F4A7C15
    ones = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([ones, np.full(n - 1, x, np.uint64)])) for x in (p, pow(p, -1, 1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWER, _BACK = _powers(2 * PIECE)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, all at once: differences of a running polynomial sum."""
    return words_of([text])[0]


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text; short texts are hashed together."""
    flat = b" ".join([*texts, b""]).translate(_LETTERS)  # a space ends every text
    out, places, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(flat):
        hi = flat.find(b" ", min(lo + PIECE, len(flat) - 1)) + 1
        b = np.frombuffer(flat, np.uint8, hi - lo, lo)
        letter = np.empty(len(b) + 1, bool)
        letter[0] = False
        np.not_equal(b, 32, out=letter[1:])
        edges = np.flatnonzero(letter[1:] != letter[:-1])  # the last byte is a space
        first, end = edges[::2], edges[1::2]
        power, back = (_POWER, _BACK) if len(b) < len(_POWER) else _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(power[: len(b)] * b, out=total[1:])
        out.append(_mix((total[end] - total[first]) * back[first]))
        places.append(first + lo)
        lo = hi
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(np.concatenate(out), np.searchsorted(np.concatenate(places), ends)) if texts else []


def sampled_places(width: int) -> np.ndarray:
    """(walk, table, place): the steps whose output a table reads.  A pointer moves at every
    second step on average, so 2 * width steps read a window."""
    rng = np.random.default_rng(1000 + width)
    return np.sort(np.stack([[rng.choice(2 * width, min(PLACES, 2 * width), replace=False) for _ in range(TABLES)]
                             for _ in range(WALKS)]), axis=2)


def reading_plan(widths: list[int]) -> list[dict[int, dict[int, list]]]:
    """For each walk the steps that are read, and which (row of keys, place) of which width reads them."""
    places = [sampled_places(w) for w in widths]
    plan: list[dict[int, dict[int, list]]] = [{} for _ in range(WALKS)]
    for r in range(WALKS):
        for c, sampled in enumerate(places):
            for t in range(TABLES):
                for k, j in enumerate(sampled[r, t]):
                    plan[r].setdefault(int(j), {}).setdefault(c, []).append((r * TABLES + t, k))
    return plan


def walk_keys(words: np.ndarray, widths: list[int], plan: list | None = None) -> list[np.ndarray]:
    """For each width: keys (walk * table, window) of the windows that start at each word.

    Walks of neighbouring windows meet and go on together, so from time to time only those
    that are still apart are kept on (``at``, with ``group`` telling each window's walk).
    """
    n = len(words)
    padded = np.concatenate([words, np.full(2 * max(widths) + 1, _PAD)])
    symbols = padded.astype(np.uint32)
    base = np.arange(n)
    keys = [np.zeros((WALKS * TABLES, n), np.uint32) for _ in widths]
    symbol, term, place = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.int64)
    for r, reads in enumerate(plan or reading_plan(widths)):
        at, group, move = base.copy(), None, np.empty(n, np.uint64)
        for j in range(max(reads) + 1):
            if j % 64 == 0:
                coins = _mix(padded ^ _SEEDS[r, j // 64 % 64] ^ np.uint64(j // 64))
            if j in reads:
                now = at if group is None else at.take(group, out=place, mode="clip")
                symbols.take(now, out=symbol, mode="clip")
                for c, tables in reads[j].items():
                    # a pointer that has left the window reads padding; it can't have before step width
                    seen = symbol if j < widths[c] else np.where(now - base < widths[c], symbol, _PAD32)
                    for t, k in tables:
                        np.multiply(seen, _ODD[k], out=term)
                        keys[c][t] += term
            coins.take(at, out=move, mode="clip")
            move >>= np.uint64(j % 64)
            move &= np.uint64(1)
            at += move.view(np.int64)
            if j in MEETINGS:
                apart = np.empty(len(at), bool)
                apart[:1] = True
                np.not_equal(at[1:], at[:-1], out=apart[1:])  # walks never overtake each other
                met = np.cumsum(apart) - 1
                at, group = at[apart], met if group is None else met[group]
                move = np.empty(len(at), np.uint64)
    for k in keys:  # the tables look at the high bits
        k ^= k >> np.uint32(16)
        k *= np.uint32(0x9E3779B1)
    return keys


@dataclass
class Table:
    """Sorted keys of all item windows of one width and table, and a bitmap of them."""
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    shift: np.uint32


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    widths: list[int] = field(default_factory=list)
    tables: list[list[Table]] = field(default_factory=list)
    _distinct: list[frozenset] = field(default_factory=list)
    _plan: list = field(default_factory=list)

    @property
    def distinct(self) -> list[frozenset]:
        if len(self._distinct) != len(self.items):
            self._distinct[:] = [frozenset(x.tolist()) for x in self.items]
        return self._distinct

    @classmethod
    def build(cls, ids: list, items: list[np.ndarray]) -> Index:
        self = cls(ids, items)
        sizes = sorted({len(x) for x in items if len(x) >= MIN_ITEM_WORDS})
        while sizes:  # a class: items of up to twice the size of its shortest
            width = sizes[0]
            members = [k for k, x in enumerate(items) if width <= len(x) < 2 * width]
            sizes = [n for n in sizes if n >= 2 * width]
            keys, item, offset = [], [], []
            for k in members:
                n = len(items[k]) - width + 1
                keys.append(walk_keys(items[k], [width])[0][:, :n])
                item.append(np.full(n, k, np.int32))
                offset.append(np.arange(n, dtype=np.int32))
            keys, item, offset = np.concatenate(keys, 1), np.concatenate(item), np.concatenate(offset)
            tables = []
            for row in keys:
                order = np.argsort(row, kind="stable")
                shift = np.uint32(32 - min(MAX_BITMAP, max(MIN_BITMAP, len(row).bit_length() + 5)))
                bitmap = np.zeros(1 << (32 - int(shift)), bool)
                bitmap[row >> shift] = True
                tables.append(Table(row[order], item[order], offset[order], bitmap, shift))
            self.widths.append(width)
            self.tables.append(tables)
        return self

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, window, place): at the window the item may stand, beginning about the
        place, which may lie outside."""
        found = [np.zeros((0, 3), np.int64)]
        self._plan = self._plan or reading_plan(self.widths)
        for c, keys in enumerate(walk_keys(words, self.widths, self._plan)) if self.widths else ():
            for table, row in zip(self.tables[c], keys):
                at = np.flatnonzero(table.bitmap.take((row >> table.shift).astype(np.int64), mode="clip"))
                if not len(at):
                    continue
                lo = np.searchsorted(table.keys, row[at], "left")
                n = np.searchsorted(table.keys, row[at], "right") - lo
                at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
                if len(at):
                    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(at, n)
                    found.append(np.stack([table.item[k], at, at - table.offset[k]], 1))
        return np.concatenate(found)


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a part of the region, and where that part ends."""
    ramp = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for w in item:
        step = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (region != w)]))
        row = np.minimum.accumulate(step - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def verify(words: np.ndarray, item: np.ndarray, distinct: frozenset, place: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the item around a candidate place, if it is there."""
    most = int(MAX_EDITS * len(item))
    slack = max(most, 2) + 4
    lo, hi = max(0, place - slack), min(len(words), place + len(item) + slack)
    region = words[lo:hi]
    # each distinct word that is missing costs an edit
    if len(region) < len(item) - most or len(distinct.difference(region.tolist())) > most:
        return None
    distance, end = edit_distance(item, region)
    if distance > most:
        return None
    back, length = edit_distance(item[::-1], region[:end][::-1])
    return lo + end - length, lo + end, min(distance, back)


def search(index: Index, texts: list[np.ndarray]) -> list[list[dict]]:
    """Places of items in each text."""
    gap = 2 * max(index.widths, default=1) + 1  # no window reads on into the next text
    flat = np.concatenate([x for t in texts for x in (t, np.full(gap, _PAD))]) if texts else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *(len(t) + gap for t in texts)])
    seen = [np.zeros((0, 3), np.int64)]
    for lo in range(0, len(flat), CHUNK):
        rows = index.candidates(flat[lo: lo + CHUNK + gap])
        rows = rows[rows[:, 1] < CHUNK]  # windows that start in this part
        doc = np.searchsorted(starts, lo + rows[:, 1], "right") - 1
        seen.append(np.stack([doc, rows[:, 0], (lo + rows[:, 2] - starts[doc]) // STEP], 1))
    best: dict[tuple[int, int], list] = {}
    for d, item, step in np.unique(np.concatenate(seen), axis=0).tolist():
        done, place = best.setdefault((d, item), []), step * STEP + 1
        if any(a - STEP <= place <= a + STEP for a, _, _ in done):
            continue
        hit = verify(texts[d], index.items[item], index.distinct[item], place)
        if hit:
            # of places that overlap the best one counts
            over = [h for h in done if h[0] < hit[1] and hit[0] < h[1]]
            if all(hit[2] < h[2] for h in over):
                done[:] = [h for h in done if h not in over] + [hit]
    out: list[list[dict]] = [[] for _ in texts]
    for (d, item), hits in best.items():
        for a, b, distance in hits:
            out[d].append({"item_id": index.ids[item], "start": a, "end": b, "distance": distance})
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Index after index; each holds items of about ``block_words`` words."""
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // (5 * block_words)))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted({(r["id"] is None, r["id"] or 0, bytes(r["text"])) for r in part.collect() if r["text"] is not None})
        yield Index.build([None if none else i for none, i, _ in rows], [word_hashes(t) for _, _, t in rows])


def _searcher(shared):
    def run(batches):
        for s in batches:
            texts, out, size = [], [], 0
            for x in s:
                texts.append(x or b"")
                size += len(texts[-1])
                if size > SEARCH_BYTES:
                    out += search(shared.value, words_of(texts))
                    texts, size = [], 0
            yield pd.Series(out + search(shared.value, words_of(texts)), dtype=object)
    return run


def find_items(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id",
               item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``hits``: array<struct<item_id, start, end, distance>>, places in words.

    Words are runs of letters and digits (ASCII lower-cased); other characters part them.
    Defined cases: null and empty texts and an empty benchmark give no hits; null and short
    items (MIN_ITEM_WORDS) are not looked for; repeated items count once, equal texts under
    several ids each count; repeated rows stand alone.  Very long texts are walked in chunks.
    """
    kind = "array<struct<item_id:long,start:int,end:int,distance:int>>"
    spark = docs.sparkSession
    bound_batches(spark)
    hits = F.array().cast(kind)
    for index in blocks(benchmark, item_id, item_text, block_words):
        if not index.widths:
            continue
        found = pandas_udf(_searcher(spark.sparkContext.broadcast(index)), kind, PandasUDFType.SCALAR_ITER)
        hits = F.concat(hits, found(F.col(f"`{doc_text}`").cast("binary")))
    keep = [c for c in docs.columns if c != "hits"]
    return docs.select(*[F.col(f"`{c}`") for c in keep], hits.alias("hits"))
