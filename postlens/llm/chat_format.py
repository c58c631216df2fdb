"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash is
put into every ``<|`` (and one more into ``<\\|`` and so on), so control strings of the
template occur only where the template puts them and every text reads back exactly.

Turns are gathered per conversation by Spark; a task then works on Arrow columns: it
computes the length of every segment (headers, roles, texts, ends), their cumulative
offsets and the scatter indices in numpy, and copies all bytes of a batch into one
preallocated buffer that becomes the Arrow string column as it is.  The loss mask is a
list of byte spans per conversation, one for each text of a loss role.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

START, END = b"<|im_start|>", b"<|im_end|>\n"
BATCH_BYTES = 4 << 20  # bytes of text assembled at a time (a longer conversation is alone)
LONG = 1 << 16  # segments from this length on are copied as a slice, not by index


def _flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null is empty."""
    arr = arr.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    pool = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return pool[offsets[0]: offsets[-1]], offsets - offsets[0]


def escape_pool(pool: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escape all values of a pool at once: a backslash goes in behind each "<" that
    backslashes (or none) and "|" follow in the same value."""
    at = np.array([(m.start(), m.end()) for m in re.finditer(rb"<\\*\|", pool.tobytes())], np.int64).reshape(-1, 2)
    if len(at):
        same = np.searchsorted(offsets, at[:, 0], "right") == np.searchsorted(offsets, at[:, 1] - 1, "right")
        at = at[same, 0]
    else:
        at = at[:, 0]
    if not len(at):
        return pool, offsets
    return np.insert(pool, at + 1, ord("\\")), offsets + np.searchsorted(at, offsets, "left")


def escape_role(role: bytes) -> bytes:
    """Roles stand on one line: backslash and newline are escaped as well."""
    one_line = role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n")
    return re.sub(rb"<(\\*)\|", rb"<\\\1|", one_line)


def assemble(first: np.ndarray, roles: pa.Array, texts: pa.Array, loss_roles: frozenset) -> tuple[pa.Array, pa.Array]:
    """Formatted strings and loss spans; ``first`` has each conversation's first turn and the end."""
    n = len(roles)
    pool, text_at = escape_pool(*_flat(texts))
    kinds = roles.fill_null("").dictionary_encode()
    names = [x.as_py().encode() for x in kinds.dictionary]
    heads = [START + escape_role(x) + b"\n" for x in names]
    head_len = np.array([len(x) for x in heads] or [0], np.int64)
    head_at = np.cumsum(head_len) - head_len
    kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    fixed = np.frombuffer(b"".join(heads) + END, np.uint8)
    source = np.concatenate([fixed, pool])

    src, size = np.empty((n, 3), np.int64), np.empty((n, 3), np.int64)
    src[:, 0], size[:, 0] = head_at[kind] if n else 0, head_len[kind] if n else 0
    src[:, 1], size[:, 1] = text_at[:-1] + len(fixed), np.diff(text_at)
    src[:, 2], size[:, 2] = len(fixed) - len(END), len(END)
    src, size = src.ravel(), size.ravel()
    dst = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(dst[-1]), np.uint8)
    long = size >= LONG
    for k in np.flatnonzero(long):
        out[dst[k]: dst[k + 1]] = source[src[k]: src[k] + size[k]]
    short = np.where(long, 0, size)
    index = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
    out[index + np.repeat(dst[:-1], short)] = source[index + np.repeat(src, short)]

    row_at = dst[3 * first]
    strings = pa.Array.from_buffers(pa.string(), len(first) - 1,
                                    [None, pa.py_buffer(row_at.astype(np.int32)), pa.py_buffer(out)])
    in_loss = np.array([x.decode() in loss_roles for x in names] or [False])[kind] if n else np.zeros(0, bool)
    turns = np.flatnonzero(in_loss)
    row = np.searchsorted(first, turns, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(dst[3 * turns + 1] - row_at[row]), pa.array(dst[3 * turns + 2] - row_at[row])],
                                       ["start", "end"])
    counts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(first) - 1))))
    return strings, pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), spans)


def _batches(loss_roles: frozenset):
    def run(batches):
        for batch in batches:
            turns = batch.column("turns")
            flat = turns.flatten()
            first = turns.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            roles, texts = flat.field("role"), flat.field("text")
            sizes = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
            weight = np.concatenate(([0], np.cumsum(sizes)))
            lo, rows = 0, len(first) - 1
            while lo < rows:
                hi = int(np.searchsorted(weight[first], weight[first[lo]] + BATCH_BYTES, "right")) - 1
                hi = min(max(hi, lo + 1), rows)
                a, b = first[lo], first[hi]
                strings, spans = assemble(first[lo: hi + 1] - a, roles.slice(a, b - a), texts.slice(a, b - a), loss_roles)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(lo, hi - lo), strings, spans],
                                                 ["conv_id", "formatted", "loss"])
                lo = hi
    return run


def format_conversations(convs: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation, turns in order of ``turn``
    (null first), ties by role and text; loss: byte spans [start, end) of the UTF-8 text.

    Defined cases: null text and null role are empty; repeated rows are turns of their
    own; a null conv_id is a conversation like others; an empty table gives no rows.
    """
    bound_batches(convs.sparkSession)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                 F.coalesce("text", F.lit("")).alias("text"))))
    nullable = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return convs.groupBy("conv_id").agg(nullable.alias("turns")).mapInArrow(
        _batches(frozenset(loss_roles)), "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


# ---- reading back -------------------------------------------------------------------

def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def unescape_role(c: Column) -> Column:
    parts = F.split(unescape(c), r"\\\\")  # what stands between escaped backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.regexp_extract(t, r"^([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = F.encode(formatted, "UTF-8")
    parts = F.transform(loss, lambda s: unescape(F.decode(F.substring(
        raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))
    return F.array_join(parts, "")
