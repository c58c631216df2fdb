"""Merkle dataset manifest by nested-interval labels.

The leaves of a group are numbered 0, 1, ... in order.  Every node carries the interval
[lo, hi) of leaf ranks that it covers; a node of level l starts at a multiple of
``FAN ** l``, and that multiple is its bucket.  Building goes up: the nodes of a bucket one
level higher are gathered (at most FAN rows) and hashed.  Attaching ancestors goes down: a
node is joined, by group and bucket and by containment of its interval, with its parent,
which brings its own path along.  The parent's interval without the node's own leaves the
siblings: those that end before it and those that begin after it.

A join never has more than FAN rows of a key, whatever the size of a group.  Numbering is a
range partition with a count per partition, so a hot group is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import replace_columns

FAN = 16
#: Rows of the table of (partition, group) counts that are sent to every executor; beyond it the join is shuffled.
MAX_BROADCAST = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical(*values: Column | str) -> Column:
    """Each value as UTF-8 byte count, colon and value, null as a minus, one after the other."""
    def one(v: Column | str) -> Column:
        s = (F.col(v) if isinstance(v, str) else v).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.concat(*[one(v) for v in values])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (0, 1, ... in each group, by ``order``) and ``width`` (rows of the group).

    Rows are range-partitioned by group and order; a row's rank is its place in its
    partition plus what earlier partitions hold of its group.  Rows that are equal in all of
    that are spread by their place in the input.  The result is written to the checkpoint
    folder, as places in a partition must not change afterwards.
    """
    by = [F.col(group).asc_nulls_first(), *order, F.col("_at")]
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    placed = placed.checkpoint().withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).checkpoint()
    # a row per partition and group: a group of any size has at most one per partition
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(group)).alias("width"))
    if counts.count() <= MAX_BROADCAST:
        starts = F.broadcast(starts)
    joined = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_p", "_g", "_first", "_before")


def _parents(nodes: DataFrame, group: str, level: int, fan: int) -> DataFrame:
    """Nodes of ``level`` over those of the level below: (group, width, lo, hi, children, hash)."""
    up = nodes.groupBy(group, "width", F.expr(f"lo div {fan ** level}L").alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"))  # at most fan of them
    return up.select(group, "width", F.get("children", F.lit(0))["lo"].alias("lo"),
                     F.element_at("children", -1)["hi"].alias("hi"), "children",
                     sha(F.array_join(F.transform("children", lambda c: c["hash"]), "")).alias("hash"))


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """What a parent's interval leaves beside [lo, hi): the hashes before and after it, joined."""
    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(children, keep), lambda c: c["hash"]), "")
    return F.struct(side(lambda c: c["hi"] <= lo).alias("left"), side(lambda c: c["lo"] >= hi).alias("right"))


class Tree:
    """A Merkle tree over the rows of every group; ``levels[k]`` are the nodes of level k + 1."""

    def __init__(self, leaves: DataFrame, group: str, fan: int = FAN):
        """``leaves``: rank and width (see :func:`numbered`), the group, hash, and any other columns."""
        self.group, self.fan = group, fan
        widest, reach = leaves.agg(F.max("width")).first()[0] or 0, 1
        self.leaves = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1).drop("rank")
        self.levels: list[DataFrame] = []
        below = self.leaves.filter("width > 1")
        while reach < widest:
            reach *= fan
            self.levels.append(_parents(below, group, len(self.levels) + 1, fan).checkpoint())
            below = self.levels[-1].filter("hi - lo < width")

    def roots(self) -> DataFrame:
        """(group, hash): the node that covers the whole group; a lone leaf itself."""
        out = self.leaves.filter("width = 1").select(self.group, "hash")
        for nodes in self.levels:
            out = out.unionByName(nodes.filter("hi - lo = width").select(self.group, "hash"))
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with the columns of ``tops``, whose ``path`` is led on down to the leaf.

        ``tops``: a row per group with what comes above its root, ``path`` among it.  A path is an
        array of (left, right), the hashes of a node's siblings, from the leaf's level up.
        """
        brought = [c for c in tops.columns if c != self.group]
        tops = tops.select(F.col(self.group).alias("_g"), *brought)
        above = None  # the nodes one level up, with their paths and children
        for level in range(len(self.levels), -1, -1):
            nodes = self.levels[level - 1] if level else self.leaves
            here = nodes.filter("hi - lo = width").join(tops, F.col(self.group).eqNullSafe(F.col("_g"))).drop("_g")
            if above is not None:
                bucket = F.expr(f"lo div {self.fan ** (level + 1)}L")
                parent = above.select(F.col(self.group).alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                                      F.col("children").alias("_children"), bucket.alias("_up"), *brought)
                child = nodes.filter("hi - lo < width").withColumn("_bucket", bucket)
                inside = (F.col(self.group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_up"))
                          & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
                longer = F.concat(F.array(_siblings(F.col("_children"), F.col("lo"), F.col("hi"))), F.col("path"))
                here = here.unionByName(child.join(parent, inside).withColumn("path", longer).drop("_g", "_lo", "_hi", "_children", "_up", "_bucket"))
            above = here.checkpoint() if level else here
        return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, s: sha(F.concat(s["left"], h, s["right"])))


def proof(path: Column) -> Column:
    """Hash of all siblings on a path, from the leaf's level up and from left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(rows: DataFrame, leaf: Column, group: str, order: list[str], fan: int = FAN) -> DataFrame:
    """``rows`` with ``leaf``, ``subroot`` (of its group), ``root`` (of all) and ``path`` (siblings up to the root).

    Leaves of a group are in ascending order of the columns ``order`` (nulls first), then of
    their hash; every ``fan`` neighbours become one node, the last ones maybe fewer, until one
    is left; the groups' subroots, ordered by group (null first, bytewise), likewise.

    Defined cases: a null group is a group; a group of one row has its leaf as subroot, a single
    group its subroot as root; rows that are equal in order and leaf are leaves of their own, one
    after the other; an empty table gives no rows.  Columns named like the added ones are replaced.
    """
    named = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns)],
                        F.col(f"`{group}`").alias("_group"), leaf.alias("hash")).checkpoint()  # texts are hashed once
    at = {c: F.col(f"_c{i}") for i, c in enumerate(rows.columns)}
    tree = Tree(numbered(named, "_group", [*[at[c].asc_nulls_first() for c in order], F.col("hash")]), "_group", fan)
    subroots = tree.roots().select(F.lit(0).alias("_all"), F.col("_group").alias("_name"), "hash").checkpoint()
    over = Tree(numbered(subroots, "_all", [F.col("_name").asc_nulls_first()]), "_all", fan)
    none = F.array().cast("array<struct<left: string, right: string>>")
    tops = over.paths(over.roots().select("_all", F.col("hash").alias("root"), none.alias("path")))
    made = tree.paths(tops.select(F.col("_name").alias("_group"), F.col("hash").alias("subroot"), "root", "path").checkpoint())
    made = made.select(*[c.alias(f"_pl_{i}") for i, c in enumerate(at.values())],
                       *[F.col(c).alias(f"_pl_{c}") for c in ("hash", "subroot", "root", "path")])
    back = made.select(*[F.col(f"_pl_{i}").alias(c) for i, c in enumerate(rows.columns)],
                       *[F.col(f"_pl_{c}") for c in ("hash", "subroot", "root", "path")])
    return back.select(replace_columns(rows, {"leaf": F.col("_pl_hash"), **{c: F.col(f"_pl_{c}") for c in ("subroot", "root", "path")}}))
