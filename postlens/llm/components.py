"""Connected components of a distributed edge table (union-find by star contraction).

Alternating large-star and small-star steps: every node hooks its larger neighbours,
then its smaller ones, to the smallest node it sees, until the edges form stars.  A
step is one aggregate (map-side combined, so a hub costs a row per task) and one join;
nothing is collected per node and no edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_about

#: Steps double the contracted distance; this many cover any graph that fits in a cluster.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(back) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    hooked = seen.join(least, "u")
    if large:
        hooked = hooked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hooked = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return hooked.filter("u > v").distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", about: int | None = None) -> DataFrame:
    """(node, root) for every node with an edge to a different one; root is the smallest
    node of its component.  Null ends, loops and repeated edges don't matter; no edges
    give no rows.  Ends may be of any one orderable and hashable type.  ``about`` is a guess at
    the number of edges; it decides the number of files that hold them, nothing else.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = e.checkpoint() if about is None else checkpoint_about(e, about)
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # a large star makes no more edges than it is given, a small star at most twice as many
        e = checkpoint_about(_star(_star(e, True), False), 2 * state[0])
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError("components: no stable state")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
