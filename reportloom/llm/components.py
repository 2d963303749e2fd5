"""Connected components of an edge table by contraction, for any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component for every node of ``edges`` (a, b): component is the smallest node it reaches.

    Each round hooks every node to its least smaller neighbour, follows the hooks to their ends by pointer doubling
    and replaces edges by those between ends, until no edge is left. Hooks always point to smaller nodes, so they
    form trees. Grouping is by an edge's larger end, so a star around its least node, however large, is settled in
    one round without a hot group. Edges with nulls or equal ends link nothing.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct())
    labels = None
    while not pairs.isEmpty():
        hooks = written(pairs.groupBy("hi").agg(F.min("lo").alias("to")).select(F.col("hi").alias("node"), "to"))
        while True:
            ends = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            doubled = written(hooks.select("node", "to").join(ends, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            dropped(hooks)
            hooks = doubled
            if doubled.where("moved").isEmpty():
                break
        a, b = (hooks.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("hi", "lo"))
        moved = pairs.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.coalesce("lo_to", "lo").alias("y"))
        left = written(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi != lo").distinct())
        if labels is None:
            new = written(hooks.select("node", "to"))
        else:
            step = hooks.select(F.col("node").alias("component"), F.col("to").alias("next"))
            old = labels.select("node", F.col("to").alias("component")).join(step, "component", "left").select("node", F.coalesce("next", "component").alias("to"))
            new = written(old.unionByName(hooks.select("node", "to").join(labels.select("node"), "node", "left_anti")))
            dropped(labels)
        dropped(pairs, hooks)
        labels, pairs = new, left
    if labels is None:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    # the ends of hooks are no larger end of any edge
    ends = labels.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
    found = written(labels.select("node", F.col("to").alias("component")).unionByName(ends.join(labels.select("node"), "node", "left_anti")))
    dropped(labels, pairs)
    return found
