"""Distributed connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpointing import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, the component being its smallest node.

    Every node points to a node of its component. A round looks up where a node's pointer points to
    (its grandparent), takes the least grandparent among its neighbours, and lowers both its own
    pointer and that of the node it points to; hooking the latter joins whole trees, so that rounds
    grow with the logarithm of the longest path: 15 for chains of 10,000 nodes in any order.
    Pointers are written to the shared folder in each round, and those of the round before are removed.
    Minima are combined before each shuffle, and a hub's links meet the pointers in a plain
    equi-join, which adaptive execution may split. Pointers only fall, so that rounds end by
    themselves and need no limit. Nulls and links of a node to itself add nothing; an empty table
    gives an empty one.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    held = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("f")), "pointers")
    while True:
        above = held.select(F.col("node").alias("f"), F.col("f").alias("top"))
        looked = held.select("node", "f").join(above, "f").select("node", "f", "top")
        near = both.join(looked.select(F.col("node").alias("a"), "top"), "a").groupBy(F.col("b").alias("node")).agg(F.min("top").alias("near"))
        seen = looked.join(near, "node")
        own = seen.select("node", F.col("f").alias("old"), F.least("top", "near").alias("new"))
        hooked = seen.select(F.col("f").alias("node"), F.lit(None).cast(seen.schema["f"].dataType).alias("old"), F.col("near").alias("new"))
        step = own.union(hooked).groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("f"))
        step = materialize(step.select("node", "old", F.least("old", "f").alias("f")), "pointers")
        discard(held)
        held = step
        if step.where("f <> old").isEmpty():
            discard(both)
            return step.select("node", F.col("f").alias("component"))
