"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two shuffles over the links: the least neighbour of every node is a partially aggregated minimum, and the
join that brings it back is one that Spark can split when a node has very many links. Links never reach the driver;
only their number and a checksum do. Every step's table lies in the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.shared import discard, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b, distinct. Large: every node's larger neighbours go to its least neighbour. Small: its smaller
    neighbours and itself do."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
    met = both.join(least, both["a"] == least["n"])
    if large:
        moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b (equal types). Returns node, component for every node of a link between different nodes:
    component is the least node that it reaches. Null ends and loops count for nothing; repeated links do no harm;
    no links give no rows."""
    pairs = links.filter("a is not null and b is not null and a <> b")
    now = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        large = materialise(_star(now, True), "links")
        small = materialise(_star(large, False), "links")
        before, state = state, _state(small)
        discard(now)
        discard(large)
        now = small
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
