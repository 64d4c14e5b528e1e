"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), both long; a component is named by its least node.

    Each round maps every node to the least of its neighbours and itself, follows the map once
    more, and contracts the edges by it. Stars and cliques vanish in one round, paths halve. All
    steps are joins and groupings with partial aggregation; the driver sees only whether edges
    are left. Loops and repeated edges are harmless; rows with a null end are ignored.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("up")), "parents")
        above = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut(least.join(above, "up").select("node", "up", F.col("top").alias("to")), "steps")
        maps.append(step.select("node", "to"))
        to_a, to_b = (step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        kept = edges.join(to_a, "a").join(to_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        own = step.select(F.col("to").alias("a"), "node").join(step.select(F.col("node").alias("a"), F.col("to").alias("b")), "a").select("a", "b")
        edges = cut(kept.unionByName(own).where("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("to", "component")
    for later in maps[1:]:
        found = found.join(later.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(found, "components")
