"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencespark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by one of its nodes.

    Each round hooks every node to its smallest neighbour (smallest by a hash, so that chains shrink too), follows
    two hooks, and replaces the edges by those between different hooks; a round leaves a fraction of the nodes, so
    their number of rounds is logarithmic. Rounds work on written tables of edges; hubs are combined before the
    shuffle and joined where adaptive execution splits them.
    """
    live = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    hooks = []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        hook = stored(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["b"].alias("to")), "hooks")
        for _ in range(2):
            further = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = stored(hook.join(further, "to").select("node", F.col("next").alias("to")), "hooks")
        hooks.append(hook)
        for end in ("a", "b"):
            live = live.join(hook.select(F.col("node").alias(end), F.col("to").alias("_to")), end)
            live = live.drop(end).withColumnRenamed("_to", end)
        live = stored(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    found = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("component"), F.col("to").alias("_to"))
        found = found.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return stored(found, "components")
