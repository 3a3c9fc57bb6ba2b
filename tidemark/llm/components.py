"""Connected components by min-label contraction, as DataFrame joins and aggregates.

Each round points every vertex at the least vertex next to it, follows the pointers to their
ends by doubling, contracts the edges to those ends, and drops loops and repeats. At least half of
the vertices that still have an edge go in each round. Only aggregates with map-side combining and plain
equi-joins on a unique side are used, so a hub's edges can be split over tasks. No
vertex list and no component leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _ends(to: DataFrame) -> DataFrame:
    """Pointers (v, to) to lesser vertices, each followed to its end; an end points at itself."""
    while True:
        on = to.select(F.col("v").alias("at"), F.col("to").alias("next"))
        moved = to.join(on, F.col("to") == F.col("at")).select("v", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        moved = checkpointed(moved)
        to = moved.select("v", "to")
        if moved.where("moved").isEmpty():
            return to


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of edges (a, b): the least vertex reachable.

    Nulls and loops make no link; repeated edges count once; no edges give no rows.
    Vertices without an edge to another are not returned.
    """
    links = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    for _ in range(rounds):
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        to = _ends(checkpointed(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to"))))
        if labels is None:
            labels = to.select(F.col("v").alias("id"), F.col("to").alias("component"))
        else:
            labels = labels.join(to, labels.component == to.v, "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = checkpointed(labels)
        left = to.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        links = links.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        links = checkpointed(links.where("a < b").distinct())
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
