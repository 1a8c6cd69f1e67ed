"""Connected components of links, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.llm.common import materialize


def components(links: DataFrame, scratch: list[str], rounds: int = 60) -> DataFrame:
    """Rows (id, component) of every id in links (columns a, b); component is the least id that links reach.

    Each step is written to the shared scratch folder, so lineage stays short; the number of steps grows with the
    logarithm of the longest chain. Only counts come to the driver. A hub's neighbours meet only in sums and joins
    that Spark can combine or split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "edges", scratch)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialize(small, "edges", scratch)
        # A forest of stars: no component is also a member.
        state = edges.agg(F.count("*"), F.sum("v"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
