"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum (partial aggregation) and a join that adaptive
execution may split, so a node with very many links is never one task's group.
The link table is cut to a table in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logarbor.llm.tools import written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each directed pair with the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node of the component; only nodes that have a link, roots left out.

    Links between a node and itself and null ends are ignored; an empty table gives an empty result.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct())
    edges = written(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _star(large)
        small = (down.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        edges = written(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
