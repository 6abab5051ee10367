"""Connected components by alternating large and small stars (Kiveris et al., 2014), in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stage


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links to (id, root): the smallest identifier reachable from each linked node.

    A node's smallest neighbour comes from partial aggregates, so that a node with a third of all links is never
    gathered in one task; the join that gives it back to the links is a plain equi-join, which AQE splits under skew.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = stage(links, "links")
    mark = _mark(links)
    for _ in range(most_rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("low", "u").alias("low"))
        # every larger neighbour of a node is linked to the node's smallest neighbour
        large = links.join(low, F.col("v") == F.col("w")).select("u", F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        )
        before, links = links, stage(small.select("e.*").where("u <> v").distinct(), "links")
        discard(before)
        was, mark = mark, _mark(links)
        if was == mark:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(roots)


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
