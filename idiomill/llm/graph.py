"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the edge list; hubs with very many
edges are pre-aggregated by ``min`` and split by adaptive skew joins. Edges and labels
stay in Spark; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(u long, root long) for every node that has an edge in ``edges`` (u, v).

    root is the smallest node id of the component. Self loops are ignored; an empty
    edge list gives an empty result.
    """
    now = scratch.keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(moved.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "edges")
        before, state = state, _state(new)
        scratch.drop(now)
        now = new
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.select("u", F.col("v").alias("root")).unionByName(roots)
