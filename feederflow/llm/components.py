"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.common import drop_stage, stage


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """One row ``(node, label)`` for each node of an edge: ``label`` is the smallest node of its component.

    ``edges`` has two BIGINT columns; nulls and loops are ignored, repeated edges count once, no edges give no rows.
    A round is two grouped minima (combined before the shuffle) and two joins on the node, so a node with
    very many edges is spread by the skew join; nothing is gathered on the driver but the count and a hash
    of the edges, by which the loop sees that they no longer change. Each round's edges are a table in the
    shared folder, and the previous round's table goes.
    """
    u, v = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    e = stage(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), u.alias("_u"), v.alias("_v")).where("_u is not null and _v is not null and a > b").select("a", "b").distinct(), "edges")
    seen = _digest(e)
    if seen[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u and v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(small.unionAll(floor.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        drop_stage(large)
        drop_stage(e)
        e, before, seen = new, seen, _digest(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)
