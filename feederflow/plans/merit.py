"""Dispatch without a solver: one bus, no coupling in time. One running sum per snapshot gives dispatch, price and unserved energy exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def demand(loads: DataFrame, snapshots: DataFrame, profile: DataFrame) -> DataFrame:
    """``(t, demand)``: the profile where there is one, else the load's set value."""
    each = loads.select("load_id", "p_set").join(snapshots.select("t")).join(profile, ["load_id", "t"], "left")
    return each.groupBy("t").agg(F.sum(F.coalesce("value", "p_set")).alias("demand"))


def stack(generators: DataFrame) -> DataFrame:
    """The merit order: ``below`` and ``upto`` bound each unit's part of the stack."""
    order = Window.orderBy("marginal_cost", "gen_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("p_nom").over(order)
    return generators.select("gen_id", "marginal_cost", "p_nom", (upto - F.col("p_nom")).alias("below"), upto.alias("upto"))


def dispatch(generators: DataFrame, demand: DataFrame) -> DataFrame:
    """``(gen_id, t, mw)`` of the running units."""
    run = F.least(F.greatest(F.col("demand") - F.col("below"), F.lit(0.0)), F.col("p_nom"))
    return stack(generators).join(demand, F.col("below") < F.col("demand")).select("gen_id", "t", run.alias("mw")).where("mw > 0")


def price_and_shed(generators: DataFrame, demand: DataFrame, value_of_lost_load: float) -> DataFrame:
    """``(t, demand, price, shed)``: the cheapest cost whose stack covers the demand, or the value of lost load.

    Demands and the ends of the stack's steps are sorted together: from the top down, the last step seen is the
    one that covers a demand, so nothing is compared pair by pair.
    """
    s = stack(generators)
    total = s.agg(F.coalesce(F.sum("p_nom"), F.lit(0.0)).alias("all"))
    none = F.lit(None)
    steps = s.select(none.cast("int").alias("t"), F.col("upto").alias("at"), F.lit(0).alias("kind"), F.col("marginal_cost").alias("cost"), F.col("gen_id").cast("bigint").alias("place"))
    asked = demand.select(F.col("t").cast("int").alias("t"), F.col("demand").alias("at"), F.lit(1).alias("kind"), none.cast("double").alias("cost"), none.cast("bigint").alias("place"))
    down = Window.orderBy(F.desc("at"), "kind", F.desc("cost"), F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = steps.unionByName(asked).withColumn("price", F.last("cost", ignorenulls=True).over(down)).where("kind = 1")
    return covered.join(total).select("t", F.col("at").alias("demand"), F.coalesce("price", F.lit(value_of_lost_load)).alias("price"), F.greatest(F.col("at") - F.col("all"), F.lit(0.0)).alias("shed"))
