"""Carbon accounts of a solved network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.network import Network


def energy(net: Network, dispatch: DataFrame) -> DataFrame:
    """``(gen_id, bus_id, carrier, co2, mwh, tonnes)``: each generator's weighted energy and emissions."""
    mwh = dispatch.join(net["snapshots"].select("t", "weight"), "t").groupBy("gen_id").agg(F.sum(F.col("mw") * F.col("weight")).alias("mwh"))
    return mwh.join(net["generators"], "gen_id").select("gen_id", "bus_id", "carrier", F.col("co2_emissions").alias("co2"), "mwh", (F.col("mwh") * F.col("co2_emissions")).alias("tonnes"))


def by_generator(net: Network, dispatch: DataFrame) -> DataFrame:
    return energy(net, dispatch).select("gen_id", "tonnes")


def production_by_country(net: Network, dispatch: DataFrame) -> DataFrame:
    """``(country, tonnes, first)``: emissions where they arise, ``first`` the country's first bus."""
    return energy(net, dispatch).join(net["buses"].select("bus_id", "country"), "bus_id").groupBy("country").agg(F.sum("tonnes").alias("tonnes"), F.min("bus_id").alias("first"))


def by_carrier(net: Network, dispatch: DataFrame) -> DataFrame:
    """``(carrier, tonnes, mwh, intensity)``: no intensity below a billionth of a MWh."""
    per = energy(net, dispatch).groupBy("carrier").agg(F.sum("tonnes").alias("tonnes"), F.sum("mwh").alias("mwh"))
    return per.withColumn("intensity", F.when(F.col("mwh") > 1e-9, F.try_divide("tonnes", "mwh")))


def average_intensity(net: Network, dispatch: DataFrame) -> DataFrame:
    per = energy(net, dispatch).agg(F.coalesce(F.sum("tonnes"), F.lit(0.0)).alias("tonnes"), F.coalesce(F.sum("mwh"), F.lit(0.0)).alias("mwh"))
    return per.select("tonnes", "mwh", F.coalesce(F.try_divide("tonnes", "mwh"), F.lit(0.0)).alias("intensity"))


def intensity(net: Network, dispatch: DataFrame, flows: DataFrame) -> DataFrame:
    """``(t, bus_id, intensity, traced)`` by proportional sharing: power that leaves a bus has the mix of what enters it.

    One linear system per snapshot, solved where its rows are. A bus that nothing enters has intensity 0 and is
    not traced; nor is any bus of a snapshot whose system is singular. Links and storage aren't followed.
    """
    own = dispatch.join(net["generators"].select("gen_id", "bus_id", "co2_emissions"), "gen_id").groupBy("t", "bus_id").agg(F.sum("mw").alias("mw"), F.sum(F.col("mw") * F.col("co2_emissions")).alias("tonnes"))
    made = own.select("t", F.col("bus_id").alias("a"), F.lit(None).cast("int").alias("b"), "mw", "tonnes")
    ways = flows.join(net["lines"].select("line_id", "bus0", "bus1"), "line_id").where("mw <> 0")
    sent = ways.select("t", F.when(F.col("mw") > 0, F.col("bus0")).otherwise(F.col("bus1")).alias("a"), F.when(F.col("mw") > 0, F.col("bus1")).otherwise(F.col("bus0")).alias("b"), F.abs("mw").alias("mw"), F.lit(0.0).alias("tonnes"))
    idle = net["snapshots"].select("t").join(net["buses"].select(F.col("bus_id").alias("a"))).select("t", "a", F.lit(None).cast("int").alias("b"), F.lit(0.0).alias("mw"), F.lit(0.0).alias("tonnes"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].dropna().to_numpy().astype(int)]))
        n = len(names)
        entered, emitted, f = np.zeros(n), np.zeros(n), np.zeros((n, n))
        at = np.searchsorted(names, pdf["a"].to_numpy())
        line = pdf["b"].notna().to_numpy()
        mw = pdf["mw"].to_numpy(float)
        np.add.at(entered, at[~line], mw[~line])
        np.add.at(emitted, at[~line], pdf["tonnes"].to_numpy(float)[~line])
        to = np.searchsorted(names, pdf["b"].to_numpy()[line].astype(int))
        np.add.at(entered, to, mw[line])
        np.add.at(f, (to, at[line]), mw[line])
        dry = entered <= 1e-9
        m = np.diag(entered) - f
        m[dry] = 0
        m[dry, dry] = 1
        emitted[dry] = 0
        try:
            x = np.maximum(np.linalg.solve(m, emitted), 0)
            traced = ~dry
        except np.linalg.LinAlgError:
            x, traced = np.zeros(n), np.zeros(n, bool)
        return pd.DataFrame({"t": pdf["t"].iloc[0], "bus_id": names, "intensity": x, "traced": traced})

    rows = idle.unionByName(made).unionByName(sent)
    return rows.groupBy("t").applyInPandas(solve, "t int, bus_id int, intensity double, traced boolean")


def _demand(net: Network) -> DataFrame:
    each = net["loads"].select("load_id", "bus_id", "p_set").join(net["snapshots"].select("t", "weight"))
    return each.join(net["load_profile"], ["load_id", "t"], "left").select("load_id", "bus_id", "t", "weight", F.coalesce("value", "p_set").alias("demand"))


def consumption_by_country(net: Network, intensities: DataFrame, shed: DataFrame) -> DataFrame:
    """``(country, tonnes)``: what each load takes, less its bus's unserved energy, at the bus's intensity."""
    rows = _demand(net).join(shed.select("t", "bus_id", F.col("mw").alias("shed")), ["t", "bus_id"], "left").join(intensities.select("t", "bus_id", "intensity"), ["t", "bus_id"])
    tonnes = F.greatest(F.col("demand") - F.coalesce("shed", F.lit(0.0)), F.lit(0.0)) * F.col("weight") * F.col("intensity")
    return rows.join(net["buses"].select("bus_id", "country"), "bus_id").groupBy("country").agg(F.sum(tonnes).alias("tonnes"))


def losses_carbon(net: Network, intensities: DataFrame, losses: DataFrame) -> DataFrame:
    """``(line_id, tonnes)``: each line's losses at the mean intensity of its ends."""
    i = intensities.select("t", "bus_id", "intensity")
    rows = losses.where("mw > 0").join(net["lines"].select("line_id", "bus0", "bus1"), "line_id").join(net["snapshots"].select("t", "weight"), "t")
    rows = rows.join(i.toDF("t", "bus0", "i0"), ["t", "bus0"]).join(i.toDF("t", "bus1", "i1"), ["t", "bus1"])
    return rows.groupBy("line_id").agg(F.sum(F.col("mw") * F.col("weight") * 0.5 * (F.col("i0") + F.col("i1"))).alias("tonnes"))


def embodied(net: Network, built: DataFrame) -> DataFrame:
    """``(tonnes)`` of what was built: ``built(gen_id, mw)``."""
    return built.join(net["generators"].select("gen_id", "embodied_co2"), "gen_id").agg(F.coalesce(F.sum(F.col("mw") * F.col("embodied_co2")), F.lit(0.0)).alias("tonnes"))


def marginal_unit(net: Network, dispatch: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(t, gen_id, co2)``: the first part-loaded unit in order, else the cheapest idle one that could run.

    Only units that run, and those that cannot, are looked at in a snapshot: with the units numbered by cost, the
    cheapest idle one has the first number that is missing among them.
    """
    gens = net["generators"].where(F.col("p_nom") > tolerance).select("gen_id", "p_nom", "co2_emissions", F.row_number().over(Window.orderBy("marginal_cost", "gen_id")).alias("rank"))
    available = net["gen_availability"].withColumnRenamed("value", "available")
    most = F.col("p_nom") * F.coalesce("available", F.lit(1.0))
    running = dispatch.where(F.col("mw") > tolerance).join(gens, "gen_id").join(available, ["gen_id", "t"], "left")
    part = running.where(F.col("mw") < most - tolerance).groupBy("t").agg(F.min("gen_id").alias("part"))
    barred = available.join(gens, "gen_id").where(most <= tolerance).select("t", "rank")
    taken = running.select("t", "rank").unionByName(barred).distinct()
    place = taken.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy("rank")))
    gap = place.groupBy("t").agg(F.coalesce(F.min(F.when(F.col("rank") > F.col("n"), F.col("n"))), F.count("*") + 1).cast("int").alias("rank"))
    each = net["snapshots"].select("t").join(part, "t", "left").join(gap, "t", "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    idle = gens.select("rank", F.col("gen_id").alias("idle"))
    chosen = each.join(idle, "rank", "left").select("t", F.coalesce("part", "idle").alias("gen_id"))
    return chosen.join(gens.select("gen_id", F.col("co2_emissions").alias("co2")), "gen_id").select("t", "gen_id", "co2")
