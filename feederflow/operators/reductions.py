"""Reductions of solved series to the figures that reports and charts show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.network import Network
from feederflow.operators.topology import nearest_buses


def _finite(c: str):
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def duration_curve(series: DataFrame, key: str = "bus_id", value: str = "value") -> DataFrame:
    """``(key, rank, value)``: finite values from the largest down, ranks from 1, ties by snapshot."""
    order = Window.partitionBy(key).orderBy(F.desc(value), "t")
    return series.where(_finite(value)).select(key, F.row_number().over(order).alias("rank"), value)


def dispatch_stack(generators: DataFrame, dispatch: DataFrame) -> DataFrame:
    """``(t, gen_id, mw, top)``: the snapshot's generation piled up in merit order."""
    order = Window.partitionBy("t").orderBy("marginal_cost", "gen_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dispatch.join(generators.select("gen_id", "marginal_cost"), "gen_id").select("t", "gen_id", "mw", F.sum("mw").over(order).alias("top"))


def full_stack(generators: DataFrame, dispatch: DataFrame, discharge: DataFrame) -> DataFrame:
    """``(t, kind, id, mw, top)``: the merit order of generation with what reservoirs give (``discharge(storage_id, t, mw)``,
    at least 0) on top, by number."""
    made = dispatch.join(generators.select("gen_id", "marginal_cost"), "gen_id").select("t", F.lit("generator").alias("kind"), F.col("gen_id").alias("id"), "mw", "marginal_cost")
    given = discharge.select("t", F.lit("storage").alias("kind"), F.col("storage_id").alias("id"), F.greatest("mw", F.lit(0.0)).alias("mw"), F.lit(float("inf")).alias("marginal_cost"))
    order = Window.partitionBy("t").orderBy("kind", "marginal_cost", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return made.unionByName(given).select("t", "kind", "id", "mw", F.sum("mw").over(order).alias("top"))


def label_order(net: Network, selected: list[int] = ()) -> DataFrame:
    """``(bus_id, place)``: the order of labels with the selected buses first."""
    w = label_weight(net).join(net["buses"].select("bus_id", "name"), "bus_id")
    first = F.col("bus_id").isin(*selected) if selected else F.lit(False)
    return w.select("bus_id", F.row_number().over(Window.orderBy(first.desc(), F.desc("weight"), "name", "bus_id")).alias("place"))

def envelope(series: DataFrame, value: str = "value") -> DataFrame:
    """``(t, low, high, spread)`` over the finite values of a snapshot."""
    return series.where(_finite(value)).groupBy("t").agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread"))


def stack_totals(series: DataFrame, value: str = "value") -> DataFrame:
    return series.where(_finite(value)).groupBy("t").agg(F.sum(value).alias("total"))


def interesting_hour(scores: DataFrame, score: str = "score", last_of_ties: bool = True) -> DataFrame:
    """The snapshot with the highest score; of equal ones the last, or the first if asked."""
    return scores.orderBy(F.desc(score), F.desc("t") if last_of_ties else F.asc("t")).limit(1)


def stress_score(prices: DataFrame, shed: DataFrame) -> DataFrame:
    """``(t, score)``: unserved energy above all, else the highest price."""
    lost = shed.groupBy("t").agg(F.sum("mw").alias("lost"))
    top = prices.where(_finite("value")).groupBy("t").agg(F.max("value").alias("top"))
    return top.join(lost, "t", "left").select("t", F.when(F.coalesce("lost", F.lit(0.0)) > 0, F.lit(1e9) + F.col("lost")).otherwise(F.col("top")).alias("score"))


def peak_and_mean(series: DataFrame, key: str, value: str = "value") -> DataFrame:
    """``(key, peak, peak_abs, mean)``: the peak starts at 0."""
    return series.groupBy(key).agg(F.greatest(F.max(value), F.lit(0.0)).alias("peak"), F.max(F.abs(value)).alias("peak_abs"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def loading(lines: DataFrame, flows: DataFrame) -> DataFrame:
    """``(line_id, loading, mean_flow, binding)``: null loading for an unrated line; binding from 99.5 %."""
    per = flows.groupBy("line_id").agg(F.max(F.abs("mw")).alias("top"), F.avg("mw").alias("mean_flow"))
    ratio = F.when(F.col("s_nom").isNotNull() & _finite("s_nom") & (F.col("s_nom") != 0), F.col("top") / F.abs("s_nom"))
    return lines.join(per, "line_id").select("line_id", ratio.alias("loading"), "mean_flow", F.coalesce(ratio >= 0.995, F.lit(False)).alias("binding"))


def bus_balance(net: Network, dispatch: DataFrame) -> DataFrame:
    """``(bus_id, generated, consumed, net)`` in mean MW: dispatch against the loads' set values."""
    n = net["snapshots"].agg(F.count("*").alias("n"))
    made = dispatch.join(net["generators"].select("gen_id", "bus_id"), "gen_id").groupBy("bus_id").agg(F.sum("mw").alias("made"))
    used = net["loads"].groupBy("bus_id").agg(F.sum("p_set").alias("consumed"))
    rows = net["buses"].select("bus_id").join(made, "bus_id", "left").join(used, "bus_id", "left").join(F.broadcast(n))
    rows = rows.select("bus_id", (F.coalesce("made", F.lit(0.0)) / F.col("n")).alias("generated"), F.coalesce("consumed", F.lit(0.0)).alias("consumed"))
    return rows.withColumn("net", F.col("generated") - F.col("consumed"))


def regions_by_size(buses: DataFrame, region: str = "country") -> DataFrame:
    return buses.where(F.trim(region) != "").groupBy(region).agg(F.count("*").alias("buses")).orderBy(F.desc("buses"), region)


def region_extents(buses: DataFrame, region: str = "country") -> DataFrame:
    placed = buses.where("x is not null and y is not null")
    return placed.groupBy(region).agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def label_weight(net: Network) -> DataFrame:
    """``(bus_id, weight, place)``: twice the capacity, the demand, 25 for each line end; the order of labels."""
    parts = net["generators"].select("bus_id", (2 * F.col("p_nom")).alias("w")).unionByName(net["loads"].select("bus_id", F.abs("p_set").alias("w")))
    for c in ("bus0", "bus1"):
        parts = parts.unionByName(net["lines"].select(F.col(c).alias("bus_id"), F.lit(25.0).alias("w")))
    w = net["buses"].select("bus_id", "name").join(parts.groupBy("bus_id").agg(F.sum("w").alias("w")), "bus_id", "left").select("bus_id", "name", F.coalesce("w", F.lit(0.0)).alias("weight"))
    return w.select("bus_id", "weight", F.row_number().over(Window.orderBy(F.desc("weight"), "name", "bus_id")).alias("place"))


def area_peak(net: Network) -> DataFrame:
    """``(area, peak)``: each area's highest demand in a snapshot."""
    each = net["loads"].select("load_id", "bus_id", "p_set").join(net["snapshots"].select("t")).join(net["load_profile"], ["load_id", "t"], "left")
    per = each.join(net["buses"].select("bus_id", "synchronous_area"), "bus_id").groupBy("synchronous_area", "t").agg(F.sum(F.coalesce("value", "p_set")).alias("mw"))
    return per.groupBy(F.col("synchronous_area").alias("area")).agg(F.max("mw").alias("peak"))


def capacity_credit(net: Network) -> DataFrame:
    """``(gen_id, credit)``: the least availability, 1 at most and without a profile."""
    least = net["gen_availability"].groupBy("gen_id").agg(F.min("value").alias("least"))
    return net["generators"].select("gen_id").join(least, "gen_id", "left").select("gen_id", F.least(F.coalesce("least", F.lit(1.0)), F.lit(1.0)).alias("credit"))


def allocation(weights: DataFrame, totals: DataFrame, least_mw: float = 1.0) -> DataFrame:
    """``(bus_id, country, mw)``: each country's total by weight; shares under ``least_mw`` are dropped."""
    share = F.col("mw") * F.col("weight") / F.sum("weight").over(Window.partitionBy("country"))
    return weights.join(totals, "country").select("bus_id", "country", share.alias("mw")).where(F.col("mw") >= least_mw)


def mean_positive(series: DataFrame, key: str, value: str = "value", more_than: int = 1000) -> DataFrame:
    """``(key, mean)`` of the positive values where there are more than ``more_than``."""
    return series.where(F.col(value) > 0).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") > more_than).select(key, "mean")


def voltage_band(v: str):
    """The highest threshold of the fixed voltage levels that a kV value reaches, 0 below all."""
    out = F.lit(0)
    for kv in (110, 220, 300, 380, 500):
        out = F.when(F.col(v) >= kv, kv).otherwise(out)
    return out


def line_voltage(net: Network) -> DataFrame:
    """``(line_id, kv)``: the higher voltage of a line's two ends."""
    ends = net["lines"].select("line_id", F.explode(F.array("bus0", "bus1")).alias("bus_id"))
    return ends.join(net["buses"].select("bus_id", "v_nom"), "bus_id").groupBy("line_id").agg(F.max("v_nom").alias("kv"))


def voltages_stated(buses: DataFrame) -> DataFrame:
    """``(stated)``: whether the buses name two levels of 1 kV or more that differ."""
    real = F.when(F.col("v_nom") >= 1.0, F.col("v_nom"))
    return buses.agg(F.coalesce(F.max(real) - F.min(real) > 1e-6, F.lit(False)).alias("stated"))


def shown_buses(buses: DataFrame, hidden: list[str] = (), only: str | None = None) -> DataFrame:
    """The buses that a filter by country leaves: without the ``hidden`` ones, or those of ``only`` one country."""
    if only is not None:
        return buses.where(F.col("country") == only)
    return buses.where(~F.coalesce(F.col("country").isin(*hidden), F.lit(False))) if hidden else buses


def places_within(places: DataFrame, west: float, south: float, east: float, north: float, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` places by rank inside a box, its edges included."""
    return places.where(F.col("x").between(west, east) & F.col("y").between(south, north)).orderBy(rank).limit(limit)


def axis_fit(series: DataFrame, value: str = "value") -> DataFrame:
    """``(low, high)`` of an axis for the finite values: zero is on it when any is negative, a flat series gets room,
    and nothing at all gives 0 to 1."""
    v = F.when(_finite(value), F.col(value))
    ends = series.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(1.0)).alias("high"))
    ends = ends.withColumn("high", F.when(F.col("low") < 0, F.greatest(F.col("high"), F.lit(0.0))).otherwise(F.col("high")))
    room = F.when(F.abs(F.col("high") - F.col("low")) < 1e-9, F.greatest(F.abs("high"), F.lit(1.0)) * 0.1).otherwise(0.0)
    return ends.select((F.col("low") - room).alias("low"), (F.col("high") + room).alias("high"))


def population_weight(places: DataFrame, buses: DataFrame, within: float = 3.0, k: int = 5) -> DataFrame:
    """``(bus_id, weight)``: 1, and of each place's population a share for its ``k`` nearest buses nearer than
    ``within`` degrees, by the inverse of the squared distance (0.0025 at least)."""
    near = nearest_buses(places.where("population > 0"), buses, within, k).where(F.col("distance") < within)
    near = near.withColumn("share", 1 / F.greatest(F.col("distance") * F.col("distance"), F.lit(0.0025)))
    part = F.col("population") * F.col("share") / F.sum("share").over(Window.partitionBy("place_id"))
    got = near.join(places.select("place_id", "population"), "place_id").withColumn("w", part).groupBy("bus_id").agg(F.sum("w").alias("w"))
    return buses.select("bus_id").join(got, "bus_id", "left").select("bus_id", (1 + F.coalesce("w", F.lit(0.0))).alias("weight"))


def widen(series: DataFrame, names: DataFrame, key: str, value: str = "value", digits: int = 6) -> DataFrame:
    """A long series as a table with a column for each component name, as reports are written."""
    named = series.join(names.select(key, "name"), key)
    columns = [r["name"] for r in names.select("name").distinct().orderBy("name").collect()]
    return named.groupBy("t").pivot("name", columns).agg(F.round(F.first(value), digits))


def lengthen(wide: DataFrame, names: DataFrame, key: str, default: float | None = None) -> DataFrame:
    """A table with a column for each component (by name, in any case) as a long series; blanks take the default."""
    known = {r["n"].lower() for r in names.select(F.col("name").alias("n")).collect()}
    columns = [c for c in wide.columns if c != "t"]
    unknown = [c for c in columns if c.lower() not in known]
    if unknown:
        raise ValueError(f"unknown column {unknown[0]}")
    long = wide.unpivot("t", columns, "_name", "value")
    ids = names.groupBy(F.lower("name").alias("_name")).agg(F.max(key).alias(key))
    return long.withColumn("_name", F.lower("_name")).join(ids, "_name").select(key, "t", F.coalesce("value", F.lit(default).cast("double")).alias("value")).where("value is not null")
