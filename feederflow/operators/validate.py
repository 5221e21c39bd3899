"""Checks of a network: each is a query for violations, ranked in the order in which they are reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.network import Network, is_transport


class NetworkError(ValueError):
    """The first violation of a network."""

    def __init__(self, code: str, component: int | None = None):
        super().__init__(code if component is None else f"{code}: {component}")
        self.code, self.component = code, component


def _finite(c: str):
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def _bad(c: str):
    """Not a finite number of at least 0 (null is as bad)."""
    return ~F.coalesce(_finite(c) & (F.col(c) >= 0), F.lit(False))


def _share(c: str, zero: bool):
    low = F.col(c) >= 0 if zero else F.col(c) > 0
    return ~F.coalesce(low & (F.col(c) <= 1), F.lit(False))


def violations(net: Network) -> DataFrame:
    """``(rank, code, component_id)`` for every violation; one scan of each table, and of buses for references."""
    found: list[DataFrame] = []

    def add(df: DataFrame, key: str, code: str) -> None:
        found.append(df.select(F.lit(len(found)).alias("rank"), F.lit(code).alias("code"), F.col(key).cast("bigint").alias("component_id")))

    known = net["buses"].select("bus_id")
    missing = lambda t, c: net[t].join(known.withColumnRenamed("bus_id", c), c, "left_anti")
    gens, lines, loads, stores = net["generators"], net["lines"], net["loads"], net["storage_units"]
    add(net["snapshots"].where(_bad("weight") | (F.col("weight") <= 0)), "t", "bad_weight")
    add(missing("generators", "bus_id"), "gen_id", "generator_bus")
    add(gens.where(_bad("p_nom")), "gen_id", "generator_p_nom")
    add(gens.where(_share("p_min_pu", True)), "gen_id", "generator_p_min_pu")
    add(missing("lines", "bus0"), "line_id", "line_bus0")
    add(missing("lines", "bus1"), "line_id", "line_bus1")
    add(lines.where("bus0 = bus1"), "line_id", "self_loop")
    add(lines.where(_bad("s_nom")), "line_id", "line_s_nom")
    add(missing("loads", "bus_id"), "load_id", "load_bus")
    add(missing("storage_units", "bus_id"), "storage_id", "storage_bus")
    add(stores.where(_share("efficiency_store", False) | _share("efficiency_dispatch", False)), "storage_id", "storage_efficiency")
    add(stores.where(_bad("max_hours")), "storage_id", "storage_max_hours")
    area = net["buses"].select("bus_id", "synchronous_area")
    ends = lines.where(~is_transport()).join(area.toDF("bus0", "a0"), "bus0").join(area.toDF("bus1", "a1"), "bus1")
    add(ends.where("a0 <> a1"), "line_id", "line_across_areas")
    add(lines.where(~is_transport() & F.col("s_nom_extendable")), "line_id", "extendable_line")
    add(lines.where(F.col("s_nom_extendable") & (F.col("s_nom_max") < F.col("s_nom"))), "line_id", "line_ceiling")
    add(gens.where(F.col("p_nom_extendable") & (F.col("p_nom_max") < 0)), "gen_id", "generator_ceiling")
    add(gens.where(_bad("co2_emissions")), "gen_id", "co2_emissions")
    add(stores.where(F.col("p_nom_extendable") & (F.col("p_nom_max") < F.col("p_nom"))), "storage_id", "storage_ceiling")
    horizon = net["snapshots"].agg(F.count("*").alias("n"))
    for series, table, key, code in (("gen_availability", "generators", "gen_id", "availability_shape"), ("load_profile", "loads", "load_id", "profile_shape")):
        per = net[table].select(key).join(net[series].groupBy(key).agg(F.countDistinct("t").alias("rows")), key).join(F.broadcast(horizon))
        add(per.where("rows <> n"), key, code)
    return reduce(DataFrame.unionByName, found)


def warnings(net: Network) -> DataFrame:
    """``(code, component_id)``: what the checks let pass and a reader should know."""
    known = net["buses"].select("bus_id")
    out = [net["links"].join(known.withColumnRenamed("bus_id", c), c, "left_anti").select(F.lit(f"link_{c}").alias("code"), F.col("link_id").cast("bigint").alias("component_id")) for c in ("bus0", "bus1")]
    out.append(net["contingencies"].join(net["lines"].select("line_id"), "line_id", "left_anti").select(F.lit("contingency").alias("code"), F.col("line_id").cast("bigint").alias("component_id")))
    out.append(net["scenarios"].agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9").select(F.lit("probabilities").alias("code"), F.lit(None).cast("bigint").alias("component_id")))
    return reduce(DataFrame.unionByName, out)


def validate(net: Network) -> None:
    """Raise the first violation in the order of the checks, then of the components."""
    if net["snapshots"].isEmpty():
        raise NetworkError("no_snapshots")
    if net["buses"].isEmpty():
        raise NetworkError("no_buses")
    first = violations(net).orderBy("rank", "component_id").first()
    if first:
        raise NetworkError(first["code"], first["component_id"])
    for name in ("co2_limit",):
        limit = getattr(net.settings, name)
        if limit is not None and not 0 <= limit < float("inf"):
            raise NetworkError(name)
