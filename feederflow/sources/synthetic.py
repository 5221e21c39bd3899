"""A synthetic ring network of any size, made where it is used: nothing passes the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.network import Network, conform, hourly

#: The countries dealt to the buses in turn.
COUNTRIES = ["DE", "FR", "ES", "IT", "PL", "NL", "BE", "AT", "SE", "DK", "CZ", "PT", "FI", "NO", "CH"]


def ring(spark: SparkSession, n_buses: int, n_hours: int) -> Network:
    """A ring with chords; at each bus base load, a peaker and wind, demand with a daily shape, and a battery at every fourth."""
    b = spark.range(n_buses).select(F.col("id").cast("int").alias("b"))
    name = lambda kind: F.concat(F.lit(kind), F.col("b").cast("string")).alias("name")
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), F.col("b") % len(COUNTRIES) + 1)
    buses = b.select(F.col("b").alias("bus_id"), name("bus"), country.alias("country"))

    lines = b.select(F.col("b").alias("line_id"), name("ring"), F.col("b").alias("bus0"), ((F.col("b") + 1) % n_buses).alias("bus1"), F.lit(3000.0).alias("s_nom"), F.lit(10.0).alias("susceptance"))
    if n_buses > 8:
        chords = b.where("b % 2 = 0").select((n_buses + F.col("b") / 2).cast("int").alias("line_id"), name("chord"), F.col("b").alias("bus0"), ((F.col("b") + n_buses // 3) % n_buses).alias("bus1"), F.lit(1500.0).alias("s_nom"), F.lit(6.0).alias("susceptance"))
        lines = lines.unionByName(chords.where("bus0 <> bus1"))

    def units(kind: str, at: int, p_nom: float, cost) -> DataFrame:
        return b.select((3 * F.col("b") + at).alias("gen_id"), name(kind), F.col("b").alias("bus_id"), F.lit(p_nom).alias("p_nom"), cost.cast("double").alias("marginal_cost"))

    generators = units("base", 0, 800.0, 12 + F.col("b") % 5).unionByName(units("peak", 1, 400.0, 85 + F.col("b") % 11)).unionByName(units("wind", 2, 600.0, F.lit(0)))
    hours = spark.range(n_hours).select(F.col("id").cast("int").alias("t"))
    turn = 2 * math.pi / 24
    wind = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 + 0.45 * F.sin((F.col("t") + F.col("b") * 7) * turn)))
    availability = b.join(hours).select((3 * F.col("b") + 2).alias("gen_id"), "t", wind.alias("value"))
    loads = b.select(F.col("b").alias("load_id"), name("load"), F.col("b").alias("bus_id"), F.lit(700.0).alias("p_set"))
    profile = b.join(hours).select(F.col("b").alias("load_id"), "t", (700 * (1 + 0.25 * F.sin(F.col("t") * turn)) + F.col("b") % 13 * 10).alias("value"))
    stores = b.where("b % 4 = 0").select((F.col("b") / 4).cast("int").alias("storage_id"), name("batt"), F.col("b").alias("bus_id"), F.lit(200.0).alias("p_nom"), F.lit(6.0).alias("max_hours"), F.lit(0.92).alias("efficiency_store"), F.lit(0.92).alias("efficiency_dispatch"))
    tables = {"snapshots": hourly(spark, n_hours), "buses": buses, "lines": lines, "generators": generators, "gen_availability": availability, "loads": loads, "load_profile": profile, "storage_units": stores}
    return Network(spark, {k: conform(v, k) for k, v in tables.items()})
