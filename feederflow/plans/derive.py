"""A deterministic network from the benchmark tables, so that every operator has data and a SQL twin.

Sums run over whole cents or units, so that no order of addition shows in the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.network import Globals, Network, conform

#: Tonnes a MWh by carrier number.
CO2 = [0.0, 0.2, 0.4, 0.8, 1.0]
#: Carrier names by number.
CARRIERS = ["wind", "gas", "oil", "lignite", "coal"]


class Tables:
    """The benchmark tables of one folder, read with their own columns only when used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


def buses(t: Tables) -> DataFrame:
    df = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    x, y = (F.col("n_nationkey") * 7 % 40 - 10).cast("double"), (F.col("n_nationkey") * 11 % 30 + 35).cast("double")
    return df.select(F.col("n_nationkey").alias("bus_id"), F.col("n_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("synchronous_area"), x.alias("x"), y.alias("y"))


def generators(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    carrier = (k % 5).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), carrier + 1)
    return t.supplier.select(
        k.cast("int").alias("gen_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("bus_id"), (100 + k % 400).cast("double").alias("p_nom"), (10 + k * 7 % 90).cast("double").alias("marginal_cost"),
        pick(CARRIERS).alias("carrier"), pick(CO2).alias("co2_emissions"), (k % 7 == 0).alias("p_nom_extendable"), F.when(k % 7 == 0, 1000.0).otherwise(float("inf")).alias("p_nom_max"), (k % 13 * 100).cast("double").alias("capital_cost"),
        (k % 3 == 0).alias("committable"), (k % 4 * 0.1).alias("p_min_pu"), (k % 5 * 10).cast("double").alias("start_up_cost"), (k % 4).cast("int").alias("min_up_time"), (k % 3).cast("int").alias("min_down_time"),
        (k % 4 * 0.3).alias("ramp_up"), (k % 5 * 0.25).alias("ramp_down"), (k % 11 * 0.5).alias("water_use"), (k % 6 * 0.25).alias("land_use"), (k % 9 * 1.5).alias("embodied_co2"),
    )


def loads(t: Tables) -> DataFrame:
    cents = F.sum(F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).cast("bigint"))
    per = t.customer.groupBy("c_nationkey").agg(cents.alias("cents"))
    k = F.col("c_nationkey")
    return per.select(
        k.alias("load_id"), F.concat(F.lit("load"), k.cast("string")).alias("name"), k.alias("bus_id"), F.floor(F.col("cents") / 100_000).cast("double").alias("p_set"), (k % 3 * 0.1).alias("shiftable_pu"), (k % 4 * 6).cast("int").alias("shift_window"),
        (k % 2 * 5).cast("double").alias("shift_cost"), (k % 5 * 10).cast("double").alias("interruptible_mw"), (k % 5 * 2).cast("int").alias("max_interruptions"), F.lit(500.0).alias("interruption_cost"),
    )


def snapshots(t: Tables) -> DataFrame:
    hours = t.events.select(F.date_trunc("hour", "ts").alias("hour")).distinct()
    n = F.row_number().over(Window.orderBy("hour")) - 1
    return hours.select(n.cast("int").alias("t"), (1 + n % 2).cast("double").alias("weight"), "hour")


def load_profile(t: Tables) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    per = t.events.groupBy((F.col("user_id") % 25).cast("int").alias("load_id"), F.date_trunc("hour", "ts").alias("hour")).agg(cents.alias("cents"))
    return per.join(snapshots(t), "hour").select("load_id", "t", (F.col("cents") / 100).alias("value"))


def trade(t: Tables) -> DataFrame:
    """Net quantity between nations: positive from the smaller key to the larger."""
    li = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    home = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("dst"))
    pairs = li.join(home, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey")).where("src <> dst")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return pairs.groupBy(a.alias("bus0"), b.alias("bus1")).agg(F.sum(F.when(F.col("src") < F.col("dst"), F.col("q")).otherwise(-F.col("q"))).alias("net"))


def lines(t: Tables) -> DataFrame:
    """A line for each trading pair; every fifth pair is a corridor without physics."""
    k = F.col("bus0") * 25 + F.col("bus1")
    b = F.when((F.col("bus0") + F.col("bus1")) % 5 == 0, 0.0).otherwise((1 + k % 10).cast("double"))
    return trade(t).select(
        k.cast("int").alias("line_id"), F.concat_ws("-", F.col("bus0").cast("string"), F.col("bus1").cast("string")).alias("name"), "bus0", "bus1", (F.abs("net") + 1).cast("double").alias("s_nom"), b.alias("susceptance"),
        (k % 3 * 0.01).alias("loss"), (k % 4 * 0.001).alias("phase_shift"), (k % 10 * 0.01).alias("resistance"),
    )


def storage_units(t: Tables) -> DataFrame:
    """Reservoirs at every fourth bus; each flows into the next, the last into none."""
    k = F.col("n_nationkey")
    return t.nation.where(k % 4 == 0).select(
        (k / 4).cast("int").alias("storage_id"), F.concat(F.lit("store"), k.cast("string")).alias("name"), k.alias("bus_id"), (50 + k).cast("double").alias("p_nom"), (2 + k % 5).cast("double").alias("max_hours"), F.lit(0.9).alias("efficiency_store"),
        F.lit(0.8).alias("efficiency_dispatch"), (k % 8 == 0).alias("cyclic"), F.when(k < 24, (k / 4 + 1).cast("int")).alias("downstream_id"), (k % 3).cast("int").alias("travel_time"), F.when(k % 8 != 0, 10.0).alias("soc_initial"), (k % 8 == 4).alias("spillable"),
    )


def links(t: Tables) -> DataFrame:
    """A one-way tie from each region's first nation to the next region's."""
    first = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("bus"))
    a, b = first.select(F.col("n_regionkey").alias("r"), F.col("bus").alias("bus0")), first.select(((F.col("n_regionkey") + 4) % 5).alias("r"), F.col("bus").alias("bus1"))
    return a.join(b, "r").select(F.col("r").alias("link_id"), F.concat(F.lit("tie"), F.col("r").cast("string")).alias("name"), "bus0", "bus1", (100 + F.col("r") * 10).cast("double").alias("p_nom"), F.lit(0.97).alias("efficiency"), F.col("r").cast("double").alias("marginal_cost"))


def periods(t: Tables) -> DataFrame:
    """Three investment periods over the horizon; the last overlaps the one before."""
    n = F.max("t") + 1
    rows = snapshots(t).agg(n.alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("period"))
    third = F.floor(F.col("n") / 3).cast("int")
    return rows.select("period", F.concat(F.lit("p"), F.col("period").cast("string")).alias("name"), (F.col("period") * third - F.when(F.col("period") == 2, 5).otherwise(0)).cast("int").alias("first_snapshot"), third.alias("n_snapshots"), F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(0.5)), F.col("period") + 1).alias("discount"))


def scenarios(t: Tables) -> DataFrame:
    rows = snapshots(t).agg((F.max("t") + 1).alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("scenario"))
    half = F.floor(F.col("n") / 2).cast("int")
    return rows.select("scenario", F.concat(F.lit("s"), F.col("scenario").cast("string")).alias("name"), (F.col("scenario") * half).cast("int").alias("first_snapshot"), half.alias("n_snapshots"), F.when(F.col("scenario") == 0, 0.25).otherwise(0.75).alias("probability"))


def gen_availability(t: Tables) -> DataFrame:
    """Wind follows a pattern of its own; the other carriers have no profile."""
    wind = t.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("int").alias("gen_id"))
    hours = snapshots(t).agg(F.max("t").alias("last"))
    return wind.join(hours).select("gen_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t")).select("gen_id", "t", ((F.col("t") * 7 + F.col("gen_id") * 13) % 100 / 100).alias("value"))


def contingencies(t: Tables) -> DataFrame:
    """Every seventh line with physics may fail."""
    return lines(t).where("susceptance > 0 and line_id % 7 = 0").select("line_id")


def storage_inflow(t: Tables) -> DataFrame:
    last = snapshots(t).agg(F.max("t").alias("last"))
    return storage_units(t).select("storage_id").join(last).select("storage_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t")).select("storage_id", "t", ((F.col("t") * 3 + F.col("storage_id") * 5) % 17).cast("double").alias("value"))


def dispatch_facts(t: Tables) -> DataFrame:
    """A ready flow for accounting: each supplier's quantity by day of shipment, days numbered in order."""
    day = F.to_date("l_shipdate")
    per = t.lineitem.groupBy(F.col("l_suppkey").cast("int").alias("gen_id"), day.alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    days = per.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).cast("int").alias("t"))
    return per.join(days, "day").select("gen_id", "t", F.col("q").cast("double").alias("mw"))


PARTS = {f.__name__: f for f in (buses, generators, loads, snapshots, load_profile, lines, storage_units, links, periods, scenarios, gen_availability, storage_inflow)}


def network(spark: SparkSession, sf_dir: str, *parts: str) -> Network:
    """The derived network; only ``parts`` if any are named."""
    t = Tables(spark, sf_dir)
    settings = Globals(value_of_lost_load=3000.0, co2_price=5.0, reserve_margin=0.1, co2_limit=1e6, water_limit=1e6, land_limit=1e6)
    return Network(spark, {k: conform(PARTS[k](t), k) for k in parts or PARTS}, settings)
