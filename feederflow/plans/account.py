"""From a solution to its carbon account: the solved families as tables, and all results of the account together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.network import Network
from feederflow.operators import accounting
from feederflow.plans.solve import Solved


@dataclass(frozen=True)
class Account:
    by_generator: DataFrame  # gen_id, tonnes
    production: DataFrame  # country, tonnes, first
    by_carrier: DataFrame  # carrier, tonnes, mwh, intensity
    intensity: DataFrame  # t, bus_id, intensity, traced
    consumption: DataFrame  # country, tonnes
    marginal: DataFrame  # t, gen_id, co2
    losses: DataFrame  # line_id, tonnes
    embodied: DataFrame  # tonnes
    average: DataFrame  # tonnes, mwh, intensity


def family(net: Network, solved: Solved, name: str, key: str, value: str = "mw") -> DataFrame:
    """One family of a solution as a table ``(key, t, value)``."""
    v = solved.family(name, key)
    return net.spark.createDataFrame([(int(i), int(t), float(x)) for i, t, x in v[[key, "t", "value"]].itertuples(index=False)], f"{key} int, t int, {value} double")


def built(net: Network, solved: Solved, name: str, key: str) -> DataFrame:
    """``(key, period, mw)`` of what a solution builds."""
    v = solved.family(name, key)
    return net.spark.createDataFrame([(int(i), int(k), float(x)) for i, k, x in v[[key, "k", "value"]].itertuples(index=False)], f"{key} int, period int, mw double")


def account(net: Network, solved: Solved) -> Account:
    """All results of the carbon account of a solved network."""
    dispatch, flows = family(net, solved, "dispatch", "gen_id"), family(net, solved, "flow", "line_id")
    return account_of(net, dispatch, flows, family(net, solved, "shed", "bus_id"), family(net, solved, "line_loss", "line_id"), built(net, solved, "gen_capacity", "gen_id"))


def account_of(net: Network, dispatch: DataFrame, flows: DataFrame, shed: DataFrame, losses: DataFrame, grown: DataFrame) -> Account:
    """The same from tables, as a long horizon has them."""
    intensity = accounting.intensity(net, dispatch, flows)
    return Account(
        accounting.by_generator(net, dispatch), accounting.production_by_country(net, dispatch), accounting.by_carrier(net, dispatch), intensity, accounting.consumption_by_country(net, intensity, shed), accounting.marginal_unit(net, dispatch),
        accounting.losses_carbon(net, intensity, losses), accounting.embodied(net, grown.groupBy("gen_id").agg(F.sum("mw").alias("mw"))), accounting.average_intensity(net, dispatch),
    )
