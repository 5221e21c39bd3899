"""Cases out: MATPOWER and PSS/E texts of the first snapshot, a PyPSA folder, and Parquet tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from feederflow.network import KEYS, SERIES, Network
from feederflow.operators.reductions import widen
from feederflow.sources.draft import UNRATED
from feederflow.sources.tables import bus_names, tranche_text, write_table


@dataclass
class Written:
    text: str
    notes: list[str]


def _n(v: float | None) -> str:
    """A number as a case holds it; infinite limits as large numbers."""
    if v is None or math.isnan(v):
        return "0"
    if math.isinf(v):
        return "1e10" if v > 0 else "-1e10"
    return repr(float(v))


class _Point:
    """The components at the first snapshot, by number. A case is one text, so its rows come to the driver."""

    def __init__(self, net: Network):
        self.net = net
        rows = lambda table: net[table].orderBy(KEYS[table]).collect()
        self.buses, self.generators, self.lines, self.loads = (rows(t) for t in ("buses", "generators", "lines", "loads"))
        self.number = {r["bus_id"]: k + 1 for k, r in enumerate(self.buses)}
        first = {r["load_id"]: r["value"] for r in net["load_profile"].where("t = 0").collect()}
        self.demand = [(r["bus_id"], first.get(r["load_id"], r["p_set"]), r["q_set"]) for r in self.loads]
        self.base = net.settings.base_mva if net.settings.base_mva > 0 else 100.0

    def kinds(self) -> list[int]:
        """3 for the first bus with generation in each area, 2 for others with generation, 1 for the rest."""
        made, seen, out = {r["bus_id"] for r in self.generators}, set(), []
        for r in self.buses:
            out.append(1 if r["bus_id"] not in made else 2 if r["synchronous_area"] in seen else 3)
            if out[-1] == 3:
                seen.add(r["synchronous_area"])
        return out

    def dropped(self, what: str, costs: bool) -> list[str]:
        """What the format cannot hold."""
        notes = [f"{what} holds no costs"] if costs else []
        n = self.net["snapshots"].count()
        notes += [f"{what} holds one operating point: the first of {n} snapshots was written"] * (n > 1)
        for table in ("storage_units", "links"):
            if k := self.net[table].count():
                notes.append(f"{k} {table} were dropped; {what} has none")
        if k := sum(r["shiftable_pu"] > 0 for r in self.loads):
            notes.append(f"{k} shiftable loads were written as fixed demand")
        if k := sum(r["susceptance"] <= 0 for r in self.lines):
            notes.append(f"{k} corridors without physics were written as branches")
        return notes


def reactance(r: Row) -> float:
    return r["reactance"] if r["reactance"] else 1 / r["susceptance"] if abs(r["susceptance"]) > 1e-12 else 0.0


def rating(r: Row) -> float:
    """0 stands for no rating."""
    return 0.0 if r["s_nom"] >= UNRATED else r["s_nom"]


def to_matpower(net: Network, name: str = "case") -> Written:
    p = _Point(net)
    need = {k: [0.0, 0.0] for k in p.number}
    for bus, mw, mvar in p.demand:
        need[bus][0] += mw
        need[bus][1] += mvar
    tables = {
        "bus": [[p.number[r["bus_id"]], kind, *map(_n, need[r["bus_id"]]), _n(r["g_shunt"] * p.base), _n(r["b_shunt"] * p.base), 1, "1.0", "0.0", _n(r["v_nom"]), 1, _n(r["v_max"]), _n(r["v_min"])] for r, kind in zip(p.buses, p.kinds(), strict=True)],
        "gen": [[p.number[r["bus_id"]], "0.0", "0.0", _n(r["q_max"]), _n(r["q_min"]), "1.0", _n(p.base), 1, _n(r["p_nom"]), _n(r["p_nom"] * r["p_min_pu"])] for r in p.generators],
        "branch": [[p.number[r["bus0"]], p.number[r["bus1"]], _n(r["resistance"]), _n(reactance(r)), _n(r["shunt_susceptance"]), *[_n(rating(r))] * 3, _n(0.0 if r["tap_ratio"] == 1.0 else r["tap_ratio"]), _n(math.degrees(r["phase_shift"])), 1, "-360.0", "360.0"] for r in p.lines],
        "gencost": [[2, _n(r["start_up_cost"]), _n(r["shut_down_cost"]), 2, _n(r["marginal_cost"]), "0.0"] for r in p.generators],
    }
    out = [f"function mpc = {name}", "mpc.version = '2';", f"mpc.baseMVA = {_n(p.base)};"]
    for table, rows in tables.items():
        out += [f"mpc.{table} = [", *("\t" + "\t".join(map(str, r)) + ";" for r in rows), "];"]
    return Written("\n".join(out) + "\n", p.dropped("MATPOWER", costs=False))


def to_psse(net: Network, title: str = "case") -> Written:
    """A RAW text of revision 33; branches with a ratio or an angle are transformers there."""
    p = _Point(net)
    out = [f"0, {_n(p.base)}, 33, 0, 0, 50.00     / {title}", title, ""]

    def section(name: str, following: str, rows: list[str]) -> None:
        out.extend([*rows, f"0 / END OF {name} DATA" + (f", BEGIN {following} DATA" if following else "")])

    text = lambda s, n: (s or "").replace("'", " ")[:n].ljust(n)
    section("BUS", "LOAD", [f"{p.number[r['bus_id']]},'{text(r['name'], 8)}',{_n(r['v_nom'] if r['v_nom'] > 0 else 1.0)},{kind},1,1,1,1.00000,0.0000,{_n(r['v_max'])},{_n(r['v_min'])}" for r, kind in zip(p.buses, p.kinds(), strict=True)])
    section("LOAD", "FIXED SHUNT", [f"{p.number[bus]},'1 ',1,1,1,{_n(mw)},{_n(mvar)},0.0,0.0,0.0,0.0,1,1,0" for bus, mw, mvar in p.demand if abs(mw) >= 1e-12 or abs(mvar) >= 1e-12])
    section("FIXED SHUNT", "GENERATOR", [f"{p.number[r['bus_id']]},'1 ',1,{_n(r['g_shunt'] * p.base)},{_n(r['b_shunt'] * p.base)}" for r in p.buses if r["g_shunt"] or r["b_shunt"]])
    section("GENERATOR", "BRANCH", [f"{p.number[r['bus_id']]},'1 ',0.0,0.0,{_n(r['q_max'])},{_n(r['q_min'])},1.00000,0,{_n(p.base)},0.0,1.0,0.0,0.0,1.0,1,100.0,{_n(r['p_nom'])},{_n(r['p_nom'] * r['p_min_pu'])},1,1.0" for r in p.generators])
    turned = lambda r: r["tap_ratio"] != 1.0 or r["phase_shift"] != 0.0
    ends = lambda r: f"{p.number[r['bus0']]},{p.number[r['bus1']]}"
    rates = lambda r: ",".join([_n(rating(r))] * 3)
    section("BRANCH", "TRANSFORMER", [f"{ends(r)},'1 ',{_n(r['resistance'])},{_n(reactance(r))},{_n(r['shunt_susceptance'])},{rates(r)},0.0,0.0,0.0,0.0,1,1,0.0,1,1.0" for r in p.lines if not turned(r)])
    windings = []
    for r in filter(turned, p.lines):
        windings += [f"{ends(r)},0,'1 ',1,1,1,0.0,0.0,2,'{text(r['name'], 12)}',1,1,1.0", f"{_n(r['resistance'])},{_n(reactance(r))},{_n(p.base)}", f"{_n(r['tap_ratio'])},0.0,{_n(math.degrees(r['phase_shift']))},{rates(r)},0,0,1.1,0.9,1.1,0.9,33,0,0.0,0.0,0.0", "1.0,0.0"]
    section("TRANSFORMER", "AREA", windings)
    section("AREA", "TWO-TERMINAL DC", [])
    section("TWO-TERMINAL DC", "", [])
    return Written("\n".join([*out, "Q"]) + "\n", p.dropped("PSS/E", costs=True))


def write_pypsa(net: Network, folder: str) -> None:
    """A folder of CSV tables by PyPSA's names: impedances in ohms by the voltage of the first bus, series by component."""
    base = net.settings.base_mva if net.settings.base_mva > 0 else 100.0
    yes = lambda c: F.when(F.col(c), "True").otherwise("False").alias(c)
    limit = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    write_table(net["buses"].orderBy("bus_id").select("name", "v_nom", "carrier", "country", "x", "y"), f"{folder}/buses.csv")
    g = bus_names(net, net["generators"]).orderBy("gen_id")
    write_table(g.select("name", "bus", "carrier", "p_nom", yes("p_nom_extendable"), limit("p_nom_max"), "p_min_pu", "marginal_cost", "capital_cost"), f"{folder}/generators.csv")
    kv = net["buses"].select(F.col("bus_id").alias("bus0"), "v_nom")
    x = F.when(F.col("reactance") != 0, F.col("reactance")).when(F.abs("susceptance") > 1e-12, 1 / F.col("susceptance")).otherwise(0.0)
    z = F.when(F.col("v_nom") > 0, F.col("v_nom") * F.col("v_nom") / base).otherwise(1.0)
    lines = net["lines"].join(kv, "bus0").withColumns({"x": x * z, "r": F.col("resistance") * z, "b": F.col("shunt_susceptance"), "s_nom": F.when(F.col("s_nom") >= UNRATED, 0.0).otherwise(F.col("s_nom"))})
    write_table(bus_names(net, lines).orderBy("line_id").select("name", "bus0", "bus1", "x", "r", "b", "s_nom", yes("s_nom_extendable"), "v_nom"), f"{folder}/lines.csv")
    write_table(bus_names(net, net["loads"]).orderBy("load_id").select("name", "bus", "p_set", "q_set"), f"{folder}/loads.csv")
    if "storage_units" in net.tables:
        s = bus_names(net, net["storage_units"]).orderBy("storage_id")
        write_table(s.select("name", "bus", "p_nom", "max_hours", "efficiency_store", "efficiency_dispatch", yes("cyclic").alias("cyclic_state_of_charge")), f"{folder}/storage_units.csv")
    if "links" in net.tables:
        write_table(bus_names(net, net["links"]).orderBy("link_id").select("name", "bus0", "bus1", "p_nom", "efficiency", "marginal_cost"), f"{folder}/links.csv")
    write_table(net["snapshots"].orderBy("t").select(F.col("t").alias("name"), F.col("weight").alias("weightings")), f"{folder}/snapshots.csv")
    for series, file in (("load_profile", "loads-p_set"), ("gen_availability", "generators-p_max_pu")):
        if series in net.tables:
            table, key = SERIES[series]
            write_table(widen(net[series], net[table], key, digits=12).orderBy("t").withColumnRenamed("t", "name"), f"{folder}/{file}.csv")


def write_parquet(net: Network, folder: str) -> None:
    """The network as a folder that ``load_parquet`` reads: components by name, series wide with their snapshot ``t``."""
    for table in KEYS:
        if table in net.tables:
            df: DataFrame = bus_names(net, net[table], table).orderBy(KEYS[table])
            df = df.withColumns({c: tranche_text(c) for c, t in df.dtypes if t.startswith("array")})
            df.drop(KEYS[table]).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    net["snapshots"].orderBy("t").write.mode("overwrite").parquet(f"{folder}/snapshots.parquet")
    for series in ("gen_availability", "load_profile", "storage_inflow"):
        if series in net.tables:
            table, key = SERIES[series]
            widen(net[series], net[table], key, digits=12).write.mode("overwrite").parquet(f"{folder}/{series}.parquet")
