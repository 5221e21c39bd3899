"""The dispatch and expansion model as three tables: columns, rows and coefficients.

A column is known by ``(family, id, k, t)`` and a row by the same four: family, component, a sub-index (period,
tranche, band, constraint) and snapshot. Every family of either is one projection over its components and
snapshots, so nothing is gathered before the solve. Numbers are dense and come last: block starts are a running
sum over a small table of families and components, and a number is a start plus the block's snapshots before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.network import SMALL_ROWS, Network, if_small, is_transport
from feederflow.operators.topology import cost_factor, lines_by_bus, links_by_bus, outage_factors, period_of_snapshot, shared_table, synchronous_areas

INF = float("inf")
#: The order of blocks: (rank, sub-rank) by column family. The numbering of columns follows from it.
COLUMN_ORDER = {
    "dispatch": (0, 0), "gen_capacity": (1, 0), "flow": (2, 0), "line_capacity": (3, 0), "soc": (4, 0), "charge": (4, 1), "discharge": (4, 2), "storage_capacity": (5, 0), "line_loss": (6, 0), "link_flow": (7, 0),
    "link_capacity": (8, 0), "interrupt": (9, 0), "interrupt_mw": (9, 1), "demand_tranche": (10, 0), "load_shift": (11, 0), "load_shift_abs": (12, 0), "head_band": (13, 0), "head_discharge": (13, 1), "status": (14, 0),
    "start_up": (14, 1), "shut_down": (14, 2), "spill": (15, 0), "shed": (16, 0), "angle": (17, 0),
}
#: The order of rows, likewise; the balance comes first, so bus b at t is row ``b * T + t``.
ROW_ORDER = {f: k for k, f in enumerate(["balance", "dc_flow", "storage", "gen_capacity", "line_capacity", "storage_capacity", "link_capacity", "commitment", "reserve", "ramp", "shift", "interrupt", "head", "head_band", "loss", "co2", "water", "land", "security"])}
KEY = ["family", "id", "k", "t"]
TERM = "array<struct<cfamily:string,cid:bigint,ck:int,ct:int,val:double>>"


@dataclass(frozen=True)
class Model:
    cols: DataFrame  # family, id, k, t, lower, upper, obj, is_int
    rows: DataFrame  # family, id, k, t, lower, upper
    coef: DataFrame  # family, id, k, t, cfamily, cid, ck, ct, val


def _columns(df: DataFrame, family: str, cid: str, lower, upper, obj=0.0, is_int: bool = False, k=0, t="t") -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    return df.select(F.lit(family).alias("family"), F.col(cid).cast("bigint").alias("id"), c(k).cast("int").alias("k"), c(t).cast("int").alias("t"), c(lower).cast("double").alias("lower"), c(upper).cast("double").alias("upper"), c(obj).cast("double").alias("obj"), F.lit(is_int).alias("is_int"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Assembly:
    """The families of columns and rows of a network. Each is a method that returns a lazy table."""

    def __init__(self, net: Network):
        self.net = net
        self.times = if_small(net["snapshots"].select("t", "weight"))
        self.horizon = self.times.agg(F.count("*").cast("int").alias("n"))
        self.factor = if_small(cost_factor(net))
        self.periods = if_small(net["periods"].select("period", "discount"))

    # Shared pieces

    def _over(self, df: DataFrame) -> DataFrame:
        """Components by snapshots."""
        return df.join(self.times)

    def _priced(self, df: DataFrame) -> DataFrame:
        return df.join(self.factor, "t")

    def _with_series(self, df: DataFrame, series: str, key: str, name: str) -> DataFrame:
        """``df`` with a series' values, null where it has none.

        Both sides are dealt out, whatever the planner takes the series for: it has a row for each snapshot, and where
        those are unfolded from a row for each component the planner's estimate is that of the components.
        """
        if series not in self.net.tables:
            return df.withColumn(name, F.lit(None).cast("double"))
        return df.join(self.net[series].withColumnRenamed("value", name).hint("merge"), [key, "t"], "left")

    def available_generators(self) -> DataFrame:
        gens = self._over(self.net["generators"])
        return self._with_series(gens, "gen_availability", "gen_id", "a").withColumn("a", F.coalesce("a", F.lit(1.0)))

    def demands(self) -> DataFrame:
        loads = self._over(self.net["loads"])
        return self._with_series(loads, "load_profile", "load_id", "demand").withColumn("demand", F.coalesce("demand", "p_set"))

    def _built(self, table: str, cid: str, family: str, ceiling: str) -> DataFrame:
        """A capacity column for each period and component that may grow; one period where none is stated."""
        some = self.periods.unionByName(self.periods.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("period"), F.lit(1.0).alias("discount")))
        df = self.net[table].where(F.col("s_nom_extendable" if table == "lines" else "p_nom_extendable")).join(some)
        return _columns(df, family, cid, 0.0, ceiling, F.col("capital_cost") * F.col("discount"), k="period", t=0)

    @staticmethod
    def shiftable():
        return F.col("shiftable_pu") > 0

    @staticmethod
    def banded():
        return (F.col("head_bands") >= 2) & (F.col("head_min_pu") < 1) & (F.col("p_nom") > 0)

    # Columns

    def dispatch(self) -> DataFrame:
        df = self._priced(self.available_generators())
        top = F.when(F.col("p_nom_extendable"), F.when(F.col("a") > 0, F.col("p_nom_max") * F.col("a")).otherwise(0.0)).otherwise(F.col("p_nom") * F.col("a"))
        low = F.when(F.col("p_nom_extendable") | F.col("committable"), 0.0).otherwise(F.least(F.col("p_nom") * F.col("p_min_pu"), F.col("p_nom") * F.col("a")))
        return _columns(df, "dispatch", "gen_id", low, top, (F.col("marginal_cost") + self.net.settings.co2_price * F.col("co2_emissions")) * F.col("factor"))

    def gen_capacity(self) -> DataFrame:
        return self._built("generators", "gen_id", "gen_capacity", "p_nom_max")

    def flow(self) -> DataFrame:
        top = F.when(F.col("s_nom_extendable"), F.col("s_nom_max")).otherwise(F.col("s_nom"))
        return _columns(self._over(self.net["lines"]), "flow", "line_id", -top, top)

    def line_capacity(self) -> DataFrame:
        return self._built("lines", "line_id", "line_capacity", "s_nom_max")

    def storage(self) -> DataFrame:
        df = self._over(self.net["storage_units"]).withColumn("r", F.when(F.col("p_nom_extendable"), F.col("p_nom_max")).otherwise(F.col("p_nom")))
        return _union([_columns(df, "soc", "storage_id", 0.0, F.col("r") * F.col("max_hours")), _columns(df, "charge", "storage_id", 0.0, "r"), _columns(df, "discharge", "storage_id", 0.0, "r")])

    def storage_capacity(self) -> DataFrame:
        return self._built("storage_units", "storage_id", "storage_capacity", "p_nom_max")

    def line_loss(self) -> DataFrame:
        return _columns(self._over(self.net["lines"].where("loss > 0")), "line_loss", "line_id", 0.0, INF)

    def link_flow(self) -> DataFrame:
        top = F.when(F.col("p_nom_extendable"), F.col("p_nom_max")).otherwise(F.col("p_nom"))
        return _columns(self._priced(self._over(self.net["links"])), "link_flow", "link_id", 0.0, top, F.col("marginal_cost") * F.col("factor"))

    def link_capacity(self) -> DataFrame:
        return self._built("links", "link_id", "link_capacity", "p_nom_max")

    def interrupt(self) -> DataFrame:
        df = self._priced(self._over(self.net["loads"].where("interruptible_mw > 0 and max_interruptions > 0")))
        return _columns(df, "interrupt", "load_id", 0.0, 1.0, is_int=True).unionByName(_columns(df, "interrupt_mw", "load_id", 0.0, "interruptible_mw", F.col("interruption_cost") * F.col("factor")))

    def demand_tranche(self) -> DataFrame:
        df = self.net["loads"].select("load_id", F.posexplode("value_tranches").alias("k", "x")).where("x.mw > 0")
        return _columns(self._priced(self._over(df)), "demand_tranche", "load_id", 0.0, "x.mw", F.col("x.value") * F.col("factor"), k="k")

    def _shifting(self) -> DataFrame:
        df = self.demands().where(self.shiftable())
        return df.withColumn("peak", F.greatest(F.max("demand").over(Window.partitionBy("load_id")), F.lit(0.0))).where("peak > 0")

    def load_shift(self) -> DataFrame:
        most = F.least("shiftable_pu", F.lit(1.0)) * F.col("peak")
        return _columns(self._shifting(), "load_shift", "load_id", -most, most)

    def load_shift_abs(self) -> DataFrame:
        return _columns(self._shifting().where("shift_cost > 0"), "load_shift_abs", "load_id", 0.0, INF, "shift_cost")

    def head_band(self) -> DataFrame:
        df = self._over(self.net["storage_units"].where(self.banded()).select("storage_id", "p_nom", F.explode(F.sequence(F.lit(0), F.col("head_bands") - 1)).alias("k")))
        return _columns(df, "head_band", "storage_id", 0.0, 1.0, is_int=True, k="k").unionByName(_columns(df, "head_discharge", "storage_id", 0.0, "p_nom", k="k"))

    def commitment(self) -> DataFrame:
        df = self._over(self.net["generators"].where("committable"))
        return _union([_columns(df, "status", "gen_id", 0.0, 1.0, is_int=True), _columns(df, "start_up", "gen_id", 0.0, 1.0, "start_up_cost"), _columns(df, "shut_down", "gen_id", 0.0, 1.0, "shut_down_cost")])

    def spill(self) -> DataFrame:
        return _columns(self._over(self.net["storage_units"].where("spillable")), "spill", "storage_id", 0.0, INF)

    def shed(self) -> DataFrame:
        return _columns(self._priced(self._over(self.net["buses"])), "shed", "bus_id", 0.0, INF, F.lit(self.net.settings.value_of_lost_load) * F.col("factor"))

    def angle(self) -> DataFrame:
        """Angles exist where any line has physics; the first bus of each area is pinned to 0."""
        physics = self.net["lines"].where(~is_transport()).agg(F.count("*").alias("n")).where("n > 0")
        first = F.min("bus_id").over(Window.partitionBy("synchronous_area")) == F.col("bus_id")
        df = self._over(self.net["buses"].withColumn("pinned", first).join(F.broadcast(physics)))
        return _columns(df, "angle", "bus_id", F.when(F.col("pinned"), 0.0).otherwise(-INF), F.when(F.col("pinned"), 0.0).otherwise(INF))

    def angle_columns(self) -> DataFrame:
        """An angle for each bus that a line with physics touches, unpinned: the columns of a flow model alone."""
        ends = self.net["lines"].where(~is_transport()).select(F.explode(F.array("bus0", "bus1")).alias("bus_id")).distinct()
        return _columns(self._over(ends), "angle", "bus_id", -INF, INF)

    #: The families of columns by the table whose components they belong to.
    COLUMNS = {
        "generators": ("dispatch", "gen_capacity", "commitment"), "lines": ("flow", "line_capacity", "line_loss", "angle"), "storage_units": ("storage", "storage_capacity", "head_band", "spill"), "links": ("link_flow", "link_capacity"),
        "loads": ("interrupt", "demand_tranche", "load_shift", "load_shift_abs"), "buses": ("shed",),
    }

    def columns(self) -> DataFrame:
        """All columns; families of tables that the network lacks are left out of the plan."""
        return _union([getattr(self, f)() for table, families in self.COLUMNS.items() if table in self.net.tables for f in families])

    # Rows: each family gives (family, id, k, t, lower, upper, terms)

    @staticmethod
    def _row(df: DataFrame, family: str, rid, lower, upper, terms: list, k=0, t="t", more: Column | None = None) -> DataFrame:
        """Rows with the terms ``(term, condition)`` and those of the array ``more``."""
        c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
        made = F.array(*[x if w is None else F.when(w, x) for x, w in terms]).cast(TERM)
        return df.select(F.lit(family).alias("family"), c(rid).cast("bigint").alias("id"), c(k).cast("int").alias("k"), c(t).cast("int").alias("t"), c(lower).cast("double").alias("lower"), c(upper).cast("double").alias("upper"), (F.filter(made, lambda x: x.isNotNull()) if more is None else F.concat(F.filter(made, lambda x: x.isNotNull()), more)).alias("terms"))

    @staticmethod
    def _term(family: str, cid, val, t="t", k=0, when=None) -> tuple[Column, Column | None]:
        c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
        return F.struct(F.lit(family).alias("cfamily"), c(cid).cast("bigint").alias("cid"), c(k).cast("int").alias("ck"), c(t).cast("int").alias("ct"), c(val).cast("double").alias("val")), when

    def balance_terms(self) -> DataFrame:
        """All terms of the nodal balance, by bus and snapshot."""
        net, parts = self.net, []

        def add(table: str, df: DataFrame, family: str, cid: str, val, k=0) -> None:
            if table not in net.tables:
                return
            t = self._over(df)
            parts.append(t.select(F.lit("balance").alias("family"), F.col("bus_id").cast("bigint").alias("id"), F.lit(0).alias("k"), "t", F.lit(family).alias("cfamily"), F.col(cid).cast("bigint").alias("cid"), (F.lit(0) if k == 0 else F.col(k)).cast("int").alias("ck"), F.col("t").alias("ct"), val.cast("double").alias("val")))

        add("generators", net["generators"].select("gen_id", "bus_id"), "dispatch", "gen_id", F.lit(1.0))
        add("lines", lines_by_bus(net["lines"].where("bus0 <> bus1")), "flow", "line_id", F.col("sign"))
        add("storage_units", net["storage_units"].select("storage_id", "bus_id"), "discharge", "storage_id", F.lit(1.0))
        add("storage_units", net["storage_units"].select("storage_id", "bus_id"), "charge", "storage_id", F.lit(-1.0))
        add("links", links_by_bus(net["links"].where("bus0 <> bus1")), "link_flow", "link_id", F.col("coefficient"))
        add("links", net["links"].where("bus0 = bus1 and efficiency <> 1").select(F.col("bus0").alias("bus_id"), "link_id", (F.col("efficiency") - 1).alias("coefficient")), "link_flow", "link_id", F.col("coefficient"))
        add("lines", lines_by_bus(net["lines"].where("loss > 0 and bus0 <> bus1")), "line_loss", "line_id", F.lit(-0.5))
        add("lines", net["lines"].where("loss > 0 and bus0 = bus1").select(F.col("bus0").alias("bus_id"), "line_id"), "line_loss", "line_id", F.lit(-1.0))
        add("buses", net["buses"].select("bus_id"), "shed", "bus_id", F.lit(1.0))
        add("loads", net["loads"].where("interruptible_mw > 0 and max_interruptions > 0").select("load_id", "bus_id"), "interrupt_mw", "load_id", F.lit(1.0))
        add("loads", net["loads"].select("load_id", "bus_id", F.posexplode("value_tranches").alias("k", "x")).where("x.mw > 0"), "demand_tranche", "load_id", F.lit(1.0), "k")
        if "loads" not in net.tables:
            return _union(parts)
        shifting = self._shifting().select("load_id", "bus_id", "t")
        parts.append(shifting.select(F.lit("balance").alias("family"), F.col("bus_id").cast("bigint").alias("id"), F.lit(0).alias("k"), "t", F.lit("load_shift").alias("cfamily"), F.col("load_id").cast("bigint").alias("cid"), F.lit(0).alias("ck"), F.col("t").alias("ct"), F.lit(-1.0).alias("val")))
        return _union(parts)

    def balance_rows(self) -> DataFrame:
        need = self.demands().groupBy("bus_id", "t").agg(F.sum("demand").alias("demand"))
        df = self._over(self.net["buses"].select("bus_id", "g_shunt")).join(need, ["bus_id", "t"], "left")
        rhs = F.coalesce("demand", F.lit(0.0)) + F.col("g_shunt") * self.net.settings.base_mva
        return df.select(F.lit("balance").alias("family"), F.col("bus_id").cast("bigint").alias("id"), F.lit(0).alias("k"), "t", rhs.alias("lower"), rhs.alias("upper"))

    def dc_flow(self) -> DataFrame:
        df = self._over(self.net["lines"].where(~is_transport()))
        b, rhs, x = F.col("susceptance"), -F.col("susceptance") * F.col("phase_shift"), self._term
        return self._row(df, "dc_flow", "line_id", rhs, rhs, [x("flow", "line_id", 1.0), x("angle", "bus0", -b, when=F.col("bus0") != F.col("bus1")), x("angle", "bus1", b, when=F.col("bus0") != F.col("bus1"))])

    def storage_balance(self) -> DataFrame:
        x, net = self._term, self.net
        units = net["storage_units"]
        df = self._with_series(self._with_series(self._over(units).join(F.broadcast(self.horizon)), "storage_inflow", "storage_id", "inflow"), "head_profile", "storage_id", "head")
        itself_at_once = F.coalesce((F.col("downstream_id") == F.col("storage_id")) & (F.col("travel_time") == 0), F.lit(False))
        feeders = units.where(F.col("downstream_id").isNotNull() & ~itself_at_once).groupBy(F.col("downstream_id").alias("storage_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("storage_id").alias("src"), F.col("travel_time").alias("lag"), F.col("spillable").alias("spills")))).alias("feeders"))
        df = df.join(feeders, "storage_id", "left")
        w, start = F.col("weight"), (F.col("t") == 0) & F.col("soc_initial").isNotNull()
        linked = ~start & ((F.col("t") > 0) | F.col("cyclic"))
        itself = linked & (F.col("n") == 1)
        draw = w / F.col("efficiency_dispatch") / F.when(F.col("head") > 1e-6, F.col("head")).otherwise(1.0)
        terms = [x("soc", "storage_id", 1.0, when=~itself), x("soc", "storage_id", -1.0, t=F.when(F.col("t") > 0, F.col("t") - 1).otherwise(F.col("n") - 1), when=linked & ~itself), x("charge", "storage_id", -F.col("efficiency_store") * w), x("discharge", "storage_id", F.when(itself_at_once, draw - w).otherwise(draw), when=~self.banded()), x("spill", "storage_id", w, when=F.col("spillable") & ~itself_at_once)]
        back = F.when(itself_at_once & self.banded(), F.array(x("discharge", "storage_id", -w)[0])).otherwise(F.array()).cast(TERM)
        rhs = F.coalesce("inflow", F.lit(0.0)) * w + F.when(start, F.col("soc_initial")).otherwise(0.0)
        level = lambda b: F.greatest(F.lit(1e-6), F.col("head_min_pu") + (1 - F.col("head_min_pu")) * (b + 0.5) / F.col("head_bands"))
        bands = F.when(self.banded(), F.transform(F.sequence(F.lit(0), F.greatest(F.col("head_bands"), F.lit(1)) - 1), lambda b: F.struct(F.lit("head_discharge").alias("cfamily"), F.col("storage_id").cast("bigint").alias("cid"), b.alias("ck"), F.col("t").alias("ct"), (w / F.col("efficiency_dispatch") / level(b)).alias("val")))).otherwise(F.array().cast(TERM)).cast(TERM)
        come = F.filter(F.coalesce("feeders", F.array().cast("array<struct<src:int,lag:int,spills:boolean>>")), lambda f: f["lag"] <= F.col("t"))
        arrive = lambda family: lambda f: F.struct(F.lit(family).alias("cfamily"), f["src"].cast("bigint").alias("cid"), F.lit(0).alias("ck"), (F.col("t") - f["lag"]).alias("ct"), (-w).alias("val"))
        arrivals = F.concat(F.transform(come, arrive("discharge")).cast(TERM), F.transform(F.filter(come, lambda f: f["spills"]), arrive("spill")).cast(TERM))
        return self._row(df, "storage", "storage_id", rhs, rhs, terms, more=F.concat(bands, arrivals, back))

    def _grown(self, family: str, cid: str, val) -> Column:
        """The capacity of all periods up to the snapshot's own."""
        return F.transform(F.sequence(F.lit(0), F.col("period")), lambda q: F.struct(F.lit(family).alias("cfamily"), F.col(cid).cast("bigint").alias("cid"), q.alias("ck"), F.lit(0).alias("ct"), val.cast("double").alias("val"))).cast(TERM)

    def _tied(self, df: DataFrame, family: str, cid: str, sides: list[tuple]) -> DataFrame:
        """Rows that tie a column to built capacity: ``(k, column, factor, lower, upper, when)`` each."""
        df = df.join(if_small(period_of_snapshot(self.times, self.net["periods"])), "t")
        return _union([self._row(df if when is None else df.where(when), family, cid, lower, upper, [self._term(column, cid, 1.0)], k=k, more=self._grown(family, cid, factor)) for k, column, factor, lower, upper, when in sides])

    def capacity_ties(self) -> DataFrame:
        net, parts, one = self.net, [], F.lit(1.0)
        g = self.available_generators().where("p_nom_extendable")
        a, low = F.col("a"), F.col("p_min_pu") * F.col("a")
        parts.append(self._tied(g, "gen_capacity", "gen_id", [(0, "dispatch", -a, -INF, a * F.col("p_nom"), None), (1, "dispatch", -low, low * F.col("p_nom"), INF, F.col("p_min_pu") > 0)]))
        if "lines" in net.tables:
            parts.append(self._tied(self._over(net["lines"].where("s_nom_extendable")), "line_capacity", "line_id", [(0, "flow", -one, -INF, "s_nom", None), (1, "flow", one, -F.col("s_nom"), INF, None)]))
        if "storage_units" in net.tables:
            parts.append(self._tied(self._over(net["storage_units"].where("p_nom_extendable")), "storage_capacity", "storage_id", [(0, "charge", -one, -INF, "p_nom", None), (1, "discharge", -one, -INF, "p_nom", None), (2, "soc", -F.col("max_hours"), -INF, F.col("p_nom") * F.col("max_hours"), None)]))
        if "links" in net.tables:
            parts.append(self._tied(self._over(net["links"].where("p_nom_extendable")), "link_capacity", "link_id", [(0, "link_flow", -one, -INF, "p_nom", None)]))
        return _union(parts)

    def commitment_rows(self) -> DataFrame:
        x = self._term
        df = self._over(self.net["generators"].where("committable")).join(F.broadcast(self.horizon))
        able = self.available_generators().where("committable").withColumn("top", F.col("p_nom") * F.col("a")).withColumn("low", F.col("p_nom") * F.col("p_min_pu") * F.col("a"))
        stated = (F.col("t") == 0) & F.col("initially_on").isNotNull()
        itself = ~stated & (F.col("n") == 1)
        on = F.when(stated, F.col("initially_on").cast("double")).otherwise(0.0)
        before = F.when(F.col("t") > 0, F.col("t") - 1).otherwise(F.col("n") - 1)
        parts = [
            self._row(able, "commitment", "gen_id", -INF, 0.0, [x("dispatch", "gen_id", 1.0), x("status", "gen_id", -F.col("top"))], k=0),
            self._row(able.where("low > 0"), "commitment", "gen_id", 0.0, INF, [x("dispatch", "gen_id", 1.0), x("status", "gen_id", -F.col("low"))], k=1),
            self._row(df, "commitment", "gen_id", on, on, [x("status", "gen_id", 1.0, when=~itself), x("status", "gen_id", -1.0, t=before, when=~stated & ~itself), x("start_up", "gen_id", -1.0), x("shut_down", "gen_id", 1.0)], k=2),
        ]
        for k, hours, moved, sign, top in ((3, "min_up_time", "start_up", -1.0, 0.0), (4, "min_down_time", "shut_down", 1.0, 1.0)):
            rows = df.where(~stated & (F.col(hours) > 1) & (F.col("t") + 1 >= F.col(hours)))
            terms = F.concat(self._window(moved, hours), F.array(x("status", "gen_id", sign)[0]).cast(TERM))
            parts.append(rows.select(F.lit("commitment").alias("family"), F.col("gen_id").cast("bigint").alias("id"), F.lit(k).alias("k"), "t", F.lit(-INF).alias("lower"), F.lit(top).alias("upper"), terms.alias("terms")))
        return _union(parts)

    @staticmethod
    def _window(family: str, hours: str) -> Column:
        """The columns of the last ``hours`` snapshots, this one included: a band written as a short sequence, not as a join."""
        return F.transform(F.sequence(F.col("t") + 1 - F.col(hours), F.col("t")), lambda s: F.struct(F.lit(family).alias("cfamily"), F.col("gen_id").cast("bigint").alias("cid"), F.lit(0).alias("ck"), s.alias("ct"), F.lit(1.0).alias("val"))).cast(TERM)

    def reserve(self) -> DataFrame:
        """One row per area: firm capacity covers the peak and a margin. Without anything to build the row still asks for what is missing."""
        from feederflow.operators.reductions import area_peak, capacity_credit

        net, margin = self.net, self.net.settings.reserve_margin
        area = net["buses"].select("bus_id", F.col("synchronous_area").alias("area"))
        gens = net["generators"].join(capacity_credit(net), "gen_id").where("credit > 0").select("bus_id", F.lit("gen_capacity").alias("cfamily"), F.col("gen_id").cast("bigint").alias("cid"), "p_nom", "p_nom_extendable", "credit")
        stores = net["storage_units"].select("bus_id", F.lit("storage_capacity").alias("cfamily"), F.col("storage_id").cast("bigint").alias("cid"), "p_nom", "p_nom_extendable", F.lit(1.0).alias("credit"))
        firm = gens.unionByName(stores).join(area, "bus_id")
        have = firm.groupBy("area").agg(F.sum(F.col("p_nom") * F.col("credit")).alias("firm"))
        periods = self.periods.agg(F.greatest(F.count("*"), F.lit(1)).cast("int").alias("np"))
        grow = firm.where("p_nom_extendable").join(F.broadcast(periods)).select("area", "cfamily", "cid", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("ck"), "credit")
        grow = grow.groupBy("area").agg(F.collect_list(F.struct("cfamily", "cid", "ck", F.lit(0).alias("ct"), F.col("credit").alias("val"))).alias("terms"))
        areas = area.groupBy("area").agg(F.min("bus_id").alias("first"))
        df = areas.join(area_peak(net), "area", "left").join(have, "area", "left").join(grow, "area", "left")
        need = F.greatest(F.coalesce("peak", F.lit(0.0)), F.lit(0.0)) * (1 + (margin or 0.0)) - F.coalesce("firm", F.lit(0.0))
        return df.select(F.lit("reserve").alias("family"), F.col("first").cast("bigint").alias("id"), F.lit(0).alias("k"), F.lit(0).alias("t"), need.alias("lower"), F.lit(INF).alias("upper"), F.coalesce(F.col("terms").cast(TERM), F.array().cast(TERM)).alias("terms"))

    def ramps(self) -> DataFrame:
        x = self._term
        df = self._over(self.net["generators"]).where("t >= 1")
        both = [x("dispatch", "gen_id", 1.0), x("dispatch", "gen_id", -1.0, t=F.col("t") - 1)]
        return self._row(df.where("ramp_up > 0 and ramp_up < 1"), "ramp", "gen_id", -INF, F.col("ramp_up") * F.col("p_nom"), both, k=0).unionByName(self._row(df.where("ramp_down > 0 and ramp_down < 1"), "ramp", "gen_id", -F.col("ramp_down") * F.col("p_nom"), INF, both, k=1))

    def shift(self) -> DataFrame:
        x, df = self._term, self._shifting().join(F.broadcast(self.horizon))
        window = F.when((F.col("shift_window") == 0) | (F.col("shift_window") > F.col("n")), F.col("n")).otherwise(F.col("shift_window"))
        whole = df.withColumn("w", F.floor(F.col("t") / window).cast("int")).groupBy("load_id", "w").agg(F.sort_array(F.collect_list(F.struct(F.lit("load_shift").alias("cfamily"), F.col("load_id").cast("bigint").alias("cid"), F.lit(0).alias("ck"), F.col("t").alias("ct"), F.lit(1.0).alias("val")))).alias("terms"))
        parts = [whole.select(F.lit("shift").alias("family"), F.col("load_id").cast("bigint").alias("id"), F.lit(0).alias("k"), F.col("w").alias("t"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.col("terms").cast(TERM).alias("terms"))]
        costly = df.where("shift_cost > 0")
        for k, sign in ((1, 1.0), (2, -1.0)):
            parts.append(self._row(costly, "shift", "load_id", -INF, 0.0, [x("load_shift", "load_id", sign), x("load_shift_abs", "load_id", -1.0)], k=k))
        most = F.least("shiftable_pu", F.lit(1.0)) * F.col("demand")
        parts.append(self._row(df, "shift", "load_id", -most, most, [x("load_shift", "load_id", 1.0)], k=3))
        return _union(parts)

    def interruptible(self) -> DataFrame:
        x = self._term
        df = self._over(self.net["loads"].where("interruptible_mw > 0 and max_interruptions > 0"))
        each = self._row(df, "interrupt", "load_id", -INF, 0.0, [x("interrupt_mw", "load_id", 1.0), x("interrupt", "load_id", -F.col("interruptible_mw"))])
        total = df.groupBy("load_id").agg(F.max("max_interruptions").cast("double").alias("most"), F.sort_array(F.collect_list(F.struct(F.lit("interrupt").alias("cfamily"), F.col("load_id").cast("bigint").alias("cid"), F.lit(0).alias("ck"), F.col("t").alias("ct"), F.lit(1.0).alias("val")))).alias("terms"))
        return each.unionByName(total.select(F.lit("interrupt").alias("family"), F.col("load_id").cast("bigint").alias("id"), F.lit(1).alias("k"), F.lit(0).alias("t"), F.lit(-INF).alias("lower"), F.col("most").alias("upper"), F.col("terms").cast(TERM).alias("terms")))

    def head(self) -> DataFrame:
        x = self._term
        df = self._over(self.net["storage_units"].where("head_min_pu < 1 and max_hours > 0 and p_nom > 0")).join(F.broadcast(self.horizon))
        slope, floor = F.col("p_nom") * (1 - F.col("head_min_pu")) / (F.col("p_nom") * F.col("max_hours")), F.col("p_nom") * F.col("head_min_pu")
        first = F.col("t") == 0
        fixed = first & (F.col("soc_initial").isNotNull() | ~F.col("cyclic"))
        top = floor + F.when(first & F.col("soc_initial").isNotNull(), slope * F.col("soc_initial")).otherwise(0.0)
        return self._row(df, "head", "storage_id", -INF, top, [x("discharge", "storage_id", 1.0), x("soc", "storage_id", -slope, t=F.when(first, F.col("n") - 1).otherwise(F.col("t") - 1), when=~fixed)])

    def head_bands(self) -> DataFrame:
        x = self._term
        units = self._over(self.net["storage_units"].where(self.banded())).join(F.broadcast(self.horizon)).withColumn("e", F.col("p_nom") * F.col("max_hours"))
        every = lambda family, val: F.transform(F.sequence(F.lit(0), F.col("head_bands") - 1), lambda b: F.struct(F.lit(family).alias("cfamily"), F.col("storage_id").cast("bigint").alias("cid"), b.alias("ck"), F.col("t").alias("ct"), F.lit(val).alias("val"))).cast(TERM)
        row = lambda df, k, lower, upper, terms: df.select(F.lit("head_band").alias("family"), F.col("storage_id").cast("bigint").alias("id"), (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k"), "t", lower.cast("double").alias("lower"), upper.cast("double").alias("upper"), terms.alias("terms"))
        zero, one = F.lit(0.0), F.lit(1.0)
        parts = [row(units, 0, one, one, every("head_band", 1.0)), row(units, 1, zero, zero, F.concat(F.array(x("discharge", "storage_id", 1.0)[0]).cast(TERM), every("head_discharge", -1.0)))]
        df = units.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("head_bands") - 1)))
        first = F.col("t") == 0
        fixed = first & (F.col("soc_initial").isNotNull() | ~F.col("cyclic"))
        level = F.coalesce("soc_initial", F.lit(0.0))
        which = F.when(F.col("e") > 0, F.least(F.floor(level / F.col("e") * F.col("head_bands")), F.col("head_bands") - 1)).otherwise(0)
        pin = F.when(F.col("b") == which, 1.0).otherwise(0.0)
        before = F.when(first, F.col("n") - 1).otherwise(F.col("t") - 1)
        lo, hi = F.col("e") * F.col("b") / F.col("head_bands"), F.col("e") * (F.col("b") + 1) / F.col("head_bands")
        arr = lambda *ts: F.array(*[t[0] for t in ts]).cast(TERM)
        z = x("head_band", "storage_id", 1.0, k="b")
        parts += [
            row(df, 2 + 4 * F.col("b"), F.lit(-INF), zero, arr(x("head_discharge", "storage_id", 1.0, k="b"), x("head_band", "storage_id", -F.col("p_nom"), k="b"))),
            row(df.where(fixed), 3 + 4 * F.col("b"), pin, pin, arr(z)),
            row(df.where(~fixed), 4 + 4 * F.col("b"), F.lit(-INF), F.col("e") - lo, arr(x("soc", "storage_id", -1.0, t=before), x("head_band", "storage_id", F.col("e"), k="b"))),
            row(df.where(~fixed), 5 + 4 * F.col("b"), F.lit(-INF), hi + F.col("e"), arr(x("soc", "storage_id", 1.0, t=before), x("head_band", "storage_id", F.col("e"), k="b"))),
        ]
        return _union(parts)

    def losses(self) -> DataFrame:
        x, df = self._term, self._over(self.net["lines"].where("loss > 0"))
        return _union([self._row(df, "loss", "line_id", 0.0, INF, [x("line_loss", "line_id", 1.0), x("flow", "line_id", sign * F.col("loss"))], k=k) for k, sign in ((0, -1), (1, 1))])

    def budget_terms(self, family: str, per_mwh: str | None, per_mw: str | None) -> DataFrame:
        """The terms of one row over the whole system; they stay a long table, never one array."""
        key = [F.lit(family).alias("family"), F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("k"), F.lit(0).alias("t")]
        parts = []
        if per_mwh:
            df = self._over(self.net["generators"].where(F.col(per_mwh) > 0))
            parts.append(df.select(*key, F.lit("dispatch").alias("cfamily"), F.col("gen_id").cast("bigint").alias("cid"), F.lit(0).alias("ck"), F.col("t").alias("ct"), (F.col(per_mwh) * F.col("weight")).alias("val")))
        if per_mw:
            built = self.gen_capacity().select("id", F.col("k").alias("ck")).join(self.net["generators"].where(F.col(per_mw) > 0).select(F.col("gen_id").cast("bigint").alias("id"), F.col(per_mw).alias("rate")), "id")
            parts.append(built.select(*key, F.lit("gen_capacity").alias("cfamily"), F.col("id").alias("cid"), "ck", F.lit(0).alias("ct"), F.col("rate").alias("val")).select("family", F.lit(0).cast("bigint").alias("id"), "k", "t", "cfamily", "cid", "ck", "ct", "val"))
        return _union(parts)

    def security(self) -> DataFrame:
        """After the outage of a listed line, what the others carry stays within their rating."""
        x, net = self._term, self.net
        areas = synchronous_areas(net["buses"], net["lines"])
        rated = net["lines"].where(~is_transport() & (F.abs("s_nom") != INF)).select(F.col("line_id").alias("monitored"), "s_nom")
        pairs = outage_factors(net["lines"], areas, net["contingencies"]).where("not islanding and abs(factor) >= 1e-9").join(rated, "monitored")
        return self._row(self._over(pairs), "security", "monitored", -F.col("s_nom"), "s_nom", [x("flow", "monitored", 1.0), x("flow", "outaged", "factor")], k="outaged")

    #: The families of rows by the table whose components they belong to.
    FIXED = {
        "dc_flow": "lines", "storage_balance": "storage_units", "capacity_ties": "buses", "commitment_rows": "generators", "ramps": "generators", "shift": "loads", "interruptible": "loads", "head": "storage_units", "head_bands": "storage_units",
        "losses": "lines",
    }
    BUDGETS = (("co2", "co2_emissions", "embodied_co2"), ("water", "water_use", None), ("land", None, "land_use"))

    def model(self, families: tuple[str, ...] | None = None) -> Model:
        """All of it; ``families`` names the row families besides the balance, all by default."""
        names = families if families is not None else tuple(self.FIXED)
        made = [getattr(self, f)() for f in names if self.FIXED.get(f) in self.net.tables]
        if self.net.settings.reserve_margin is not None and (families is None or "reserve" in families):
            made.append(self.reserve())
        if "contingencies" in self.net.tables and (families is None or "security" in families):
            made.append(self.security())
        rows, coef = [self.balance_rows()], [self.balance_terms()]
        for m in made:
            rows.append(m.select(*KEY, "lower", "upper"))
            coef.append(m.select(*KEY, F.inline("terms")))
        for name, per_mwh, per_mw in self.BUDGETS:
            limit = getattr(self.net.settings, f"{name}_limit")
            if limit is not None and (families is None or name in families):
                rows.append(self.net.spark.range(1).select(F.lit(name).alias("family"), F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(-INF).alias("lower"), F.lit(float(limit)).alias("upper")))
                coef.append(self.budget_terms(name, per_mwh, per_mw))
        # No family names a column twice in a row, so there is nothing to sum and the coefficients stay where they are made.
        return Model(self.columns(), _union(rows), _union(coef).where("val <> 0"))


#: Components whose blocks are numbered together; their starts are sums within such a range after the sum of all ranges before.
RANGE = 4096


def blocks(df: DataFrame, order: dict) -> DataFrame:
    """``(family, id, k, start, t0, n, words)``: where the numbers of each family, component and sub-index begin.

    A block whose snapshots stand without gaps from ``t0`` has no ``words``. Any other has one for every 64 snapshots
    from that of ``t0``: a bit for each snapshot that is there, and how many are there before the word. The running
    sum is one of ranges of components, then one within each range, so that no task sees all components.
    """
    rank = lambda at: F.element_at(F.create_map(*[x for f, r in order.items() for x in (F.lit(f), F.lit(r[at] if isinstance(r, tuple) else r if at == 0 else 0))]), F.col("family"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["family", "id", "k"]
    word = df.groupBy(*key, F.shiftright("t", 6).alias("word")).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.bit_or(_bit(F.col("t"))).alias("bits"))
    twice = F.raise_error(F.format_string("%s %d has a snapshot twice", "family", "id")).cast("bigint")
    word = word.withColumn("n", F.when(F.bit_count("bits") == F.col("n"), F.col("n")).otherwise(twice))
    line = Window.partitionBy(*key).orderBy("word")
    word = word.withColumn("before", before(line)).withColumn("holes", F.coalesce(F.lead("word").over(line) - F.col("word") - 1, F.lit(0)))
    each = word.groupBy(*key).agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_sort(F.collect_list(F.struct("word", "before", "bits", "holes"))).alias("words"))
    empty = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("bits"))
    dense = F.flatten(F.transform("words", lambda w: F.concat(F.array(F.struct(w["before"].alias("before"), w["bits"].alias("bits"))), F.array_repeat(empty, w["holes"]))))
    each = each.withColumn("words", F.when(F.col("t1") - F.col("t0") + 1 != F.col("n"), dense)).drop("t1")
    each = each.withColumn("r", rank(0)).withColumn("s", rank(1)).withColumn("range", F.floor(F.col("id") / RANGE))
    ranges = each.groupBy("r", "range").agg(F.sum("n").alias("n")).select("r", "range", before(Window.orderBy("r", "range")).alias("base"))
    inside = before(Window.partitionBy("r", "range").orderBy("id", "s", "k"))
    return each.withColumn("inside", inside).join(ranges, ["r", "range"]).select("family", "id", "k", (F.col("base") + F.col("inside")).alias("start"), "t0", "n", "words")


def _bit(t: Column, of: int = 1) -> Column:
    """``of`` moved to the place of snapshot ``t`` in its word."""
    return F.call_function("shiftleft", F.lit(of).cast("bigint"), t.bitwiseAND(63))


def _number(start: str, t: str, t0: str, n: str, words: str) -> Column:
    """The number of snapshot ``t`` of a block: its start and the snapshots before it; null where the block has none."""
    at, begin = F.col(t), F.col(t0)
    word = F.get(words, F.shiftright(at, 6) - F.shiftright(begin, 6))
    some = F.when(word["bits"].bitwiseAND(_bit(at)) != 0, word["before"] + F.bit_count(word["bits"].bitwiseAND(F.bitwise_not(_bit(at, -1)))))
    return F.col(start) + F.when(F.col(words).isNotNull(), some).when((at >= begin) & (at < begin + F.col(n)), at - begin)


def _if_few(starts: DataFrame) -> DataFrame:
    """Blocks marked for a broadcast if they and their words are few."""
    few = starts.agg(F.coalesce(F.sum(1 + F.coalesce(F.array_size("words"), F.lit(0))), F.lit(0))).first()[0] <= SMALL_ROWS
    return F.broadcast(starts) if few else starts


def numbered(df: DataFrame, order: dict, number: str, starts: DataFrame | None = None) -> DataFrame:
    """``df`` with a dense number by family, component, sub-index and snapshot: its block's start and its place there."""
    starts = _if_few(blocks(df, order)) if starts is None else starts
    return df.join(starts, ["family", "id", "k"]).withColumn(number, _number("start", "t", "t0", "n", "words")).drop("start", "t0", "n", "words")


def triplets(model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cols, rows, coef)`` with dense numbers ``col`` and ``row``; ``coef`` is ``(row, col, val)``.

    A coefficient meets the two tables of blocks, which have a row for each component, and never the tables of
    columns and rows. One that names a row or a column that isn't there is left out. The blocks are tables of their
    own, made once, whose size is known before they are joined.
    """
    cols, rows = _starts(model)
    coef = _placed(model.coef, cols, rows).select("row", "col", "val")
    return numbered(model.cols, COLUMN_ORDER, "col", cols), numbered(model.rows, ROW_ORDER, "row", rows), coef


def entries(model: Model) -> DataFrame:
    """``(family, row, col, val)``: the coefficients of :func:`triplets` with the families of their rows."""
    return _placed(model.coef, *_starts(model))


def _starts(model: Model) -> tuple[DataFrame, DataFrame]:
    """The blocks of the columns and of the rows."""
    cols, rows = (_if_few(shared_table(blocks(df, order), "blocks")) for df, order in ((model.cols, COLUMN_ORDER), (model.rows, ROW_ORDER)))
    return cols, rows


def _placed(coef: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    ends = cols.select(F.col("family").alias("cfamily"), F.col("id").alias("cid"), F.col("k").alias("ck"), F.col("start").alias("cstart"), F.col("t0").alias("c0"), F.col("n").alias("cn"), F.col("words").alias("cwords"))
    coef = coef.join(rows, ["family", "id", "k"]).join(ends, ["cfamily", "cid", "ck"])
    return coef.select("family", _number("start", "t", "t0", "n", "words").alias("row"), _number("cstart", "ct", "c0", "cn", "cwords").alias("col"), "val").where("row is not null and col is not null")


def compressed(coef: DataFrame, partitions: int | None = None) -> DataFrame:
    """The transpose: coefficients by column, rows ascending within it, ranges of columns apart."""
    dealt = coef.repartitionByRange(partitions, "col") if partitions else coef.repartitionByRange("col")
    return dealt.sortWithinPartitions("col", "row")


def row_counts(model: Model) -> DataFrame:
    return model.rows.groupBy("family").agg(F.count("*").alias("rows"))


def structural_faults(cols: DataFrame, rows: DataFrame, coef: DataFrame) -> DataFrame:
    """``(fault, n)`` of a numbered matrix: repeated entries, numbers out of range, values that aren't finite or are zero."""
    nr, nc = rows.agg(F.count("*").alias("nr")), cols.agg(F.count("*").alias("nc"))
    twice = coef.groupBy("row", "col").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("fault"), "n")
    wide = coef.join(F.broadcast(nr)).join(F.broadcast(nc)).agg(F.count_if((F.col("row") < 0) | (F.col("row") >= F.col("nr")) | (F.col("col") < 0) | (F.col("col") >= F.col("nc"))).alias("n")).select(F.lit("range").alias("fault"), "n")
    value = coef.agg(F.count_if(F.isnan("val") | (F.abs("val") == INF) | (F.col("val") == 0)).alias("n")).select(F.lit("value").alias("fault"), "n")
    return _union([twice, wide, value])
