"""A network as a set of long tables with explicit keys, and the session that all of it runs in."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each component table, with type and default. A default of None is null ("not stated").
COMPONENTS: dict[str, list[tuple[str, str, object]]] = {
    "snapshots": [("t", "int", None), ("weight", "double", 1.0)],
    "buses": [
        ("bus_id", "int", None), ("name", "string", None), ("country", "string", "??"), ("synchronous_area", "string", "main"), ("g_shunt", "double", 0.0), ("b_shunt", "double", 0.0),
        ("v_nom", "double", 0.0), ("v_min", "double", 0.9), ("v_max", "double", 1.1), ("carrier", "string", "AC"), ("x", "double", None), ("y", "double", None),
    ],
    "generators": [
        ("gen_id", "int", None), ("name", "string", None), ("bus_id", "int", None), ("p_nom", "double", 0.0), ("marginal_cost", "double", 0.0), ("carrier", "string", "unknown"), ("p_min_pu", "double", 0.0),
        ("p_nom_extendable", "boolean", False), ("p_nom_max", "double", float("inf")), ("capital_cost", "double", 0.0), ("co2_emissions", "double", 0.0), ("water_use", "double", 0.0), ("land_use", "double", 0.0),
        ("embodied_co2", "double", 0.0), ("committable", "boolean", False), ("start_up_cost", "double", 0.0), ("shut_down_cost", "double", 0.0), ("min_up_time", "int", 0), ("min_down_time", "int", 0),
        ("ramp_up", "double", 0.0), ("ramp_down", "double", 0.0), ("q_min", "double", float("-inf")), ("q_max", "double", float("inf")), ("initially_on", "boolean", None),
    ],
    "lines": [
        ("line_id", "int", None), ("name", "string", None), ("bus0", "int", None), ("bus1", "int", None), ("s_nom", "double", 0.0), ("susceptance", "double", 0.0), ("s_nom_extendable", "boolean", False),
        ("s_nom_max", "double", float("inf")), ("capital_cost", "double", 0.0), ("resistance", "double", 0.0), ("reactance", "double", 0.0), ("shunt_susceptance", "double", 0.0), ("tap_ratio", "double", 1.0),
        ("phase_shift", "double", 0.0), ("loss", "double", 0.0),
    ],
    "links": [
        ("link_id", "int", None), ("name", "string", None), ("bus0", "int", None), ("bus1", "int", None), ("p_nom", "double", 0.0), ("efficiency", "double", 1.0), ("marginal_cost", "double", 0.0),
        ("p_nom_extendable", "boolean", False), ("p_nom_max", "double", float("inf")), ("capital_cost", "double", 0.0),
    ],
    "loads": [
        ("load_id", "int", None), ("name", "string", None), ("bus_id", "int", None), ("p_set", "double", 0.0), ("q_set", "double", 0.0), ("shiftable_pu", "double", 0.0), ("shift_window", "int", 0),
        ("shift_cost", "double", 0.0), ("interruptible_mw", "double", 0.0), ("max_interruptions", "int", 0), ("interruption_cost", "double", 0.0), ("value_tranches", "array<struct<mw:double,value:double>>", []),
    ],
    "storage_units": [
        ("storage_id", "int", None), ("name", "string", None), ("bus_id", "int", None), ("p_nom", "double", 0.0), ("max_hours", "double", 0.0), ("efficiency_store", "double", 1.0), ("efficiency_dispatch", "double", 1.0),
        ("cyclic", "boolean", True), ("p_nom_extendable", "boolean", False), ("p_nom_max", "double", float("inf")), ("capital_cost", "double", 0.0), ("head_min_pu", "double", 1.0), ("head_bands", "int", 0),
        ("downstream_id", "int", None), ("travel_time", "int", 0), ("soc_initial", "double", None), ("spillable", "boolean", False),
    ],
    "periods": [("period", "int", None), ("name", "string", None), ("first_snapshot", "int", 0), ("n_snapshots", "int", 0), ("discount", "double", 1.0)],
    "scenarios": [("scenario", "int", None), ("name", "string", None), ("first_snapshot", "int", 0), ("n_snapshots", "int", 0), ("probability", "double", 1.0)],
    "contingencies": [("line_id", "int", None)],
    "gen_availability": [("gen_id", "int", None), ("t", "int", None), ("value", "double", None)],
    "load_profile": [("load_id", "int", None), ("t", "int", None), ("value", "double", None)],
    "storage_inflow": [("storage_id", "int", None), ("t", "int", None), ("value", "double", None)],
    "head_profile": [("storage_id", "int", None), ("t", "int", None), ("value", "double", None)],
}

KEYS = {"buses": "bus_id", "generators": "gen_id", "lines": "line_id", "links": "link_id", "loads": "load_id", "storage_units": "storage_id"}
SERIES = {"gen_availability": ("generators", "gen_id"), "load_profile": ("loads", "load_id"), "storage_inflow": ("storage_units", "storage_id"), "head_profile": ("storage_units", "storage_id")}


@dataclass(frozen=True)
class Globals:
    value_of_lost_load: float = 10_000.0
    base_mva: float = 100.0
    co2_price: float = 0.0
    reserve_margin: float | None = None
    co2_limit: float | None = None
    water_limit: float | None = None
    land_limit: float | None = None


def schema_of(table: str) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in COMPONENTS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: absent columns take their default, others go."""
    cols = []
    for n, t, default in COMPONENTS[table]:
        stand_in = F.array().cast(t) if default == [] else F.lit(default).cast(t)
        own = F.col(n).cast(t) if n in df.columns else None
        cols.append((stand_in if own is None else F.coalesce(own, stand_in) if default is not None else own).alias(n))
    return df.select(*cols)


@dataclass(frozen=True)
class Network:
    """All tables of a network; a table that is absent is empty. ``notes`` say what a reader had to leave out."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    settings: Globals = Globals()
    notes: tuple[str, ...] = ()

    def __getitem__(self, table: str) -> DataFrame:
        if table in self.tables:
            return self.tables[table]
        return self.spark.createDataFrame([], schema_of(table))

    def with_tables(self, **tables: DataFrame) -> Network:
        return replace(self, tables={**self.tables, **{k: conform(v, k) for k, v in tables.items()}})

    def set(self, **settings) -> Network:
        return replace(self, settings=replace(self.settings, **settings))

    @classmethod
    def of(cls, spark: SparkSession, settings: Globals | None = None, notes=(), **rows) -> Network:
        """A small network from lists of dicts; keys are numbered in order where they are absent."""
        tables = {}
        for table, items in rows.items():
            key = KEYS.get(table)
            full = []
            for k, item in enumerate(items):
                row = {n: d for n, _, d in COMPONENTS[table]} | ({key: k} if key else {}) | dict(item)
                full.append(tuple(row[n] for n, _, _ in COMPONENTS[table]))
            tables[table] = spark.createDataFrame(full, schema_of(table))
        return cls(spark, tables, settings or Globals(), tuple(notes))


#: What may be sent to every executor: bytes by the planner's estimate, else rows that were counted.
SMALL_BYTES, SMALL_ROWS = 32 << 20, 2_000_000


def if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its size allows it; otherwise as it is, so that a join shuffles both sides."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= SMALL_BYTES or df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return F.broadcast(df)
    return df


def is_transport(susceptance: str = "susceptance"):
    """A corridor without physics: its susceptance is not a positive finite number."""
    b = F.col(susceptance)
    return F.isnan(b) | (F.abs(b) == float("inf")) | (b <= 0)


def hourly(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("t"), F.lit(1.0).alias("weight"))
