"""A network from a map extract: buses, links, transformers and plants as CSV tables, national loads, and where people live.

The tables quote with ``'`` and hold their tags as ``"key"=>"value"`` pairs. Ratings and impedances are estimates from
voltage and length; a country's mean load is shared among its buses by the population near them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.functions import scalars
from feederflow.network import Globals, Network, hourly
from feederflow.operators import reductions
from feederflow.sources.draft import SourceError

#: The marginal cost of a carrier.
MERIT = {"wind": 0.5, "solar": 0.5, "hydro": 2.0, "nuclear": 12.0, "lignite": 28.0, "coal": 42.0, "waste": 45.0, "biomass": 55.0, "gas": 72.0, "oil": 130.0, "storage": 65.0, "other": 80.0}
#: Fixed value: what a column of a country's load is called after its code.
LOAD_TAIL = "_load_actual_entsoe_transparency"
#: Fixed value: years have so many hours.
YEARS = (8760, 8784)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote="'", escape="'")


def number(c: str, otherwise: float | None = None):
    v = F.col(c).try_cast("double")
    return v if otherwise is None else F.coalesce(v, F.lit(otherwise))


def national_demand(loads: DataFrame, more_than: int = 1000) -> DataFrame:
    """``(country, mw)``: the mean of a country's positive loads, of those with more than ``more_than``."""
    named = {c: c[: -len(LOAD_TAIL)] for c in loads.columns if c.endswith(LOAD_TAIL)}
    named = {c: k for c, k in named.items() if len(k) == 2 and k.isascii() and k.isalpha() and k.isupper()}
    if not named:
        raise SourceError("no column of a national load")
    long = loads.select(*[number(c).alias(k) for c, k in named.items()]).unpivot([], list(named.values()), "country", "value")
    return reductions.mean_positive(long, "country", more_than=more_than).select("country", F.col("mean").alias("mw"))


def build(spark: SparkSession, buses: DataFrame, links: DataFrame, transformers: DataFrame, plants: DataFrame, national: DataFrame, places: DataFrame) -> Network:
    """One snapshot. ``national(country, mw)``; ``places(place_id, x, y, population)``.

    Buses without a point are left out, and branches and plants that lack a bus; branches of a bus with itself, and
    plants without a capacity. Components are numbered in the order of the extract's own ids.
    """
    point, tags = scalars.wkt_point(F.col("geometry")), scalars.hstore(F.col("tags"))
    at = buses.select("bus_id", number("voltage", 0.0).alias("v_nom"), point.alias("p"), tags.alias("tags")).where("p.lon is not null and p.lat is not null")
    at = at.withColumn("name", F.coalesce(F.nullif(F.trim(F.col("tags")["name_eng"]), F.lit("")), F.concat(F.lit("node "), F.col("bus_id"))))
    same = Window.partitionBy("name").orderBy("key")
    at = at.withColumn("key", (F.row_number().over(Window.orderBy("bus_id")) - 1).cast("int")).withColumn("_n", F.row_number().over(same))
    at = at.withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit(" "), F.col("_n").cast("string"))).otherwise(F.col("name")))
    nodes = at.select(F.col("bus_id").alias("own"), F.col("key").alias("bus_id"), "name", F.coalesce(F.col("tags")["country"], F.lit("")).alias("country"), F.lit("entsoe").alias("synchronous_area"), "v_nom", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))

    def ends(df: DataFrame) -> DataFrame:
        a = nodes.select(F.col("own").alias("src_bus_id"), F.col("bus_id").alias("bus0"), F.col("name").alias("n0"), F.col("v_nom").alias("v0"))
        b = nodes.select(F.col("own").alias("dst_bus_id"), F.col("bus_id").alias("bus1"), F.col("name").alias("n1"), F.col("v_nom").alias("v1"))
        return df.join(a, "src_bus_id").join(b, "dst_bus_id").where("bus0 <> bus1")

    kv = F.greatest(number("voltage", 220.0), F.lit(1.0))
    circuits = F.when(number("circuits") >= 1, number("circuits")).otherwise(1.0)
    km = F.greatest(number("length_m", 50_000.0), F.lit(100.0)) / 1000
    wires = ends(links).select("bus0", "bus1", F.concat("n0", F.lit(" — "), "n1").alias("name"), (scalars.thermal_mw(kv) * circuits).alias("s_nom"), scalars.line_susceptance(kv, km, circuits).alias("susceptance"))
    low, high = F.greatest(F.least("v0", "v1"), F.lit(1.0)), F.greatest("v0", "v1", F.lit(1.0))
    label = F.format_string("%s %.0f/%.0f kV", F.col("n0"), low, high)
    coils = ends(transformers).select("bus0", "bus1", label.alias("name"), (scalars.thermal_mw(low) * 2).alias("s_nom"), F.lit(400.0).alias("susceptance"))
    rank = Window.orderBy("kind", "bus0", "bus1", "name", "s_nom", "susceptance")
    lines = wires.withColumn("kind", F.lit(0)).unionByName(coils.withColumn("kind", F.lit(1))).withColumn("line_id", F.row_number().over(rank) - 1)

    cost = F.element_at(F.create_map(*[F.lit(x) for kv_ in MERIT.items() for x in kv_]), F.col("carrier"))
    sites = plants.select(F.col("bus_id").alias("own"), number("capacity", -1.0).alias("p_nom"), scalars.fuel(F.coalesce("symbol", F.lit(""))).alias("carrier")).where("p_nom > 0")
    sites = sites.join(nodes.select("own", "bus_id", F.col("name").alias("_at")), "own").withColumn("gen_id", F.row_number().over(Window.orderBy("bus_id", "carrier", "p_nom")) - 1)
    sites = sites.select("gen_id", F.concat("_at", F.lit(" "), "carrier").alias("name"), "bus_id", "p_nom", "carrier", cost.alias("marginal_cost"))

    weights = reductions.population_weight(places, nodes).join(nodes.select("bus_id", "country"), "bus_id")
    shares = reductions.allocation(weights, national).join(nodes.select("bus_id", F.col("name").alias("_at")), "bus_id")
    loads = shares.select((F.row_number().over(Window.orderBy("bus_id")) - 1).alias("load_id"), F.concat("_at", F.lit(" demand")).alias("name"), "bus_id", F.col("mw").alias("p_set"))
    return Network(spark, {}, Globals()).with_tables(snapshots=hourly(spark, 1), buses=nodes, lines=lines, generators=sites, loads=loads)


def load_extract(spark: SparkSession, folder: str, loads: str, places: DataFrame) -> Network:
    tables = [read_table(spark, f"{folder}/{t}.csv") for t in ("buses", "links", "transformers", "generators")]
    return build(spark, *tables, national_demand(spark.read.csv(loads, header=True)), places)


def zone_year(table: DataFrame, columns: dict[str, dict[str, str]], year: int, stamp: str = "utc_timestamp") -> DataFrame:
    """``(zone, kind, hour, value)`` of one whole year: loads in MW, other kinds as a share of their own maximum.

    ``columns``: zone -> kind -> the table's column. A gap, a series that is zero all year, or hours that make no
    whole year are errors; nothing is filled in.
    """
    wanted = {f"{zone}|{kind}": c for zone, kinds in columns.items() for kind, c in kinds.items()}
    if missing := [c for c in wanted.values() if c not in table.columns]:
        raise SourceError(f"the table has no column {missing[0]}")
    own = table.where(F.col(stamp).startswith(f"{year}-"))
    hours = own.count()
    if hours not in YEARS:
        raise SourceError(f"{year} has {hours} hours, which is no whole year")
    long = own.select(F.col(stamp).alias("hour"), *[number(c).alias(k) for k, c in wanted.items()]).unpivot("hour", list(wanted), "_k", "value")
    gap = F.raise_error(F.concat(F.lit("a gap at "), "hour", F.lit(" in "), "_k")).cast("double")
    long = long.withColumn("value", F.coalesce("value", gap)).select(F.split("_k", r"\|")[0].alias("zone"), F.split("_k", r"\|")[1].alias("kind"), "hour", "value")
    most = F.max("value").over(Window.partitionBy("zone", "kind"))
    empty = F.raise_error(F.concat("zone", F.lit(" "), "kind", F.lit(" is zero all year"))).cast("double")
    return long.withColumn("_m", most).select("zone", "kind", "hour", F.when(F.col("kind") == "load", F.col("value")).when(F.col("_m") > 0, F.col("value") / F.col("_m")).otherwise(empty).alias("value"))


@dataclass(frozen=True)
class Shape:
    record: int
    parts: list[np.ndarray]


def shapes_of(content: bytes) -> list[Shape]:
    """The rings or points of a shapefile by record; other kinds of shape have no parts."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise SourceError("no shapefile")
    out, at = [], 100
    while at + 12 <= len(content):
        record, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        parts: list[np.ndarray] = []
        if kind in (1, 11, 21):
            parts = [np.frombuffer(body[4:20], "<f8").reshape(1, 2)]
        elif kind in (3, 5, 13, 15, 23, 25):
            n, total = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), total]
            points = np.frombuffer(body[44 + 4 * n : 44 + 4 * n + 16 * total], "<f8").reshape(-1, 2)
            parts = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        out.append(Shape(record, parts))
        at += 8 + 2 * words
    return out


def rows_of(content: bytes, columns: list[str]) -> list[tuple[bool, dict[str, str]]]:
    """``(deleted, values)`` of a dBASE table's records, trimmed."""
    count, head, size = struct.unpack("<IHH", content[4:12])
    fields, at, place = {}, 32, 1
    while content[at] != 0x0D:
        name, width = content[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), content[at + 16]
        fields[name] = (place, width)
        place += width
        at += 32
    if missing := [c for c in columns if c not in fields]:
        raise SourceError(f"the table has no column {missing[0]}")
    out = []
    for k in range(count):
        row = content[head + k * size : head + (k + 1) * size]
        out.append((row[:1] == b"*", {c: row[fields[c][0] : sum(fields[c])].decode("utf-8", "replace").strip(" \0") for c in columns}))
    return out


def places_of(spark: SparkSession, shp: bytes, dbf: bytes, population: str = "POP_MAX") -> DataFrame:
    """``(place_id, x, y, population)``: the points of a shapefile joined by position with the rows of its table."""
    shapes, rows = shapes_of(shp), rows_of(dbf, [population])
    if len(shapes) != len(rows):
        raise SourceError(f"{len(shapes)} shapes against {len(rows)} rows")
    out = []
    for k, (shape, (deleted, values)) in enumerate(zip(shapes, rows, strict=True)):
        if not deleted and shape.parts and len(shape.parts[0]):
            try:
                people = float(values[population])
            except ValueError:
                people = 0.0
            x, y = shape.parts[0][0]
            out.append((k, float(x), float(y), people))
    return spark.createDataFrame(out, "place_id int, x double, y double, population double")
