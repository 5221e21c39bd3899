"""Incidence, areas, cuts and outage factors of a network."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.network import SERIES, Network, conform, is_transport


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again, which cuts its lineage.

    Where none is set, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="feederflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/feederflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`shared_table` that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def components_by_bus(net: Network) -> DataFrame:
    """``(bus_id, kind, component_id)``: the generators, loads and storage units at each bus."""
    parts = [net[t].select("bus_id", F.lit(kind).alias("kind"), F.col(key).alias("component_id")) for t, kind, key in (("generators", "generator", "gen_id"), ("loads", "load", "load_id"), ("storage_units", "storage", "storage_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lines_by_bus(lines: DataFrame) -> DataFrame:
    """``(bus_id, line_id, sign)``: a line leaves its first bus (-1) and enters its second (+1)."""
    ends = F.array(F.struct(F.col("bus0").alias("bus_id"), F.lit(-1.0).alias("sign")), F.struct(F.col("bus1").alias("bus_id"), F.lit(1.0).alias("sign")))
    return lines.select("line_id", F.inline(ends)).select("bus_id", "line_id", "sign")


def links_by_bus(links: DataFrame) -> DataFrame:
    """``(bus_id, link_id, coefficient)``: -1 where a link draws, its efficiency where it delivers."""
    ends = F.array(F.struct(F.col("bus0").alias("bus_id"), F.lit(-1.0).alias("coefficient")), F.struct(F.col("bus1").alias("bus_id"), F.col("efficiency").alias("coefficient")))
    return links.select("link_id", F.inline(ends)).select("bus_id", "link_id", "coefficient")


def period_of_snapshot(snapshots: DataFrame, periods: DataFrame) -> DataFrame:
    """``(t, period)``: where periods overlap the later one holds; snapshots outside all belong to period 0."""
    inside = (F.col("t") >= F.col("first_snapshot")) & (F.col("t") < F.col("first_snapshot") + F.col("n_snapshots"))
    return snapshots.select("t").join(periods, inside, "left").groupBy("t").agg(F.coalesce(F.max("period"), F.lit(0)).alias("period"))


def scenario_weight(snapshots: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``(t, probability)``: that of the last scenario that holds the snapshot, 1 outside all."""
    inside = (F.col("t") >= F.col("first_snapshot")) & (F.col("t") < F.col("first_snapshot") + F.col("n_snapshots"))
    return snapshots.select("t").join(scenarios, inside, "left").groupBy("t").agg(F.coalesce(F.max_by("probability", "scenario"), F.lit(1.0)).alias("probability"))


def cost_factor(net: Network) -> DataFrame:
    """``(t, factor)``: weight x discount of the period x probability of the scenario."""
    if "periods" not in net.tables and "scenarios" not in net.tables:
        return net["snapshots"].select("t", F.col("weight").alias("factor"))
    df = net["snapshots"].join(period_of_snapshot(net["snapshots"], net["periods"]), "t").join(scenario_weight(net["snapshots"], net["scenarios"]), "t")
    df = df.join(net["periods"].select("period", "discount"), "period", "left")
    return df.select("t", (F.col("weight") * F.coalesce("discount", F.lit(1.0)) * F.col("probability")).alias("factor"))


def with_hvdc_ties(net: Network, ties: DataFrame) -> Network:
    """``net`` with two one-way links for each of ``ties(name, bus_a, bus_b, p_nom, efficiency)``, numbered on from its links."""
    both = F.array(F.struct(F.lit("_fwd").alias("way"), F.col("bus_a").alias("bus0"), F.col("bus_b").alias("bus1")), F.struct(F.lit("_rev").alias("way"), F.col("bus_b").alias("bus0"), F.col("bus_a").alias("bus1")))
    ways = ties.select("name", "p_nom", "efficiency", F.inline(both))
    last = net["links"].agg(F.coalesce(F.max("link_id"), F.lit(-1)).alias("last"))
    number = F.row_number().over(Window.orderBy("name", "way"))
    new = ways.withColumn("_n", number).join(last).select((F.col("last") + F.col("_n")).cast("int").alias("link_id"), F.concat("name", "way").alias("name"), "bus0", "bus1", "p_nom", "efficiency")
    return net.with_tables(links=net["links"].unionByName(conform(new, "links")))


def contingencies_all_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_transport()).select("line_id")


def synchronous_areas(buses: DataFrame, lines: DataFrame, rounds: int = 64) -> DataFrame:
    """``(bus_id, area)``: the buses that lines with physics connect share ``sync{smallest bus}``.

    Labels spread to neighbours and then to the label's own label, so a component of diameter d settles in
    about log d rounds; the loop ends when nothing changes, and labels that still change after ``rounds`` are an error.
    """
    wires = lines.where(~is_transport()).select(F.col("bus0").alias("u"), F.col("bus1").alias("v"))
    wires = shared_table(wires.unionAll(wires.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "wires")
    label, before = buses.select(F.col("bus_id").alias("u"), F.col("bus_id").alias("l")), None
    for _ in range(rounds):
        near = wires.join(label.select(F.col("u").alias("v"), F.col("l").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        lower = label.join(near, "u", "left").select("u", "l", F.least("l", "other").alias("to"))
        hop = lower.select(F.col("u").alias("to"), F.col("to").alias("next"))
        new = shared_table(lower.join(hop, "to").select("u", F.col("l").alias("was"), F.least("to", "next").alias("l")), "areas")
        if before is not None:
            drop_table(before)
        label, before = new.select("u", "l"), new
        if new.where("was <> l").isEmpty():
            break
    else:
        raise RuntimeError(f"areas did not settle in {rounds} rounds")
    drop_table(wires)
    return label.select(F.col("u").alias("bus_id"), F.concat(F.lit("sync"), F.col("l").cast("string")).alias("area"))


def submodel(net: Network, keep: DataFrame) -> tuple[Network, DataFrame]:
    """The network of the buses in ``keep(bus_id)``, and the severed lines and links ``(kind, id)``.

    Lines and links stay if both ends do; one kept end makes them severed. Series follow their components;
    limits on the whole system go.
    """
    keep = keep.select("bus_id").distinct()
    tables = dict(net.tables)
    for t in ("buses", "generators", "loads", "storage_units"):
        tables[t] = net[t].join(keep, "bus_id", "left_semi").select(*net[t].columns)
    cuts = []
    for t, key in (("lines", "line_id"), ("links", "link_id")):
        ends = net[t].join(keep.select(F.col("bus_id").alias("bus0"), F.lit(1).alias("_a")), "bus0", "left").join(keep.select(F.col("bus_id").alias("bus1"), F.lit(1).alias("_b")), "bus1", "left")
        tables[t] = ends.where("_a = 1 and _b = 1").select(*net[t].columns)
        cuts.append(ends.where("(_a is null) <> (_b is null)").select(F.lit(t).alias("kind"), F.col(key).alias("id")))
    for series, (table, key) in SERIES.items():
        if series in tables:
            tables[series] = net[series].join(tables[table].select(key), key, "left_semi").select(*net[series].columns)
    if "contingencies" in tables:
        tables["contingencies"] = net["contingencies"].join(tables["lines"].select("line_id"), "line_id", "left_semi")
    part = Network(net.spark, tables, net.settings, net.notes)
    return part.set(co2_limit=None, water_limit=None, land_limit=None, reserve_margin=None), cuts[0].unionByName(cuts[1])


def scatter_back(full: DataFrame, values: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Results of a cut on all components: those outside have 0."""
    return full.select(key).join(values.select(key, value), key, "left").select(key, F.coalesce(value, F.lit(0.0)).alias(value))


def outage_factors(lines: DataFrame, areas: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """``(monitored, outaged, factor, islanding)`` for the lines with physics and the ``outages(line_id)`` in the same
    area, by default those of all lines.

    The factor is the share of the outaged line's flow that moves to the monitored one. An outage that splits
    its area is ``islanding`` and has factor 0. Each area is solved in one task, for its listed outages alone.
    """
    wires = lines.where(~is_transport()).join(areas.withColumnRenamed("bus_id", "bus0"), "bus0").select("area", "line_id", "bus0", "bus1", "susceptance")
    if outages is None:
        wires = wires.withColumn("listed", F.lit(True))
    else:
        named = outages.select("line_id").distinct().withColumn("_l", F.lit(True))
        wires = wires.join(named, "line_id", "left").withColumn("listed", F.coalesce("_l", F.lit(False))).drop("_l")
        wires = wires.join(wires.where("listed").select("area").distinct(), "area", "left_semi")

    def factors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id", ignore_index=True)
        names = np.unique(pdf[["bus0", "bus1"]].to_numpy())
        at, to = (np.searchsorted(names, pdf[c].to_numpy()) for c in ("bus0", "bus1"))
        b, n, m = pdf["susceptance"].to_numpy(float), len(names), len(pdf)
        out = np.flatnonzero(pdf["listed"].to_numpy(bool))
        injected = np.zeros((n, len(out)))
        injected[at[out], np.arange(len(out))] += 1
        injected[to[out], np.arange(len(out))] -= 1
        nodal = np.zeros((n, n))
        for i, j, v in ((at, at, b), (to, to, b), (at, to, -b), (to, at, -b)):
            np.add.at(nodal, (i, j), v)
        angle = np.zeros_like(injected)
        try:  # the first bus is the reference
            angle[1:] = np.linalg.solve(nodal[1:, 1:], injected[1:])
        except np.linalg.LinAlgError:
            angle = None
        if angle is None:
            share, split = np.zeros((m, len(out))), np.ones(len(out), bool)
        else:
            moved = b[:, None] * (angle[at] - angle[to])
            left = 1 - moved[out, np.arange(len(out))]
            split = np.abs(left) < 1e-6
            share = np.where(split[None, :], 0.0, moved / np.where(split, 1.0, left)[None, :])
        i, j = np.nonzero(np.arange(m)[:, None] != out[None, :])
        ids = pdf["line_id"].to_numpy()
        return pd.DataFrame({"monitored": ids[i], "outaged": ids[out[j]], "factor": share[i, j], "islanding": split[j]})

    return wires.groupBy("area").applyInPandas(factors, "monitored int, outaged int, factor double, islanding boolean")


def triangles(lines: DataFrame) -> DataFrame:
    """``(a, b, c)``: buses a < b < c that lines with physics join in a triangle."""
    e = lines.where(~is_transport() & (F.col("bus0") != F.col("bus1"))).select(F.least("bus0", "bus1").alias("a"), F.greatest("bus0", "bus1").alias("b")).distinct()
    ac = e.select(F.col("a"), F.col("b").alias("c"))
    bc = e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return e.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def fundamental_cycles(lines: DataFrame, areas: DataFrame, longest: int = 8) -> DataFrame:
    """``(area, line_id, buses)``: for each line outside a breadth-first tree of its area, the cycle of 3 to ``longest`` buses that it closes."""
    wires = lines.where(~is_transport()).join(areas.withColumnRenamed("bus_id", "bus0"), "bus0").select("area", "line_id", "bus0", "bus1")

    def cycles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        near: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in pdf[["line_id", "bus0", "bus1"]].itertuples(index=False):
            near.setdefault(a, []).append((b, k))
            near.setdefault(b, []).append((a, k))
        up: dict[int, tuple[int, int]] = {}
        depth: dict[int, int] = {}
        used = set()
        for start in sorted(near):
            if start in depth:
                continue
            depth[start], queue = 0, [start]
            for u in queue:
                for v, k in near[u]:
                    if v not in depth:
                        depth[v], up[v] = depth[u] + 1, (u, k)
                        used.add(k)
                        queue.append(v)
        out = []
        for k, a, b in pdf[["line_id", "bus0", "bus1"]].itertuples(index=False):
            if k in used:
                continue
            left, right = [a], [b]
            while left[-1] != right[-1]:
                side = left if depth[left[-1]] >= depth[right[-1]] else right
                side.append(up[side[-1]][0])
            loop = left + right[-2::-1]
            if 3 <= len(loop) <= longest:
                out.append((pdf["area"].iloc[0], k, [int(x) for x in loop]))
        return pd.DataFrame(out, columns=["area", "line_id", "buses"])

    return wires.groupBy("area").applyInPandas(cycles, "area string, line_id int, buses array<int>")


def nearest_buses(places: DataFrame, buses: DataFrame, within: float = 3.0, k: int = 5) -> DataFrame:
    """``(place_id, bus_id, distance)``: each place's ``k`` nearest buses within ``within`` degrees, by an equal join on grid cells."""
    cell = lambda c: F.floor(F.col(c) / within).cast("int")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = places.select("place_id", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"), F.explode(around).alias("o"))
    p = p.select("place_id", "px", "py", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    b = buses.where("x is not null and y is not null").select("bus_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    far = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))
    near = p.join(b, ["cx", "cy"]).withColumn("distance", far).where(F.col("distance") <= within)
    order = Window.partitionBy("place_id").orderBy("distance", "bus_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("place_id", "bus_id", "distance")


def first_appearance(df: DataFrame, value: str, order: str) -> DataFrame:
    """The distinct values of a column with the place of their first appearance."""
    return df.groupBy(value).agg(F.min(order).alias("first"))
