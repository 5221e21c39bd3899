"""CIM/CGMES models: EQ, TP, SSH and SV documents as one table of properties, and networks from joins on their ids."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.functions.scalars import xml_escape
from feederflow.network import Globals, Network
from feederflow.operators.topology import shared_table, synchronous_areas
from feederflow.sources.draft import UNRATED, SourceError

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
PROPERTIES = "class string, id string, property string, value string, ref string"
#: What the reader looks up, numbers, texts and references.
NUMBERS = (
    "r", "x", "bch", "nominalVoltage", "sequenceNumber", "ratedU", "ratedS", "endNumber", "maxOperatingP", "minOperatingP", "minQ", "maxQ", "p", "q", "v", "angle", "value",
    "position", "continuousPosition", "sections", "continuousSections",
)
TEXTS = ("name", "inService")
REFERENCES = (
    "BaseVoltage", "EquipmentContainer", "ConnectivityNodeContainer", "Substation", "Region", "SubGeographicalRegion", "TopologicalNode", "ConnectivityNode", "ConductingEquipment", "PowerTransformer", "Terminal",
    "GeneratingUnit", "OperationalLimitSet", "TapChanger", "TransformerEnd", "ShuntCompensator",
)
#: The carrier that a generating unit's class tells.
CARRIERS = {"ThermalGeneratingUnit": "thermal", "HydroGeneratingUnit": "hydro", "WindGeneratingUnit": "wind", "NuclearGeneratingUnit": "nuclear", "SolarGeneratingUnit": "solar"}
LOADS = ("EnergyConsumer", "ConformLoad", "NonConformLoad")
#: The base on which ohms become per unit.
BASE_MVA = 100.0


def _local(name: str) -> str:
    """A name without its namespace and class."""
    return name.rpartition("}")[2].rpartition(".")[2]


def _key(reference: str) -> str:
    return reference.rpartition("#")[2]


def properties_of(content: bytes) -> list[tuple]:
    """``(class, id, property, value, ref)`` of one document; an object without properties has one row of its own."""
    out = []
    for _, e in ET.iterparse(io.BytesIO(content)):
        key = e.get(f"{_RDF}ID") or e.get(f"{_RDF}about")
        if key is None:
            continue
        kind = _local(e.tag)
        out.append((kind, _key(key), None, None, None))
        for p in e:
            ref = p.get(f"{_RDF}resource")
            out.append((kind, _key(key), _local(p.tag), (p.text or "").strip() or None, _key(ref) if ref else None))
        e.clear()
    return out


def documents_in(path: str, content: bytes, depth: int = 0) -> list[tuple[str, bytes]]:
    """The XML documents of a file: itself, or those in an archive, to archives within two archives."""
    if not content.startswith(b"PK\x03\x04"):
        return [(path, content)]
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if name.lower().endswith(".xml") or (name.lower().endswith(".zip") and depth < 2):
                out += documents_in(f"{path}!{name}", z.read(name), depth + 1)
    return out


def properties(files: DataFrame) -> DataFrame:
    """The properties of all documents of ``files(path, content)``, read where the files are."""

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for label, document in documents_in(path, bytes(content)):
                    try:
                        rows = properties_of(document)
                    except ET.ParseError as e:
                        raise SourceError(f"{label}: {e}") from None
                    yield pd.DataFrame(rows, columns=["class", "id", "property", "value", "ref"])

    return files.select("path", "content").mapInPandas(read, PROPERTIES)


def objects(found: DataFrame) -> DataFrame:
    """A row for each object, put together from all documents: ``id``, ``class`` and the properties that the reader knows."""
    p = F.col("property")
    pick = lambda name, column: F.max(F.when(p == name, F.col(column)))
    cols = [pick(n, "value").try_cast("double").alias(n) for n in NUMBERS] + [pick(n, "value").alias(n) for n in TEXTS] + [pick(n, "ref").alias(f"to_{n}") for n in REFERENCES]
    return found.groupBy("id").agg(F.max("class").alias("class"), *cols)


@dataclass
class Model:
    """The objects, and the joins that all readers share."""

    objects: DataFrame

    def of(self, *classes: str) -> DataFrame:
        return self.objects.where(F.col("class").isin(*classes))

    def voltages(self) -> DataFrame:
        """``(id, kv)``: an object's base voltage, its own or else its container's."""
        o = self.objects.select("id", "to_BaseVoltage", "to_EquipmentContainer")
        level = self.objects.select(F.col("id").alias("to_EquipmentContainer"), F.col("to_BaseVoltage").alias("_level"))
        kv = self.objects.where("nominalVoltage is not null").select(F.col("id").alias("_bv"), F.col("nominalVoltage").alias("kv"))
        named = o.join(level, "to_EquipmentContainer", "left").select("id", F.coalesce("to_BaseVoltage", "_level").alias("_bv")).where("_bv is not null")
        return named.join(kv, "_bv").select("id", "kv")

    def terminals(self) -> DataFrame:
        """``(terminal, equipment, node, place)`` in the order of sequence numbers, terminals without one last."""
        t = self.of("Terminal").where("to_ConductingEquipment is not null").select(F.col("id").alias("terminal"), F.col("to_ConductingEquipment").alias("equipment"), F.coalesce("to_TopologicalNode", "to_ConnectivityNode").alias("node"), F.coalesce("sequenceNumber", F.lit(float("inf"))).alias("seq"))
        order = Window.partitionBy("equipment").orderBy("seq", "terminal")
        return t.where("node is not null").withColumn("place", F.row_number().over(order)).drop("seq")


def _numbered(df: DataFrame, key: str, number: str) -> DataFrame:
    return df.withColumn(number, (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def _named(fallback: str, key: str = "id") -> Column:
    return F.coalesce("name", F.concat(F.lit(fallback), F.col(key)))


@dataclass
class Case:
    """A network and the ids of its components; ``model`` for what else the documents say."""

    network: Network
    model: Model
    nodes: DataFrame  # node, bus_id, v_nom
    ids: dict[str, DataFrame]  # table -> (id, number)


def case(spark: SparkSession, files: DataFrame) -> Case:
    """One snapshot of a CGMES model. Nodes are topological ones if there are any, else connectivity nodes.

    Ohms become per unit on 100 MVA; a branch's rating is the tightest of its limits, amperes by ``sqrt(3) kV A / 1000``.
    Equipment that the steady state switches off, or that reaches too few nodes, is left out.
    """
    m = Model(shared_table(objects(properties(files)), "cim"))
    kind = "TopologicalNode" if not m.of("TopologicalNode").isEmpty() else "ConnectivityNode"
    kv = m.voltages()
    o = m.objects
    # A node's country is the name of the region or substation that its container belongs to.
    home = o.select(F.col("id").alias("_home"), F.coalesce("to_Substation", "to_Region", "to_SubGeographicalRegion").alias("_region"))
    region = o.select(F.col("id").alias("_region"), F.col("name").alias("country"))
    nodes = m.of(kind).withColumn("_home", F.coalesce("to_ConnectivityNodeContainer", "to_EquipmentContainer")).join(home, "_home", "left").join(region, "_region", "left").join(kv, "id", "left")
    nodes = _numbered(nodes.select(F.col("id").alias("node"), _named("node").alias("name"), F.coalesce("country", F.lit("??")).alias("country"), F.coalesce("kv", F.lit(0.0)).alias("v_nom")), "node", "bus_id")
    nodes = shared_table(nodes, "cim-nodes")
    if nodes.isEmpty():
        raise SourceError("no TopologicalNode and no ConnectivityNode")
    place = nodes.select("node", "bus_id", "v_nom")
    ends = m.terminals().join(place, "node").select("terminal", "equipment", "place", "bus_id", "v_nom")
    on = F.lower(F.coalesce("inService", F.lit("true"))) != "false"

    # The first two different nodes of an equipment.
    first = ends.groupBy("equipment").agg(F.min_by(F.struct("bus_id", "v_nom"), "place").alias("a"))
    second = ends.join(first, "equipment").where("bus_id <> a.bus_id").groupBy("equipment").agg(F.min_by(F.struct("bus_id", "v_nom"), "place").alias("b"))
    pair = first.join(second, "equipment", "left").withColumnRenamed("equipment", "id")

    # The tightest limit of an equipment, through its terminals.
    limits = m.of("CurrentLimit", "ActivePowerLimit").where("value is not null").select(F.col("to_OperationalLimitSet").alias("_set"), "class", "value")
    sets = o.select(F.col("id").alias("_set"), F.col("to_Terminal").alias("_terminal"))
    at = o.select(F.col("id").alias("_terminal"), F.col("to_ConductingEquipment").alias("id"))
    mw = F.when(F.col("class") == "ActivePowerLimit", F.col("value")).when(F.col("kv") > 0, F.sqrt(F.lit(3.0)) * F.col("kv") * F.col("value") / 1000)
    rating = limits.join(sets, "_set").join(at, "_terminal").join(kv, "id", "left").withColumn("mw", mw).groupBy("id").agg(F.min("mw").alias("limit"))

    branch = ("id", "name", "bus0", "bus1", "s_nom", "resistance", "reactance", "tap_ratio")
    ac = m.of("ACLineSegment").where(on).join(pair, "id").where("b is not null").join(kv, "id", "left").join(rating, "id", "left")
    z = F.coalesce(F.when(F.coalesce("kv", F.when(F.col("a.v_nom") > 0, F.col("a.v_nom"))) > 0, F.pow(F.coalesce("kv", "a.v_nom"), 2) / BASE_MVA), F.lit(1.0))
    ac = ac.select("id", _named("line").alias("name"), F.col("a.bus_id").alias("bus0"), F.col("b.bus_id").alias("bus1"), F.coalesce("limit", F.lit(UNRATED)).alias("s_nom"), (F.coalesce("r", F.lit(0.0)) / z).alias("resistance"), (F.coalesce("x", F.lit(0.0)) / z).alias("reactance"), F.lit(1.0).alias("tap_ratio"))

    windings = m.of("PowerTransformerEnd").where("to_PowerTransformer is not null").select(F.col("to_PowerTransformer").alias("id"), F.coalesce("endNumber", F.lit(float("inf"))).alias("n"), F.coalesce("ratedU", F.lit(0.0)).alias("u"), "ratedS", "r", "x", F.col("to_Terminal").alias("terminal"))
    windings = windings.join(ends.select("terminal", F.struct("bus_id", "v_nom").alias("end")), "terminal", "left")
    ohm = lambda c: F.sum(F.when(F.col("u") > 0, F.coalesce(c, F.lit(0.0)) / (F.col("u") * F.col("u") / BASE_MVA)).otherwise(0.0))
    sides = windings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "u", "end"))).alias("w"), ohm("r").alias("resistance"), ohm("x").alias("reactance"), F.max("ratedS").alias("rated")).where(F.size("w") >= 2)
    tr = m.of("PowerTransformer").select("id", "name").join(pair, "id").where("b is not null").join(sides, "id").join(rating, "id", "left")
    own = F.col("w")[0]["end"].isNotNull() & F.col("w")[1]["end"].isNotNull() & (F.col("w")[0]["end"]["bus_id"] != F.col("w")[1]["end"]["bus_id"])
    tr = tr.withColumn("a", F.when(own, F.col("w")[0]["end"]).otherwise(F.col("a"))).withColumn("b", F.when(own, F.col("w")[1]["end"]).otherwise(F.col("b")))
    u1, u2, v1, v2 = F.col("w")[0]["u"], F.col("w")[1]["u"], F.col("a.v_nom"), F.col("b.v_nom")
    tap = F.when((u1 > 0) & (u2 > 0) & (v1 > 0) & (v2 > 0), (u1 / v1) / (u2 / v2)).otherwise(1.0)
    tr = tr.select("id", _named("transformer").alias("name"), F.col("a.bus_id").alias("bus0"), F.col("b.bus_id").alias("bus1"), F.coalesce("limit", F.when(F.col("rated") > 0, F.col("rated")), F.lit(UNRATED)).alias("s_nom"), "resistance", "reactance", tap.alias("tap_ratio"))
    lines = _numbered(ac.select(*branch).unionByName(tr.select(*branch)).withColumn("susceptance", F.when(F.abs("reactance") > 1e-12, 1 / F.col("reactance")).otherwise(0.0)), "id", "line_id")

    unit = o.select(F.col("id").alias("to_GeneratingUnit"), F.col("class").alias("_kind"), F.col("maxOperatingP").alias("_most"), F.col("minOperatingP").alias("_least"))
    top = F.coalesce("_most", "ratedS", F.lit(0.0))
    carrier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv_ in CARRIERS.items() for x in kv_]), F.col("_kind")), F.lit("unknown"))
    least = F.when(top > 0, F.least(F.greatest(F.coalesce("_least", F.lit(0.0)) / top, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    gens = m.of("SynchronousMachine").where(on).join(unit, "to_GeneratingUnit", "left").join(pair.select("id", F.col("a.bus_id").alias("bus_id")), "id")
    gens = _numbered(gens.select("id", _named("gen").alias("name"), "bus_id", top.alias("p_nom"), carrier.alias("carrier"), least.alias("p_min_pu"), F.coalesce("minQ", F.lit(float("-inf"))).alias("q_min"), F.coalesce("maxQ", F.lit(float("inf"))).alias("q_max")), "id", "gen_id")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    loads = m.of(*LOADS).where(on).where((F.abs(p) >= 1e-12) | (F.abs(q) >= 1e-12)).join(pair.select("id", F.col("a.bus_id").alias("bus_id")), "id")
    loads = _numbered(loads.select("id", _named("load").alias("name"), "bus_id", p.alias("p_set"), q.alias("q_set")), "id", "load_id")

    lines, gens, loads = (shared_table(df, "cim-parts") for df in (lines, gens, loads))
    off = m.of("ACLineSegment", "SynchronousMachine", *LOADS).where(~on).count()
    notes = [f"CIM/CGMES: {kind} nodes; no generation costs"] + [f"{off} pieces of equipment are switched off and left out"] * (off > 0)
    net = Network(spark, {}, Globals(base_mva=BASE_MVA), tuple(notes)).with_tables(snapshots=spark.createDataFrame([(0, 1.0)], "t int, weight double"), buses=nodes, lines=lines, generators=gens, loads=loads)
    areas = synchronous_areas(net["buses"], net["lines"]).withColumnRenamed("area", "synchronous_area")
    net = net.with_tables(buses=net["buses"].drop("synchronous_area").join(areas, "bus_id"))
    ids = {"lines": lines.select("id", "line_id", "bus0", "bus1"), "generators": gens.select("id", "gen_id"), "loads": loads.select("id", "load_id")}
    return Case(net, m, place, ids)


def read(spark: SparkSession, path: str) -> Network:
    """A CGMES model from a folder of XML documents, one document, or an archive of them."""
    return case(spark, spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(xml|zip)$"))).network


def bus_voltages(c: Case) -> DataFrame:
    """``(bus_id, v_kv, v_pu, angle)`` of a solved state; angles in radians, no per-unit value without a nominal one."""
    v = c.model.of("SvVoltage").where("v is not null").select(F.col("to_TopologicalNode").alias("node"), "v", "angle").join(c.nodes, "node")
    return v.select("bus_id", F.col("v").alias("v_kv"), F.when(F.col("v_nom") > 0, F.col("v") / F.col("v_nom")).alias("v_pu"), F.radians(F.coalesce("angle", F.lit(0.0))).alias("angle"))


def power_flows(c: Case) -> DataFrame:
    """``(kind, id, end, p, q)`` of a solved state: lines at end 0 or 1, generators and loads at end 0, by number."""
    f = c.model.of("SvPowerFlow").select(F.col("to_Terminal").alias("terminal"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    f = f.join(c.model.terminals().join(c.nodes, "node").select("terminal", F.col("equipment").alias("id"), "bus_id"), "terminal").drop("terminal")
    lines = f.join(c.ids["lines"], "id").withColumn("end", F.when(F.col("bus_id") == F.col("bus0"), 0).when(F.col("bus_id") == F.col("bus1"), 1)).where("end is not null")
    parts = [lines.select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), "end", "p", "q")]
    for table, kind, key in (("generators", "generator", "gen_id"), ("loads", "load", "load_id")):
        parts.append(f.join(c.ids[table], "id").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(0).alias("end"), "p", "q"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def controls(c: Case) -> DataFrame:
    """``(kind, name, at, setting)`` of a solved state: tap positions at their line, shunt sections at their bus, null where unknown."""
    o = c.model.objects
    taps = c.model.of("SvTapStep").select(F.col("to_TapChanger").alias("key"), F.coalesce("position", "continuousPosition").alias("setting")).where("setting is not null")
    changer = o.select(F.col("id").alias("key"), "name", F.col("to_TransformerEnd").alias("_end")).join(o.select(F.col("id").alias("_end"), F.col("to_PowerTransformer").alias("id")), "_end", "left").join(c.ids["lines"].select("id", F.col("line_id").alias("at")), "id", "left")
    taps = taps.join(changer.select("key", "name", "at"), "key", "left").select(F.lit("tap").alias("kind"), _named("tap", "key").alias("name"), "at", "setting")
    shunts = c.model.of("SvShuntCompensatorSections").select(F.col("to_ShuntCompensator").alias("key"), F.coalesce("sections", "continuousSections").alias("setting")).where("setting is not null")
    where = c.model.terminals().where("place = 1").join(c.nodes, "node").select(F.col("equipment").alias("key"), F.col("bus_id").alias("at"))
    shunts = shunts.join(o.select(F.col("id").alias("key"), "name"), "key", "left").join(where, "key", "left").select(F.lit("shunt").alias("kind"), _named("shunt", "key").alias("name"), "at", "setting")
    return taps.unionByName(shunts)


def covered(c: Case) -> DataFrame:
    """``(buses, lines)``: how many the solved state covers."""
    return bus_voltages(c).agg(F.countDistinct("bus_id").alias("buses")).join(power_flows(c).where("kind = 'line'").agg(F.countDistinct("id").alias("lines")))


# Writing

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="http://iec.ch/TC57/2013/CIM-schema-cim16#">\n'


def _uuid(kind: str, key: Column) -> Column:
    """An id that follows from what it names."""
    h = F.md5(F.concat(F.lit(f"{kind}/"), key.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("_"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])


def _element(kind: str, key: Column, parts: dict[str, Column], about: bool = False) -> Column:
    """One object in XML; a part whose name starts with ``@`` is a reference, a null part is left out."""
    inside = []
    for name, value in parts.items():
        if name.startswith("@"):
            inside.append(F.concat(F.lit(f'<cim:{name[1:]} rdf:resource="#'), value, F.lit('"/>')))
        else:
            inside.append(F.concat(F.lit(f"<cim:{name}>"), xml_escape(value.cast("string")), F.lit(f"</cim:{name}>")))
    how = F.concat(F.lit('rdf:about="#'), key) if about else F.concat(F.lit('rdf:ID="'), key)
    return F.concat(F.lit(f"<cim:{kind} "), how, F.lit('">'), F.concat_ws("", *inside), F.lit(f"</cim:{kind}>"))


def documents(net: Network, voltages: DataFrame | None = None) -> DataFrame:
    """``(profile, rank, xml)``: the objects of the EQ, TP and SSH documents, and of SV for ``voltages(bus_id, v_kv, angle)`` (degrees).

    A branch with a ratio other than 1 becomes a transformer. Without a bus voltage, impedances stay in per unit, as
    the reader takes them. Costs, storage and links have no place in these profiles.
    """
    base = net.settings.base_mva
    name = "IdentifiedObject.name"
    b, parts = net["buses"], []
    node, bv = _uuid("node", F.col("bus_id")), _uuid("voltage", F.col("v_nom"))

    def add(profile: str, rank: int, df: DataFrame, xml: Column) -> None:
        parts.append(df.select(F.lit(profile).alias("profile"), F.lit(rank).alias("rank"), xml.alias("xml")))

    add("EQ", 0, b.where("v_nom > 0").select("v_nom").distinct(), _element("BaseVoltage", bv, {name: F.concat(F.col("v_nom").cast("string"), F.lit(" kV")), "BaseVoltage.nominalVoltage": F.col("v_nom")}))
    add("TP", 1, b, _element("TopologicalNode", node, {name: F.col("name"), "@TopologicalNode.BaseVoltage": F.when(F.col("v_nom") > 0, bv)}))

    def terminal(df: DataFrame, kind: str, key: str, bus: str, n: int) -> None:
        """The n-th terminal of an equipment: in EQ what it belongs to, in TP where it ends."""
        t, equipment = _uuid(f"{kind}-terminal{n}", F.col(key)), _uuid(kind, F.col(key))
        add("EQ", 3, df, _element("Terminal", t, {"ACDCTerminal.sequenceNumber": F.lit(n), "@Terminal.ConductingEquipment": equipment}))
        add("TP", 2, df, _element("Terminal", t, {"@Terminal.TopologicalNode": _uuid("node", F.col(bus))}, about=True))

    kv = b.select("bus_id", "v_nom")
    lines = net["lines"].join(kv.toDF("bus0", "v0"), "bus0").join(kv.toDF("bus1", "v1"), "bus1")
    x = F.when(F.col("reactance") != 0, F.col("reactance")).when(F.abs("susceptance") > 1e-12, 1 / F.col("susceptance")).otherwise(0.0)
    plain = F.col("tap_ratio") == 1.0
    z = F.when(F.col("v0") > 0, F.col("v0") * F.col("v0") / base).otherwise(1.0)
    own = _uuid("line", F.col("line_id"))
    add("EQ", 2, lines.where(plain), _element("ACLineSegment", own, {name: F.col("name"), "@ConductingEquipment.BaseVoltage": F.when(F.col("v0") > 0, _uuid("voltage", F.col("v0"))), "ACLineSegment.r": F.col("resistance") * z, "ACLineSegment.x": x * z, "ACLineSegment.bch": F.col("shunt_susceptance") / z}))
    add("EQ", 2, lines.where(~plain), _element("PowerTransformer", own, {name: F.col("name")}))
    u = [F.when(F.col("v0") > 0, F.col("v0")).otherwise(1.0) * F.col("tap_ratio"), F.when(F.col("v1") > 0, F.col("v1")).otherwise(1.0)]
    zt = u[0] * u[0] / base
    for n in (1, 2):
        ohm = {"PowerTransformerEnd.r": F.col("resistance") * zt if n == 1 else F.lit(0.0), "PowerTransformerEnd.x": x * zt if n == 1 else F.lit(0.0)}
        add("EQ", 4, lines.where(~plain), _element("PowerTransformerEnd", _uuid(f"winding{n}", F.col("line_id")), {"@PowerTransformerEnd.PowerTransformer": own, "@TransformerEnd.Terminal": _uuid(f"line-terminal{n}", F.col("line_id")), "PowerTransformerEnd.ratedU": u[n - 1], **ohm, "TransformerEnd.endNumber": F.lit(n)}))
        terminal(lines, "line", "line_id", f"bus{n - 1}", n)
    rated = lines.where(F.col("s_nom") < UNRATED)
    limits = _uuid("limits", F.col("line_id"))
    add("EQ", 5, rated, _element("OperationalLimitSet", limits, {"@OperationalLimitSet.Terminal": _uuid("line-terminal1", F.col("line_id"))}))
    add("EQ", 6, rated, _element("ActivePowerLimit", _uuid("limit", F.col("line_id")), {"@OperationalLimit.OperationalLimitSet": limits, "ActivePowerLimit.value": F.col("s_nom")}))

    gens = net["generators"]
    machine, unit = _uuid("generator", F.col("gen_id")), _uuid("unit", F.col("gen_id"))
    reactive = {f"SynchronousMachine.{k}": F.when(F.abs(c) != float("inf"), F.col(c)) for k, c in (("minQ", "q_min"), ("maxQ", "q_max"))}
    add("EQ", 2, gens, _element("SynchronousMachine", machine, {name: F.col("name"), "@RotatingMachine.GeneratingUnit": unit, **reactive}))
    for kind, carrier in [*CARRIERS.items(), ("GeneratingUnit", None)]:
        mine = gens.where(F.col("carrier") == carrier if carrier else ~F.col("carrier").isin(*CARRIERS.values()))
        add("EQ", 4, mine, _element(kind, unit, {name: F.col("name"), "GeneratingUnit.maxOperatingP": F.col("p_nom"), "GeneratingUnit.minOperatingP": F.col("p_nom") * F.col("p_min_pu")}))
    terminal(gens, "generator", "gen_id", "bus_id", 1)
    add("SSH", 0, gens, _element("SynchronousMachine", machine, {"Equipment.inService": F.lit("true")}, about=True))
    loads = net["loads"]
    load = _uuid("load", F.col("load_id"))
    add("EQ", 2, loads, _element("EnergyConsumer", load, {name: F.col("name")}))
    terminal(loads, "load", "load_id", "bus_id", 1)
    add("SSH", 1, loads, _element("EnergyConsumer", load, {"EnergyConsumer.p": F.col("p_set"), "EnergyConsumer.q": F.col("q_set")}, about=True))
    if voltages is not None:
        add("SV", 0, voltages, _element("SvVoltage", _uuid("voltage-state", F.col("bus_id")), {"@SvVoltage.TopologicalNode": node, "SvVoltage.v": F.col("v_kv"), "SvVoltage.angle": F.col("angle")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(net: Network, folder: str, name: str = "model", voltages: DataFrame | None = None) -> None:
    """One document for each profile, ``<folder>/<name>_EQ.xml`` and so on. A document is one file, so it passes the driver a row at a time."""
    spark = net.spark
    rows = documents(net, voltages)
    for profile in ("EQ", "TP", "SSH") + (("SV",) if voltages is not None else ()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_{profile}.xml")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(_HEAD.encode()))
        held = ""
        for r in rows.where(F.col("profile") == profile).orderBy("rank", "xml").toLocalIterator():
            held += r["xml"] + "\n"
            if len(held) > 1 << 20:
                out.write(bytearray(held.encode()))
                held = ""
        out.write(bytearray((held + "</rdf:RDF>\n").encode()))
        out.close()
