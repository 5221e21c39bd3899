"""MATPOWER and the native JSON, and reading any format after telling it from what is in a file."""

from __future__ import annotations

import json
import re
from enum import Enum

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from feederflow.network import COMPONENTS, KEYS, Globals, Network
from feederflow.operators.topology import synchronous_areas
from feederflow.sources import cgmes
from feederflow.sources.columns import cdf, ucte
from feederflow.sources.draft import UNRATED, SourceError
from feederflow.sources.powermodels import powermodels
from feederflow.sources.psse import psse, rawx
from feederflow.sources.tables import LIMITS, assemble, exists, load_csv, load_parquet, parse_csv, with_profiles
from feederflow.sources.workbook import sheets_of

def matrix(text: str, name: str) -> list[list[float]]:
    """``mpc.name = [...]`` as rows of numbers, comments dropped."""
    m = re.search(rf"mpc\.{name}\s*=\s*\[(.*?)\]", text, re.DOTALL)
    if not m:
        return []
    out = []
    for line in re.sub(r"%[^\n]*", "", m[1]).replace(";", "\n").splitlines():
        cells = line.replace(",", " ").split()
        if cells:
            try:
                out.append([float(c) for c in cells])
            except ValueError:
                raise SourceError(f"{name} row {len(out) + 1}: {line.strip()!r}") from None
    return out


def matpower(spark: SparkSession, text: str) -> Network:
    """One snapshot of a MATPOWER case; units and branches out of service are left out, areas follow from the branches."""
    buses, gens, branches, costs = (matrix(text, k) for k in ("bus", "gen", "branch", "gencost"))
    for name, rows, width in (("bus", buses, 13), ("gen", gens, 10), ("branch", branches, 11)):
        short = next((k for k, r in enumerate(rows) if len(r) < width), None)
        if short is not None:
            raise SourceError(f"{name} row {short + 1}: {len(rows[short])} of {width} columns")
    if not buses:
        raise SourceError("bus: the section is missing")
    base = re.search(r"mpc\.baseMVA\s*=\s*([\d.eE+-]+)", text)
    base_mva = float(base[1]) if base else 100.0
    at = {int(r[0]): k for k, r in enumerate(buses)}
    notes, units, wires = [], [], []

    def known(bus: float, where: str) -> int:
        if int(bus) not in at:
            raise SourceError(f"{where}: no bus {int(bus)}")
        return at[int(bus)]

    for k, r in enumerate(gens):
        bus, top, low = known(r[0], f"gen row {k + 1}"), r[8], r[9]
        if r[7] <= 0:
            continue
        c = costs[k] if k < len(costs) else []
        # The linear term of a polynomial: the last but one of its n coefficients.
        cost = c[4 + int(c[3]) - 2] if len(c) > 4 and c[0] == 2 and int(c[3]) >= 2 and len(c) >= 4 + int(c[3]) else 0.0
        units.append({"name": f"gen{k + 1}", "bus_id": bus, "p_nom": max(top, 0.0), "marginal_cost": cost, "p_min_pu": min(max(low / top, 0.0), 1.0) if top > 0 else 0.0, "q_min": r[4], "q_max": r[3]})
    flat = 0
    for k, r in enumerate(branches):
        ends = known(r[0], f"branch row {k + 1}"), known(r[1], f"branch row {k + 1}")
        if r[10] <= 0:
            continue
        flat += abs(r[3]) <= 1e-9
        wires.append({"name": f"branch{k + 1}", "bus0": ends[0], "bus1": ends[1], "s_nom": r[5] if r[5] > 0 else UNRATED, "susceptance": 1 / r[3] if abs(r[3]) > 1e-9 else 0.0, "resistance": r[2], "reactance": r[3], "shunt_susceptance": r[4], "tap_ratio": r[8] or 1.0, "phase_shift": r[9] * 3.141592653589793 / 180})
    if flat:
        notes.append(f"{flat} branches without reactance are corridors")
    nodes = [{"name": f"bus{int(r[0])}", "g_shunt": r[4] / base_mva, "b_shunt": r[5] / base_mva, "v_nom": r[9], "v_max": r[11], "v_min": r[12]} for r in buses]
    demand = [{"name": f"load{int(r[0])}", "bus_id": at[int(r[0])], "p_set": r[2], "q_set": r[3]} for r in buses if r[2] or r[3]]
    net = Network.of(spark, Globals(base_mva=base_mva), notes, snapshots=[{"t": 0}], buses=nodes, generators=units, lines=wires, loads=demand)
    return with_areas(net)


def with_areas(net: Network) -> Network:
    areas = synchronous_areas(net["buses"], net["lines"])
    return net.with_tables(buses=net["buses"].drop("synchronous_area").join(areas.withColumnRenamed("area", "synchronous_area"), "bus_id"))


#: The native JSON's names for our tables, and those of the references in them.
NATIVE = {"buses": "buses", "generators": "generators", "lines": "lines", "links": "links", "loads": "loads", "storage": "storage_units"}
_NUMBERS = {"inf": float("inf"), "-inf": float("-inf"), "nan": float("nan")}


def _value(v, kind: str, default):
    if v is None:
        return default
    if isinstance(v, str) and kind == "double":
        return _NUMBERS[v]
    return [tuple(map(float, x)) for x in v] if kind.startswith("array") else float(v) if kind == "double" else v


def native_json(spark: SparkSession, text: str) -> Network:
    """The lossless form: infinite numbers are the strings ``inf`` and ``-inf``, profiles flat and component by component."""
    j = json.loads(text)
    rows = {"snapshots": [{"t": t, "weight": w} for t, w in enumerate(j["snapshots"]["weights"])]}
    for theirs, ours in NATIVE.items():
        rename = {"bus": "bus_id", "downstream": "downstream_id"} if ours != "lines" else {}
        kinds = {n: (t, d) for n, t, d in COMPONENTS[ours]}
        items = []
        for r in j.get(theirs, []):
            item = {rename.get(k, k): v for k, v in r.items()}
            place = item.pop("position", None) or {}
            item |= {"x": place.get("lon"), "y": place.get("lat")} if ours == "buses" else {}
            items.append({k: _value(v, *kinds[k]) for k, v in item.items() if k in kinds})
        rows[ours] = items
    for k, p in enumerate(j.get("investment_periods", [])):
        rows.setdefault("periods", []).append(p | {"period": k})
    for k, p in enumerate(j.get("scenarios", [])):
        rows.setdefault("scenarios", []).append(p | {"scenario": k})
    rows["contingencies"] = [{"line_id": k} for k in j.get("contingencies", [])]
    n = len(rows["snapshots"])
    for series, (_, key) in {"gen_availability": ("", "gen_id"), "load_profile": ("", "load_id"), "storage_inflow": ("", "storage_id"), "head_profile": ("", "storage_id")}.items():
        flat = j.get(series, {}).get("data", [])
        if flat:
            rows[series] = [{key: k // n, "t": k % n, "value": float(v)} for k, v in enumerate(flat)]
    return Network.of(spark, Globals(**{k: _value(j[k], "double", None) for k in Globals.__dataclass_fields__ if k in j}), (), **{k: v for k, v in rows.items() if v})


def to_native_json(net: Network) -> str:
    say = lambda v: str(v) if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v
    out: dict = {"snapshots": {"weights": [r["weight"] for r in net["snapshots"].orderBy("t").collect()]}}
    n = len(out["snapshots"]["weights"])
    for theirs, ours in NATIVE.items():
        items = []
        for r in net[ours].orderBy(KEYS[ours]).collect():
            d = {k: say(v) for k, v in r.asDict(recursive=True).items() if k != KEYS[ours]}
            if ours == "buses":
                x, y = d.pop("x"), d.pop("y")
                d["position"] = None if x is None or y is None else {"lon": x, "lat": y}
            for a, b in (("bus_id", "bus"), ("downstream_id", "downstream")):
                if a in d:
                    d[b] = d.pop(a)
            if "value_tranches" in d:
                d["value_tranches"] = [[t["mw"], t["value"]] for t in d["value_tranches"]]
            items.append(d)
        out[theirs] = items
    for series, (table, key) in (("gen_availability", ("generators", "gen_id")), ("load_profile", ("loads", "load_id")), ("storage_inflow", ("storage_units", "storage_id")), ("head_profile", ("storage_units", "storage_id"))):
        have = {(r[0], r[1]): r[2] for r in net[series].select(key, "t", "value").collect()} if series in net.tables else {}
        default = {"gen_availability": 1.0}.get(series, 0.0)
        out[series] = {"data": [have.get((r[0], t), default) for r in net[table].select(key).orderBy(key).collect() for t in range(n)] if have else [], "n_snapshots": n if have else 0}
    out["investment_periods"] = [{k: v for k, v in r.asDict().items() if k != "period"} for r in net["periods"].orderBy("period").collect()]
    out["scenarios"] = [{k: v for k, v in r.asDict().items() if k != "scenario"} for r in net["scenarios"].orderBy("scenario").collect()]
    out["contingencies"] = [r[0] for r in net["contingencies"].collect()]
    return json.dumps(out | {k: say(getattr(net.settings, k)) for k in Globals.__dataclass_fields__})


class Format(Enum):
    """The formats, by what they are called; ``value`` is the short name."""

    CSV = "csv"
    PARQUET = "parquet"
    MATPOWER = "matpower"
    PSSE = "psse"
    RAWX = "rawx"
    POWERMODELS = "powermodels"
    NATIVE_JSON = "native_json"
    CGMES = "cgmes"
    UCTE = "ucte"
    CDF = "cdf"
    EXCEL = "excel"
    NETCDF = "netcdf"

    @property
    def label(self) -> str:
        return LABELS[self]

    @property
    def available(self) -> bool:
        """netCDF needs a library that isn't here."""
        return self is not Format.NETCDF


LABELS = {
    Format.CSV: "CSV folder", Format.PARQUET: "Parquet folder", Format.MATPOWER: "MATPOWER case", Format.PSSE: "PSS/E RAW", Format.RAWX: "PSS/E RAWX", Format.POWERMODELS: "PowerModels JSON", Format.NATIVE_JSON: "native JSON",
    Format.CGMES: "CIM/CGMES", Format.UCTE: "UCTE-DEF", Format.CDF: "IEEE common data format", Format.EXCEL: "Excel workbook", Format.NETCDF: "netCDF",
}
#: Readers of a text.
TEXTS = {Format.MATPOWER: matpower, Format.NATIVE_JSON: native_json, Format.PSSE: psse, Format.RAWX: rawx, Format.POWERMODELS: powermodels, Format.UCTE: ucte, Format.CDF: cdf}
#: What a file name's ending tells where its contents don't.
ENDINGS = {"m": "matpower", "raw": "psse", "rawx": "rawx", "uct": "ucte", "cdf": "cdf", "json": "native_json", "xml": "cgmes", "zip": "cgmes", "xlsx": "excel", "nc": "netcdf"}


def psse_header(text: str) -> bool:
    """Whether the first line is a PSS/E header: numbers, a positive base, a revision from 20 to 40."""
    first = re.split(r"[,/]", text.lstrip("\ufeff \t\r\n").split("\n", 1)[0])
    try:
        float(first[0])
        return float(first[1]) > 0 and len(first) > 2 and 20 <= float(first[2]) <= 40
    except (ValueError, IndexError):
        return False


def sniff_text(text: str, extension: str = "") -> str | None:
    """The format of a text: its contents decide before its name does."""
    head = text.lstrip("\ufeff \t\r\n")
    if head.startswith("{"):
        if re.search(r'"network"\s*:', head) and '"fields"' in head:
            return "rawx"
        return "powermodels" if '"per_unit"' in head or re.search(r'"branch"\s*:\s*\{', head) else "native_json"
    if head.startswith("<") and ("cim:" in head or "CIM-schema" in head):
        return "cgmes"
    if "mpc.bus" in text or re.search(r"function\s+mpc", text):
        return "matpower"
    if re.search(r"(?im)^BUS DATA FOLLOWS", text):
        return "cdf"
    if re.search(r"(?im)^##[NZ]", text) or re.search(r"(?m)^##C", text):
        return "ucte"
    if psse_header(text):
        return "psse"
    return ENDINGS.get(extension.lower().lstrip("."))


def sniff_bytes(content: bytes, extension: str = "") -> str | None:
    """The format of a file's bytes: magic numbers, then its text."""
    if content.startswith(b"PAR1"):
        return "parquet"
    if content.startswith((b"\x89HDF", b"CDF\x01", b"CDF\x02")):
        return "netcdf"
    if content.startswith(b"PK\x03\x04"):
        return "excel" if b"xl/workbook" in content or extension.lower().endswith("xlsx") else "cgmes"
    return sniff_text(content.decode("utf-8", "replace"), extension)


def sniff_path(spark: SparkSession, path: str) -> str | None:
    """The format of a folder by what it holds, of a file by its bytes."""
    for kind, name in (("csv", "buses.csv"), ("parquet", "buses.parquet")):
        if exists(spark, f"{path}/{name}"):
            return kind
    if not exists(spark, path):
        raise SourceError(f"{path}: nothing there")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        names = [f.getPath().getName().lower() for f in fs.listStatus(at)]
        return "cgmes" if any(n.endswith((".xml", ".zip")) for n in names) else None
    return sniff_bytes(_content(spark, path), path.rpartition(".")[2])


def _content(spark: SparkSession, path: str) -> bytes:
    """A single-file case; its reader works on the driver."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def load_bytes(spark: SparkSession, content: bytes, name: str = "") -> Network:
    """A single-file case from memory."""
    kind = sniff_bytes(content, name.rpartition(".")[2])
    if kind is None:
        raise SourceError(f"{name or 'the input'}: no known format")
    form = Format(kind)
    if form in TEXTS:
        net = TEXTS[form](spark, content.decode("utf-8-sig", "replace"))
    elif form is Format.CGMES:
        net = cgmes.case(spark, spark.createDataFrame([(name, bytearray(content))], "path string, content binary")).network
    elif form is Format.EXCEL:
        net = from_tables(spark, sheets_of(content))
    else:
        raise SourceError(f"{name or 'the input'}: {form.label} cannot be read" + ("" if form.available else "; its library is not there"))
    return Network(net.spark, net.tables, net.settings, (f"read as {form.label}", *net.notes))


def from_tables(spark: SparkSession, tables: dict[str, list[dict]], limits: dict | None = None) -> Network:
    """A network from tables of rows by header: components, and series with a row for each snapshot."""

    def wide(name):
        rows = tables.get(name)
        if not rows:
            return None
        cells = [[t, *(float(v) if str(v).strip() else None for v in r.values())] for t, r in enumerate(rows)]
        return spark.createDataFrame(cells, "t int, " + ", ".join(f"`{c}` double" for c in rows[0]))

    return with_profiles(assemble(spark, tables.get, limits=limits), wide)


def load_files(spark: SparkSession, files: dict[str, bytes]) -> Network:
    """A network from many files in memory by name: a folder of CSV tables, the documents of one CGMES model, or a single case."""
    base = {name.replace("\\", "/").rpartition("/")[2]: content for name, content in files.items()}
    if "buses.csv" in base:
        say = lambda name: base[name].decode("utf-8-sig")
        tables = {n[:-4]: parse_csv(say(n), n) for n in base if n.endswith(".csv")}
        return from_tables(spark, tables, {k: float(say(f"{k}.txt")) for k in LIMITS if f"{k}.txt" in base})
    documents = [(n, bytearray(c)) for n, c in base.items() if n.lower().endswith((".xml", ".zip"))]
    if documents:
        return cgmes.case(spark, spark.createDataFrame(documents, "path string, content binary")).network
    if len(base) == 1:
        name, content = next(iter(base.items()))
        return load_bytes(spark, content, name)
    raise SourceError("no buses.csv and no CGMES documents among the files")


def load_any(spark: SparkSession, path: str) -> Network:
    """Any readable input: a folder of CSV or Parquet tables or of CGMES documents, or a single-file case."""
    kind = sniff_path(spark, path)
    if kind is None:
        raise SourceError(f"{path}: no known format")
    readers = {"csv": load_csv, "parquet": load_parquet, "cgmes": cgmes.read}
    if kind not in readers:
        return load_bytes(spark, _content(spark, path), path)
    net = readers[kind](spark, path)
    return Network(net.spark, net.tables, net.settings, (f"read as {Format(kind).label}", *net.notes))


def classify(files):
    """``(path, kind)`` for a table of files ``(path, content)``: magic bytes by column expressions."""
    magic = F.substring("content", 1, 4)
    return files.select("path", F.when(magic == F.unhex(F.lit("50415231")), "parquet").when(magic == F.unhex(F.lit("504B0304")), "zip").when(magic == F.unhex(F.lit("89484446")), "netcdf").otherwise("text").alias("kind"))
