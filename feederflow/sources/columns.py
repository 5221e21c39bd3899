"""Cases in fixed columns: the IEEE common data format and UCTE-DEF. Columns count from 1, both ends included."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import SparkSession

from feederflow.network import Network
from feederflow.sources.draft import Draft, SourceError


@dataclass
class Row:
    """One line and its number, read by the column ranges of ``spec``."""

    line: int
    raw: str
    spec: dict[str, tuple[int, int]]

    def text(self, field: str) -> str:
        a, b = self.spec[field]
        return self.raw[a - 1 : b].strip()

    def num(self, field: str) -> float:
        """A blank field is 0, an unreadable one an error."""
        text = self.text(field)
        try:
            return float(text) if text else 0.0
        except ValueError:
            raise SourceError(f"line {self.line}, columns {self.spec[field][0]}-{self.spec[field][1]}: {field} is {text!r}") from None

    def int(self, field: str) -> int:
        return int(self.num(field))


#: Fixed values of the IEEE format: column ranges.
CDF_TITLE = {"base": (32, 37), "year": (39, 42), "season": (44, 44), "case": (46, 73)}
CDF_BUS = {
    "number": (1, 4), "name": (6, 17), "area": (19, 20), "type": (25, 26), "load MW": (41, 49), "load MVAr": (50, 59), "generation MW": (60, 67), "generation MVAr": (68, 75), "base kV": (77, 83),
    "maximum": (91, 98), "minimum": (99, 106), "shunt G": (107, 114), "shunt B": (115, 122),
}
CDF_BRANCH = {"from": (1, 4), "to": (6, 9), "circuit": (17, 17), "resistance": (20, 29), "reactance": (30, 40), "charging": (41, 50), "rating": (51, 55), "ratio": (77, 82), "angle": (84, 90)}


def cdf(spark: SparkSession, text: str) -> Network:
    """One snapshot of an IEEE common data format case: no costs, and the scheduled generation stands for the capacity."""
    lines = [(n, line) for n, line in enumerate(text.splitlines(), start=1) if line.strip()]
    if not lines:
        raise SourceError("the file is empty")
    title = Row(*lines[0], CDF_TITLE)
    d = Draft(title.num("base") if title.num("base") > 0 else 100.0)
    d.notes.append(f"IEEE common data format, base {d.base_mva} MVA, {title.text('year')} {title.text('season')} {title.text('case')}".rstrip(" ,"))
    buses, branches, section, seen = [], [], None, set()
    for n, line in lines[1:]:
        upper = line.upper()
        if upper.startswith("END OF DATA"):
            break
        if "FOLLOWS" in upper:
            section = "bus" if upper.startswith("BUS DATA") else "branch" if upper.startswith("BRANCH DATA") else "other"
            seen.add(section)
        elif line.strip().startswith("-9") and set(line.strip()[1:]) == {"9"}:
            section = "other"
        elif section == "bus":
            buses.append(Row(n, line, CDF_BUS))
        elif section == "branch":
            branches.append(Row(n, line, CDF_BRANCH))
        elif section == "other":
            d.left_out["loss zone, interchange and tie line records"] += 1
    for name in ("bus", "branch"):
        if name not in seen:
            raise SourceError(f"{name}: the section is missing")
    for r in buses:
        key, kind, high, low = r.int("number"), r.int("type"), r.num("maximum"), r.num("minimum")
        if key in d.at:
            d.notes.append(f"line {r.line}: bus {key} is defined more than once")
        bus = d.bus(key, r.text("name") or f"bus{key}", f"area{r.int('area')}", v_nom=r.num("base kV"), g_shunt=r.num("shunt G"), b_shunt=r.num("shunt B"))
        made, reactive = r.num("generation MW"), r.num("generation MVAr")
        if kind in (2, 3) or made or reactive:
            limits = {"q_max": high, "q_min": low} if kind in (2, 3) and high > low else {}
            d.generator(f"gen{key}", bus, max(made, 0.0), **limits)
        if kind == 1:
            d.voltage_limits(bus, high, low)
        if r.num("load MW") or r.num("load MVAr"):
            d.load(f"load{key}", bus, r.num("load MW"), r.num("load MVAr"))
    for r in branches:
        a, b = r.int("from"), r.int("to")
        for key in (a, b):
            if key not in d.at:
                raise SourceError(f"line {r.line}: no bus {key}")
        if ends := d.ends(a, b, "branches"):
            ratio = r.num("ratio")
            d.line(f"{a}-{b}-{r.int('circuit')}", ends, r.num("resistance"), r.num("reactance"), r.num("charging"), r.num("rating"), ratio if ratio > 0 else 1.0, math.radians(r.num("angle")))
    d.notes.append("no generation costs; scheduled generation stands for the capacity")
    return d.network(spark)


#: Fixed value: kV by the seventh character of a node's code.
UCTE_KV = {"0": 750.0, "1": 380.0, "2": 220.0, "3": 150.0, "4": 120.0, "5": 110.0, "6": 70.0, "7": 27.0, "8": 330.0, "9": 500.0}
#: Fixed values of UCTE-DEF: column ranges.
UCTE_ENDS = {"a": (1, 8), "b": (10, 17), "order": (19, 19)}
UCTE_NODE = {
    "code": (1, 8), "status": (23, 23), "reference kV": (27, 32), "load MW": (34, 40), "load MVAr": (42, 48), "generation MW": (50, 56), "least MW": (66, 72), "most MW": (74, 80), "least MVAr": (82, 88), "most MVAr": (90, 96),
}
UCTE_LINE = UCTE_ENDS | {"status": (21, 21), "resistance": (23, 28), "reactance": (30, 35), "susceptance": (37, 44), "amperes": (46, 51)}
UCTE_TRANSFORMER = UCTE_ENDS | {
    "status": (21, 21), "kV 1": (23, 27), "kV 2": (29, 33), "nominal MVA": (35, 39), "resistance": (41, 46), "reactance": (48, 53), "susceptance": (55, 62), "conductance": (64, 69), "amperes": (71, 76),
}
UCTE_REGULATION = UCTE_ENDS | {"phase step": (21, 25), "phase tap": (31, 33), "angle step": (41, 45), "direction": (47, 51), "angle tap": (57, 59), "sort": (67, 70)}
UCTE_TAPS = UCTE_ENDS | {"position": (21, 23), "resistance": (25, 30), "reactance": (32, 37)}
#: Fixed value: the base on which ohms become per unit; the format names none.
UCTE_BASE = 100.0


def _block(line: str) -> str | None:
    """The block that a ``##`` line opens."""
    if not line.startswith("##"):
        return None
    rest = line[2:].upper()
    return "taps" if rest.startswith("TT") else {"C": "comment", "N": "node", "Z": "node", "L": "line", "T": "transformer", "R": "regulation"}.get(rest[:1], "other")


def regulated(r: Row | None) -> tuple[float, float]:
    """Magnitude and angle by which a transformer's taps turn the voltage.

    A step along an angle is a vector added to the voltage: to one side, or if symmetrical half to each.
    """
    if r is None:
        return 1.0, 0.0
    size = 1 + r.num("phase tap") * r.num("phase step") / 100
    step = r.num("angle tap") * r.num("angle step") / 100
    if not step:
        return size, 0.0
    added = step * complex(math.cos(math.radians(r.num("direction"))), math.sin(math.radians(r.num("direction"))))
    turned = (1 + added / 2) / (1 - added / 2) if r.text("sort").upper() == "SYMM" else 1 + added
    return size * abs(turned), math.atan2(turned.imag, turned.real)


def ucte(spark: SparkSession, text: str) -> Network:
    """One snapshot of a UCTE-DEF case: ohms, microsiemens and amperes become per unit and MVA, generation is negative there."""
    specs = {"node": UCTE_NODE, "line": UCTE_LINE, "transformer": UCTE_TRANSFORMER, "regulation": UCTE_REGULATION, "taps": UCTE_TAPS}
    rows: dict[str, list] = {k: [] for k in specs}
    d, block, country, nodes = Draft(UCTE_BASE), "comment", "", False
    for n, line in enumerate(text.splitlines(), start=1):
        if not line.strip():
            continue
        if opened := _block(line):
            block = opened
            nodes |= block == "node"
            country = line[3:].strip() if line[:3].upper() == "##Z" else ""
        elif block in specs:
            rows[block].append((Row(n, line, specs[block]), country))
        elif block == "other":
            d.left_out["records of other blocks"] += 1
    if not nodes:
        raise SourceError("node: the block is missing")
    for r, zone in rows["node"]:
        code = r.text("code")
        if len(code) < 8:
            raise SourceError(f"line {r.line}: the node code {code!r} is short")
        kv = UCTE_KV.get(code[6])
        if kv is None:
            d.left_out["nodes without a known voltage level, at their reference voltage"] += 1
        bus = d.bus(code, code, zone or code[0], v_nom=r.num("reference kV") if kv is None else kv)
        if r.int("status") == 1:
            d.left_out["nodes that stand for a network outside"] += 1
        if r.num("load MW") or r.num("load MVAr"):
            d.load(f"load_{code}", bus, r.num("load MW"), r.num("load MVAr"))
        made, most, least = -r.num("generation MW"), max(-r.num("least MW"), 0.0), max(-r.num("most MW"), 0.0)
        top = most if most > 0 else max(made, 0.0)
        if top > 0 or made:
            reactive = {k: -r.num(f) for k, f in (("q_min", "most MVAr"), ("q_max", "least MVAr")) if r.text(f)}
            d.generator(f"gen_{code}", bus, top, least, **reactive)

    def ends(r: Row, what: str) -> tuple[str, tuple[int, int]] | None:
        a, b, status = r.text("a"), r.text("b"), r.int("status")
        if status in (7, 8, 9):
            d.left_out[f"out-of-service {what}"] += 1
            return None
        if status == 2:
            d.left_out["closed busbar couplers kept as corridors"] += 1
        for code in (a, b):
            if code not in d.at:
                raise SourceError(f"line {r.line}: no node {code!r}")
        both = d.ends(a, b, what)
        return both and (f"{a}-{b}-{r.text('order')}", both)

    def per_unit(ohm: tuple[float, float], micro: float, kv: float) -> tuple[float, float, float]:
        base = kv * kv / UCTE_BASE
        return (ohm[0] / base, ohm[1] / base, micro * 1e-6 * base) if base > 0 else (*ohm, micro)

    for r, _ in rows["line"]:
        if got := ends(r, "lines"):
            kv = d.buses[got[1][0]]["v_nom"]
            if abs(kv - d.buses[got[1][1]]["v_nom"]) > 1e-9:
                d.left_out["lines between different voltage levels"] += 1
            d.line(*got, *per_unit((r.num("resistance"), r.num("reactance")), r.num("susceptance"), kv), math.sqrt(3) * kv * r.num("amperes") / 1000, least_x=1e-12)
    key = lambda r: tuple(r.text(k) for k in UCTE_ENDS)
    regulation = {key(r): r for r, _ in rows["regulation"]}
    taps = {(*key(r), r.int("position")): (r.num("resistance"), r.num("reactance")) for r, _ in rows["taps"]}
    for r, _ in rows["transformer"]:
        if not (got := ends(r, "transformers")):
            continue
        kv1, kv2 = (d.buses[e]["v_nom"] for e in got[1])
        own = regulation.get(key(r))
        size, angle = regulated(own)
        ohm = taps.get((*key(r), own.int("phase tap") if own else 0), (r.num("resistance"), r.num("reactance")))
        if r.num("conductance"):
            d.left_out["transformers whose magnetising conductance has no place"] += 1
        rate = r.num("nominal MVA") if r.num("nominal MVA") > 0 else math.sqrt(3) * kv2 * r.num("amperes") / 1000
        rated = r.num("kV 1"), r.num("kV 2")
        tap = (rated[0] / kv1) / (rated[1] * size / kv2) if min(*rated, kv1, kv2) > 0 and size > 0 else 1.0
        d.line(*got, *per_unit(ohm, r.num("susceptance"), kv2), rate, tap, -angle if angle else 0.0, least_x=1e-12)
    d.notes.append(f"UCTE-DEF: ohms and microsiemens in per unit on {UCTE_BASE} MVA, which the format does not name; line ratings from amperes")
    return d.network(spark)
