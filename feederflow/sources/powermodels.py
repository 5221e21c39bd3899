"""PowerModels JSON: objects by key, in per unit of the base or in MW."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from feederflow.network import Network
from feederflow.sources.draft import Draft, SourceError


def _number(row: dict, field: str, default: float | None = None) -> float | None:
    v = row.get(field)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def _in_order(root: dict, section: str) -> list[tuple[str, dict]]:
    """A section's objects by their keys, numbers in the order of their size."""
    found = root.get(section, {})
    if not isinstance(found, dict):
        raise SourceError(f"{section}: an object is expected")
    return sorted(found.items(), key=lambda kv: (0, int(kv[0]), "") if kv[0].isdigit() else (1, 0, kv[0]))


def powermodels(spark: SparkSession, text: str) -> Network:
    """One snapshot; power is multiplied by the base where the case is in per unit, of costs the linear term counts."""
    root = json.loads(text)
    if not isinstance(root, dict) or not root.get("bus"):
        raise SourceError("bus: the section is missing or empty")
    base = _number(root, "baseMVA", 0.0)
    d = Draft(base if base > 0 else 100.0)
    scale = d.base_mva if root.get("per_unit") is True else 1.0
    d.notes.append(f"per unit, all power multiplied by {d.base_mva}" if scale != 1.0 else f"no per-unit flag, values taken as MW; base {d.base_mva}")
    label = lambda kind, key: f"{kind}{key.lstrip('0')}"

    for key, r in _in_order(root, "bus"):
        number = _number(r, "bus_i", _number(r, "index"))
        if number is None:
            raise SourceError(f"bus {key}: bus_i is missing")
        if int(_number(r, "bus_type", 1.0)) == 4:
            continue
        area = _number(r, "area")
        name = r.get("name") if isinstance(r.get("name"), str) else f"bus{int(number)}"
        d.voltage_limits(d.bus(int(number), name, "??" if area is None else f"area{int(area)}"), _number(r, "vmax"), _number(r, "vmin"))

    def key_of(r: dict, field: str):
        number = _number(r, field)
        return None if number is None else int(number)

    for key, r in _in_order(root, "load"):
        if not d.out_of_service(_number(r, "status", 1.0), "loads") and (bus := d.find(key_of(r, "load_bus"), "loads")) is not None:
            d.load(label("load", key), bus, _number(r, "pd", 0.0) * scale, _number(r, "qd", 0.0) * scale)
    for key, r in _in_order(root, "gen"):
        if d.out_of_service(_number(r, "gen_status", 1.0), "generators") or (bus := d.find(key_of(r, "gen_bus"), "generators")) is None:
            continue
        cost = [float(c) for c in r.get("cost") or [] if isinstance(c, (int, float))]
        if len(cost) > 2:
            d.left_out["generators with quadratic costs, by their linear term"] += 1
        limits = {"q_min": _number(r, "qmin", float("-inf")) * scale, "q_max": _number(r, "qmax", float("inf")) * scale}
        d.generator(label("gen", key), bus, _number(r, "pmax", 0.0) * scale, _number(r, "pmin", 0.0) * scale, marginal_cost=cost[-2] / scale if len(cost) >= 2 else 0.0, **limits)
    for key, r in _in_order(root, "branch"):
        if not d.out_of_service(_number(r, "br_status", 1.0), "branches") and (ends := d.ends(key_of(r, "f_bus"), key_of(r, "t_bus"), "branches")):
            charging = _number(r, "b_fr", 0.0) + _number(r, "b_to", 0.0)
            d.line(label("branch", key), ends, _number(r, "br_r", 0.0), _number(r, "br_x", 0.0), charging, _number(r, "rate_a", 0.0) * scale, _number(r, "tap", 1.0))
    for key, r in _in_order(root, "dcline"):
        if not d.out_of_service(_number(r, "br_status", 1.0), "DC lines") and (ends := d.ends(key_of(r, "f_bus"), key_of(r, "t_bus"), "DC lines")):
            d.corridor(label("dcline", key), ends, max(abs(_number(r, "pmaxf", 0.0)), abs(_number(r, "pmaxt", 0.0))) * scale)
    return d.network(spark)
