"""A network while a single-file case is being read: rows by table, numbered as they come, and what had to be left out."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession

from feederflow.network import Globals, Network

#: A corridor whose case states no rating.
UNRATED = 1e6


class SourceError(ValueError):
    """What is wrong with an input, with its file and row."""


class Draft:
    def __init__(self, base_mva: float = 100.0):
        self.base_mva = base_mva
        self.buses: list[dict] = []
        self.generators: list[dict] = []
        self.lines: list[dict] = []
        self.loads: list[dict] = []
        self.at: dict = {}  # a case's own key of a bus -> its number
        self.left_out: Counter = Counter()
        self.notes: list[str] = []

    def bus(self, key, name: str, country: str, **more) -> int:
        """A new bus; of a repeated key the last holds."""
        self.at[key] = len(self.buses)
        self.buses.append({"name": name, "country": country, **more})
        return self.at[key]

    def voltage_limits(self, bus: int, high: float | None, low: float | None) -> None:
        """Limits that are in order hold, others leave the defaults."""
        if high is not None and low is not None and high > low > 0:
            self.buses[bus] |= {"v_max": high, "v_min": low}

    def find(self, key, what: str) -> int | None:
        """The bus of a component; one that isn't there leaves the component out."""
        if key not in self.at:
            self.left_out[f"{what} at unknown or disconnected buses"] += 1
        return self.at.get(key)

    def ends(self, a, b, what: str) -> tuple[int, int] | None:
        """The two buses of a corridor, which must be there and differ."""
        if a not in self.at or b not in self.at:
            self.left_out[f"{what} at unknown or disconnected buses"] += 1
            return None
        if self.at[a] == self.at[b]:
            self.left_out[f"self-loop {what}"] += 1
            return None
        return self.at[a], self.at[b]

    def out_of_service(self, status: float | None, what: str) -> bool:
        if status is not None and int(status) == 0:
            self.left_out[f"out-of-service {what}"] += 1
            return True
        return False

    def generator(self, name: str, bus: int, top: float, low: float = 0.0, **more) -> None:
        self.generators.append({"name": name, "bus_id": bus, "p_nom": top, "p_min_pu": min(max(low / top, 0.0), 1.0) if top > 0 else 0.0, **more})

    def line(self, name: str, ends: tuple[int, int], r: float, x: float, b: float = 0.0, rate: float = 0.0, tap: float = 1.0, shift: float = 0.0, least_x: float = 1e-9) -> None:
        """A branch; without reactance it is a corridor without physics, without a rating it is unlimited."""
        if abs(x) <= least_x:
            self.left_out["zero-reactance branches treated as transport links"] += 1
        if not rate > 0:
            self.left_out["branches without a rating, treated as unlimited"] += 1
        self.lines.append({
            "name": name, "bus0": ends[0], "bus1": ends[1], "s_nom": rate if rate > 0 else UNRATED, "susceptance": 1 / x if abs(x) > least_x else 0.0, "resistance": r, "reactance": x,
            "shunt_susceptance": b, "tap_ratio": tap if tap > 0 else 1.0, "phase_shift": shift,
        })

    def corridor(self, name: str, ends: tuple[int, int], rate: float) -> None:
        """A tie without physics, as a direct-current line is one."""
        self.lines.append({"name": name, "bus0": ends[0], "bus1": ends[1], "s_nom": rate if rate > 0 else UNRATED, "susceptance": 0.0})

    def load(self, name: str, bus: int, p: float, q: float) -> None:
        self.loads.append({"name": name, "bus_id": bus, "p_set": p, "q_set": q})

    def loads_by_bus(self, demand: dict[int, tuple[float, float]]) -> None:
        """One load for each bus that has any demand, by number."""
        for bus, (p, q) in sorted(demand.items()):
            if abs(p) >= 1e-12 or abs(q) >= 1e-12:
                self.load(f"load_{self.buses[bus]['name']}", bus, p, q)

    def areas(self) -> list[str]:
        """``sync{smallest bus}`` for the buses that branches with physics connect."""
        up = list(range(len(self.buses)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for r in self.lines:
            if r["susceptance"] > 0:
                a, b = sorted((root(r["bus0"]), root(r["bus1"])))
                up[b] = a
        return [f"sync{root(k)}" for k in range(len(up))]

    def network(self, spark: SparkSession) -> Network:
        """One snapshot of what was read."""
        if not self.buses:
            raise SourceError("bus: the section is missing or empty")
        for bus, area in zip(self.buses, self.areas(), strict=True):
            bus["synchronous_area"] = area
        notes = [*self.notes, *(f"{n} {what}" for what, n in sorted(self.left_out.items()))]
        rows = {"buses": self.buses, "generators": self.generators, "lines": self.lines, "loads": self.loads}
        return Network.of(spark, Globals(base_mva=self.base_mva), notes, snapshots=[{"t": 0}], **{k: v for k, v in rows.items() if v})
