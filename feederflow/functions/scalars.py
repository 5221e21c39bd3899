"""Scalar formulas as column expressions, and the one score that needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dc_efficiency(km: Column, loss_per_1000km: float) -> Column:
    """What a direct-current tie delivers of what it takes, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(loss_per_1000km) * km / 1000))


def admittance(r: Column, x: Column) -> tuple[Column, Column]:
    """Series conductance and susceptance; null where the impedance is as good as 0."""
    z = r * r + x * x
    return F.when(z >= 1e-12, r / z), F.when(z >= 1e-12, -x / z)


def head_level(least: Column, filling: Column) -> Column:
    return F.greatest(F.lit(1e-6), least + (1 - least) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), filling)))


def mccormick(xl: Column, xu: Column, yl: Column, yu: Column) -> Column:
    """The four planes that enclose ``w = x * y`` over a box: rows ``(a, b, c, at_least)`` with ``w >=/<= a x + b y + c``."""
    row = lambda a, b, c, lower: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.lit(lower).alias("at_least"))
    return F.array(row(yl, xl, -xl * yl, True), row(yu, xu, -xu * yu, True), row(yl, xu, -xu * yl, False), row(yu, xl, -xl * yu, False))


def secant(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Slope and intercept of the chord of a square between two points."""
    return lo + hi, -lo * hi


def wkt_point(text: Column) -> Column:
    number = r"(-?[\d.]+(?:[eE][+-]?\d+)?)"
    get = lambda k: F.regexp_extract(text, rf"POINT\s*\(\s*{number}\s+{number}\s*\)", k)
    return F.struct(F.when(get(1) != "", get(1).cast("double")).alias("lon"), F.when(get(2) != "", get(2).cast("double")).alias("lat"))


def hstore(text: Column) -> Column:
    """``"key"=>"value"`` pairs as a map; of a repeated key the last holds."""
    keys, values = (F.regexp_extract_all(text, F.lit(r'"([^"]*)"=>"([^"]*)"'), F.lit(k)) for k in (1, 2))
    return F.map_from_arrays(keys, values)


def mercator(lat: Column) -> Column:
    held = F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat))
    return F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(held) / 2))


def place(lon: Column, lat: Column) -> Column:
    """A coordinate, or null outside the globe or where a number isn't finite."""
    ok = (F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


#: The least kV of a level and the MW that one circuit carries there; below all levels 100.
THERMAL = [(700, 4000.0), (500, 2500.0), (360, 1700.0), (280, 1200.0), (200, 550.0), (100, 180.0)]

#: What a description contains and the carrier that it then is; the first that fits holds.
FUELS = [
    ("pure storage", "storage"), ("pumped", "storage"), ("wind", "wind"), ("solar", "solar"), ("photovolt", "solar"), ("hydro", "hydro"), ("nuclear", "nuclear"), ("brown coal", "lignite"),
    ("lignite", "lignite"), ("hard coal", "coal"), ("coal", "coal"), ("gas", "gas"), ("oil", "oil"), ("waste", "waste"), ("biomass", "biomass"), ("geotherm", "other"),
]


def _first(cases: list, default) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(default)
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def thermal_mw(kv: Column) -> Column:
    """What a circuit carries at a voltage."""
    return _first([(kv >= least, mw) for least, mw in THERMAL], 100.0)


def line_susceptance(kv: Column, km: Column, circuits: Column) -> Column:
    """Per unit on 100 MVA from voltage and length, held between 0.5 and 5000."""
    return F.greatest(F.lit(0.5), F.least(F.lit(5000.0), kv * kv / (0.3 * km * 100.0) * circuits))


def fuel(text: Column) -> Column:
    """The carrier that a plant's description names."""
    return _first([(F.lower(text).contains(part), carrier) for part, carrier in FUELS], "other")


def place_kind(feature: Column, population: Column) -> Column:
    """What sort of place it is: capitals by their class, others city or town by population."""
    f = F.lower(feature)
    return F.when(f.startswith("admin-0 capital"), "country").when(f.startswith("admin-1"), "region").when(population >= 100_000, "city").otherwise("town")


def quantise(value: Column, full: Column | float) -> Column:
    """A coordinate as a share of ``full`` in 32767 steps either way, held at the ends; halves go away from 0."""
    return F.greatest(F.lit(-32767), F.least(F.lit(32767), F.round(value / full * 32767).cast("int")))


def cut_name(text: Column, most: int = 255) -> Column:
    """As many whole characters as fit ``most`` bytes of UTF-8."""
    raw = F.encode(text, "UTF-8")
    last = F.sequence(F.lit(most + 1), F.lit(most - 2), F.lit(-1))  # of the bytes just beyond the cut, the nearest that starts a character
    starts = F.filter(last, lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("int").bitwiseAND(192) != 128)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.element_at(starts, 1) - 1), "UTF-8"))


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def xsd_datetime(seconds: Column) -> Column:
    """Seconds since 1970 as a date and time in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def quoted_fields(line: Column) -> Column:
    """The fields of a comma-separated line in which single quotes hold fields together; the quotes go."""
    found = F.regexp_extract_all(line, F.lit(r"((?:'[^']*'|[^,'])*)(?:,|$)"), F.lit(1))
    return F.transform(F.when(line.endswith(","), found).otherwise(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(1)))), lambda x: F.trim(F.replace(x, F.lit("'"), F.lit(""))))


def fuzzy_score(needle: str, text: str) -> int | None:
    """How well a needle fits as a subsequence: 14 for a letter at the start, 9 after a separator or where a capital
    follows a small letter, else 1. A letter right after the one before gains 10, if no other way to get so far is
    better without it. A quarter of the length comes off. None if it isn't a subsequence."""
    a, b = needle.lower(), text.lower()
    if not a:
        return 0

    def worth(j: int) -> int:
        if j == 0:
            return 14
        hump = j < len(text) and text[j].isupper() and text[j - 1].islower()
        return 9 if b[j - 1] in "_- ./:" or hump else 1

    ends: dict[int, int] | None = None  # score of the best way that ends just at a place; none before the first letter
    for c in a:
        now: dict[int, int] = {}
        best = 0 if ends is None else None
        for j, d in enumerate(b):
            last = ends.get(j - 1) if ends else None
            if last is not None:
                best = last if best is None else max(best, last)
            if d == c and best is not None:
                now[j] = worth(j) + (last + 10 if last is not None and last >= best else best)
        ends = now
        if not ends:
            return None
    return max(ends.values()) - len(b) // 4


def fuzzy_udf(needle: str):
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fuzzy_score(needle, t)).astype("Int32")

    return run
