"""Map extracts and outlines on small inputs of our own."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from feederflow.functions import shapes
from feederflow.operators.validate import validate
from feederflow.sources import gridkit
from feederflow.sources.draft import SourceError


def shapefile(points):
    out = struct.pack(">i", 9994) + b"\0" * 96
    for k, p in enumerate(points, start=1):
        body = struct.pack("<idd", 1, *p) if len(p) == 2 else struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(p)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *q) for q in p)
        out += struct.pack(">ii", k, len(body) // 2) + body
    return out


def dbase(rows):
    fields = b"".join(n.encode().ljust(11, b"\0") + t + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in (("NAME", b"C", 6), ("POP_MAX", b"N", 8)))
    head = 32 + len(fields) + 1
    body = b"".join((b"*" if gone else b" ") + name.encode().ljust(6) + str(pop).rjust(8).encode() for name, pop, gone in rows)
    return b"\x03\0\0\0" + struct.pack("<IHH", len(rows), head, 15) + b"\0" * 20 + fields + b"\r" + body


def test_extract(spark, tmp_path):
    (tmp_path / "buses.csv").write_text("""bus_id,voltage,geometry,tags
1,380,'POINT(10 50)','"country"=>"DE", "name_eng"=>"Mitte"'
2,220,'SRID=4326;POINT(11 50)','"country"=>"DE", "name_eng"=>"Mitte"'
3,,'POINT(2 48)','"country"=>"FR", "name_eng"=>" "'
4,110,nowhere,'"country"=>"FR"'
""")
    (tmp_path / "links.csv").write_text("src_bus_id,dst_bus_id,voltage,circuits,length_m\n1,2,380,2,100000\n1,1,380,1,1\n1,4,380,1,1\n1,9,380,1,1\n2,3,,,\n")
    (tmp_path / "transformers.csv").write_text("src_bus_id,dst_bus_id\n1,2\n")
    (tmp_path / "generators.csv").write_text("bus_id,capacity,symbol\n1,500,Hydro Pure Storage\n2,,Wind\n3,80,'Nuclear, old'\n9,10,Gas\n")
    tail = gridkit.LOAD_TAIL
    (tmp_path / "load.csv").write_text(f"t,DE{tail},FR{tail},DE_LU{tail},XX{tail}\n" + "".join(f"{k},{100 + k % 3},{'' if k % 2 else 50},7,9\n" for k in range(1500)))
    shp, dbf = shapefile([(10.1, 50.0), (11.0, 50.5), (2.0, 48.0), (10.0, 50.0), (0.0, 0.0)]), dbase([("a", 1000, False), ("b", 2000, False), ("c", 500, False), ("d", 9999, True), ("e", 77, False)])
    places = gridkit.places_of(spark, shp, dbf)
    assert [(r["place_id"], r["population"]) for r in places.orderBy("place_id").collect()] == [(0, 1000.0), (1, 2000.0), (2, 500.0), (4, 77.0)]
    n = gridkit.load_extract(spark, f"file://{tmp_path}", f"file://{tmp_path}/load.csv", places)
    validate(n)
    assert {r["name"]: (r["country"], r["v_nom"]) for r in n["buses"].collect()} == {"Mitte": ("DE", 380.0), "Mitte 2": ("DE", 220.0), "node 3": ("FR", 0.0)}
    lines = {r["name"]: r for r in n["lines"].collect()}
    assert (lines["Mitte — Mitte 2"]["s_nom"], lines["Mitte — Mitte 2"]["susceptance"]) == (3400.0, pytest.approx(380 * 380 / 3000 * 2))
    assert (lines["Mitte 220/380 kV"]["s_nom"], lines["Mitte 220/380 kV"]["susceptance"]) == (1100.0, 400.0) and lines["Mitte 2 — node 3"]["s_nom"] == 550.0
    assert {(r["carrier"], r["p_nom"], r["marginal_cost"]) for r in n["generators"].collect()} == {("storage", 500.0, 65.0), ("nuclear", 80.0, 12.0)}
    loads = {r["bus_id"]: r["p_set"] for r in n["loads"].collect()}
    share = lambda d, *all_: (1 / max(d, 0.0025)) / sum(1 / max(x, 0.0025) for x in all_)
    w0 = 1 + 1000 * share(0.01, 0.01, 0.81) + 2000 * share(1.25, 1.25, 0.25)
    w1 = 1 + 1000 * share(0.81, 0.01, 0.81) + 2000 * share(0.25, 1.25, 0.25)
    assert loads[0] == pytest.approx(101 * w0 / (w0 + w1)) and loads[1] == pytest.approx(101 * w1 / (w0 + w1)) and 2 not in loads  # FR has 750 hours only
    with pytest.raises(SourceError, match="no shapefile"):
        gridkit.shapes_of(b"x" * 200)
    assert len(gridkit.shapes_of(shapefile([[(0, 0), (1, 0), (1, 1)]]))[0].parts[0]) == 3


def test_zone_years(spark):
    hours = spark.range(8760).selectExpr("date_format(timestamp_seconds(1483228800 + id * 3600), \"yyyy-MM-dd'T'HH:mm:ss\") utc_timestamp", "cast(id % 7 + 1 as string) load", "cast(id % 5 as string) wind", "'0' sun")
    more = hours.unionByName(hours.limit(1).selectExpr("'2016-01-01' utc_timestamp", "load", "wind", "sun"))
    got = gridkit.zone_year(more, {"Z": {"load": "load", "wind": "wind"}}, 2017)
    assert got.groupBy("kind").agg(F.max("value").alias("m"), F.count("*").alias("n")).orderBy("kind").collect() == [("load", 7.0, 8760), ("wind", 1.0, 8760)]
    for columns, message in (({"Z": {"sun": "sun"}}, "zero all year"), ({"Z": {"load": "gone"}}, "no column")):
        with pytest.raises(Exception, match=message):
            gridkit.zone_year(hours, columns, 2017).agg(F.sum("value")).collect()
    with pytest.raises(SourceError, match="whole year"):
        gridkit.zone_year(hours.limit(10), {"Z": {"load": "load"}}, 2017)
    with pytest.raises(Exception, match="a gap"):
        gridkit.zone_year(hours.withColumn("load", F.when(F.col("wind") == "3", "").otherwise(F.col("load"))), {"Z": {"load": "load"}}, 2017).agg(F.sum("value")).collect()


def test_outlines(spark):
    assert shapes.simplify([[0, 0], [1, 0.001], [2, 0], [2, 2]], 0.01).tolist() == [[0, 0], [2, 0], [2, 2]]
    assert shapes.distinct([[0, 0], [0, 0], [1, 0], [1, 1], [0, 0]]).tolist() == [[0, 0], [1, 0], [1, 1]]
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert shapes.signed_area2(square) == 8 and shapes.signed_area2(square[::-1]) == -8
    turn = np.linspace(0, 2 * np.pi, 21)[:-1]
    circle = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    looped = circle[[*range(6), 7, 6, *range(8, 20)]]
    fixed, removed, stubborn = shapes.repair(looped)
    assert shapes.crossings(looped) and not shapes.crossings(fixed) and removed >= 1 and stubborn == 0
    bow = np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)
    assert shapes.repair(bow)[2] == 1
    star = circle * np.where(np.arange(20) % 2, 0.4, 1.0)[:, None]
    for ring in (square, square[::-1], star):
        parts = shapes.triangulate(ring)
        assert len(parts) == len(ring) - 2 and sum(abs(shapes.signed_area2(ring[list(t)])) for t in parts) == pytest.approx(abs(shapes.signed_area2(ring)))
    at = shapes.spread(np.full((6, 2), np.nan), np.array([(k, (k + 1) % 6) for k in range(6)]))
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    assert np.isfinite(at).all() and far[0, 1] < far[0, 3]
    df = spark.createDataFrame([(s, n, float(x), float(y)) for s, ring in (("a", square), ("b", square[::-1])) for n, (x, y) in enumerate(ring)], "shape string, n int, x double, y double")
    assert {r["shape"]: r["area2"] for r in shapes.areas(df).collect()} == {"a": 8.0, "b": -8.0}
    assert shapes.simplified(df, 0.1).where("shape = 'a'").count() == 4
