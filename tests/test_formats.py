"""Single-file formats on small cases of our own, and cases written and read again."""

import io
import json
import math
import zipfile

import pytest

from feederflow.network import Globals, Network
from feederflow.sources import cases, cgmes, writers
from feederflow.sources.draft import SourceError
from feederflow.sources.psse import fields, tap_ratio
from feederflow.sources.tables import load_csv, load_parquet, write_csv

RAW = """0, 50.0, 33, 0, 0, 50.0 / a case of our own
ONE
TWO
11,'North, 1',400.0,3,7,1,1,1.0,0.0,1.08,0.92
12,'South',400.0,1,7
13,'Town',110.0,1,8
14,'Gone',110.0,4,8
0 / END OF BUS DATA, BEGIN LOAD DATA
13,'1',1,1,1,30.0,5.0
13,'2',1,1,1,12.5,1.0,0.0,0.0,2.0
12,'1',0,1,1,99.0,9.0
14,'1',1,1,1,99.0,9.0
0 / END OF LOAD DATA, BEGIN FIXED SHUNT DATA
0 / END OF FIXED SHUNT DATA, BEGIN GENERATOR DATA
11,'A',10,0,40,-20,1.0,0,100,0,1,0,0,1,1,100,200,50
11,'B',10,0,40,-20,1.0,0,100,0,1,0,0,1,0,100,200,50
0 / END OF GENERATOR DATA, BEGIN BRANCH DATA
11,-12,'1',0.01,0.1,0.02,80,80,80,0,0,0,0,1
12,12,'1',0.01,0.1
11,12,'2',0.0,0.0
11,14,'1',0.01,0.1
0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA
12,13,0,'1',2,2,1,0,0,2,'T one',1,1,1
0.01,0.2,25.0
410.0,0,0,60
110.0,0
11,12,13,'1',1,1,1,0,0,2,'T three',1,1,1
0.01,0.10,50,0.02,0.20,50,0.03,0.30,50
1.0,0,0,90
1.0,0,0,91
1.0,0,0,92
0 / END OF TRANSFORMER DATA, BEGIN AREA DATA
0 / END OF AREA DATA, BEGIN TWO-TERMINAL DC DATA
'tie',1,1.0,-150
11,1
13,1
'off',0,1.0,150
11,1
13,1
0 / END OF TWO-TERMINAL DC DATA, BEGIN OTHER DATA
1,2,3
Q
"""


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_psse(spark):
    assert cases.sniff_text(RAW) == "psse" and fields("1,'a/b, c' , 2 / note") == ["1", "a/b, c", "2"]
    n = cases.load_bytes(spark, RAW.encode(), "x.raw")
    buses, lines = by_name(n["buses"]), by_name(n["lines"])
    assert set(buses) == {"North, 1", "South", "Town", "T three_star"} and n.settings.base_mva == 50.0
    assert (buses["North, 1"]["v_max"], buses["North, 1"]["country"], buses["South"]["v_max"]) == (1.08, "area7", 1.1)
    assert [(r["p_set"], r["q_set"]) for r in n["loads"].collect()] == [(42.5, 6.0)]  # summed by bus
    assert [(r["name"], r["p_nom"], r["p_min_pu"], r["q_min"]) for r in n["generators"].collect()] == [("gen11_A", 200.0, 0.25, -20.0)]
    assert (lines["11-12-1"]["susceptance"], lines["11-12-1"]["s_nom"], lines["11-12-2"]["susceptance"]) == (10.0, 80.0, 0.0)
    t = lines["T one"]
    assert (t["resistance"], t["reactance"], t["tap_ratio"], t["s_nom"]) == (0.02, 0.4, 410 / 400, 60.0)  # from 25 to 50 MVA
    assert [round(lines[f"T three_w{k}"]["reactance"], 9) for k in (1, 2, 3)] == [0.1, 0.0, 0.2]
    assert (lines["dc_tie"]["s_nom"], lines["dc_tie"]["susceptance"]) == (150.0, 0.0) and "dc_off" not in lines
    assert any("1 voltage-dependent" in x for x in n.notes) and any("self-loop" in x for x in n.notes)
    assert tap_ratio(3, (400.0, 110.0), (1.05, 1.0), (420.0, 0.0)) == pytest.approx(1.05 * 420 / 400)
    with pytest.raises(SourceError, match="breaks off"):
        cases.load_bytes(spark, RAW.replace("1.0,0,0,92\n", "").encode(), "x.raw")


def test_old_raw_has_other_columns(spark):
    text = "0,100.0\nA\nB\n1,'X',220,3,0,0,4\n2,'Y',220,1,0,0,5\n0\n2,'1',1,1,1,9,3\n0\n0\n1,2,'1',0,0.05,0,70,0,0,1.02,0,0,0,0,0,1\n1,2,'2',0,0.05,0,70,0,0,0,0,0,0,0,0,0\n0\nQ\n"
    n = cases.psse(spark, text.replace("0,100.0", "0,100.0,29"))
    (line,) = n["lines"].collect()
    assert (line["tap_ratio"], line["susceptance"]) == (1.02, pytest.approx(20.0)) and by_name(n["buses"])["Y"]["country"] == "area5"


def test_rawx(spark):
    section = lambda names, *rows: {"fields": names.split(), "data": list(map(list, rows))}
    doc = {"network": {
        "caseid": {"fields": ["sbase"], "data": [10.0]},
        "bus": section("ibus name baskv ide area nvhi nvlo", (1, "A", 220, 3, 2, 1.05, 0.95), (2, "", 110, 1, 2, None, None), (3, "off", 110, 4, 2, None, None)),
        "load": section("ibus stat pl ql", (2, 1, 8, 2), (2, 1, 1, 0), (2, 0, 50, 0)),
        "fixshunt": section("ibus gl bl", (2, 1, 5)),
        "generator": section("ibus machid stat pt pb qt qb", (1, "1", 1, 40, 10, 5, -5)),
        "acline": section("ibus jbus ckt rpu xpu bpu rate1 stat", (1, 2, "1", 0.1, 0.5, 0.0, 33, 1), (1, 3, "1", 0.1, 0.5, 0.0, 33, 1)),
        "transformer": section("ibus jbus kbus name stat cz cw sbase1_2 r1_2 x1_2 windv1 windv2 rate1_1 ang1", (1, 2, 0, "T", 1, 2, 2, 5, 0.0, 0.1, 231, 110, 20, 30), (1, 2, 3, "W", 1, 1, 1, 5, 0, 0.1, 1, 1, 20, 0)),
    }}
    text = json.dumps(doc)
    assert cases.sniff_text(text) == "rawx"
    n = cases.load_bytes(spark, text.encode())
    lines, buses = by_name(n["lines"]), by_name(n["buses"])
    assert (lines["T"]["reactance"], lines["T"]["tap_ratio"], lines["T"]["phase_shift"]) == (pytest.approx(0.2), pytest.approx(231 / 220), pytest.approx(math.pi / 6))
    assert lines["1-2-1"]["s_nom"] == 33.0 and set(lines) == {"T", "1-2-1"}
    assert (buses["bus2"]["b_shunt"], buses["A"]["v_max"]) == (0.5, 1.05) and n["loads"].first()["p_set"] == 9.0


def test_powermodels(spark):
    doc = {
        "baseMVA": 100.0, "per_unit": True, "bus": {"1": {"bus_i": 1, "area": 1, "vmax": 1.1, "vmin": 0.9}, "2": {"bus_i": 2, "bus_type": 1}, "10": {"bus_i": 10, "bus_type": 4}},
        "load": {"1": {"load_bus": 2, "pd": 0.5, "qd": 0.1}, "2": {"load_bus": 2, "pd": 9, "status": 0}}, "gen": {"1": {"gen_bus": 1, "pmax": 2.0, "pmin": 0.5, "cost": [1.0, 1200.0, 0.0], "qmax": 0.3}},
        "branch": {"1": {"f_bus": 1, "t_bus": 2, "br_r": 0.01, "br_x": 0.25, "b_fr": 0.1, "b_to": 0.1, "rate_a": 0.75}, "2": {"f_bus": 1, "t_bus": 10, "br_x": 1}}, "dcline": {"1": {"f_bus": 1, "t_bus": 2, "pmaxf": 0.4, "pmaxt": -0.6}},
    }
    n = cases.load_bytes(spark, json.dumps(doc).encode())
    g, lines = n["generators"].first(), by_name(n["lines"])
    assert (g["p_nom"], g["p_min_pu"], g["marginal_cost"], g["q_max"], g["q_min"]) == (200.0, 0.25, 12.0, 30.0, float("-inf"))
    assert (lines["branch1"]["susceptance"], lines["branch1"]["s_nom"], lines["branch1"]["shunt_susceptance"]) == (4.0, 75.0, 0.2) and lines["dcline1"]["s_nom"] == 60.0
    assert n["loads"].first()["p_set"] == 50.0 and n["buses"].count() == 2


def put(width, **at):
    """A line with texts at columns, from 1."""
    line = [" "] * width
    for column, text in at.items():
        line[int(column[1:]) - 1 : int(column[1:]) - 1 + len(text)] = text
    return "".join(line)


def test_cdf(spark):
    bus = lambda number, name, kind, load, made, **more: put(122, c1=f"{number:4d}", c6=name, c19=" 1", c25=f"{kind:2d}", c41=f"{load:9.1f}", c60=f"{made:8.1f}", c77="  132.0", **more)
    rows = [put(80, c32="  50.0", c39="1999", c44="W", c46="own case"), "BUS DATA FOLLOWS", bus(1, "ONE", 3, 0, 60.0, c91="    40.0", c99="   -40.0"), bus(2, "TWO", 1, 25.5, 0, c91="    1.05", c99="    0.95", c115="    0.19"), "-999", "BRANCH DATA FOLLOWS"]
    rows += [put(90, c1="   1", c6="   2", c17="1", c20="  0.01", c30="    0.2", c41="   0.03", c77=" 0.98", c84="   30.0"), "-999", "LOSS ZONES FOLLOWS", "1 A", "-99", "END OF DATA"]
    text = "\n".join(rows)
    assert cases.sniff_text(text) == "cdf"
    n = cases.load_bytes(spark, text.encode(), "x.txt")
    line, buses = n["lines"].first(), by_name(n["buses"])
    assert (line["susceptance"], line["tap_ratio"], line["s_nom"], line["phase_shift"]) == (5.0, 0.98, 1e6, pytest.approx(math.pi / 6))
    assert (buses["TWO"]["v_max"], buses["TWO"]["b_shunt"], buses["ONE"]["v_max"]) == (1.05, 0.19, 1.1) and n.settings.base_mva == 50.0
    assert [(r["p_nom"], r["q_max"]) for r in n["generators"].collect()] == [(60.0, 40.0)] and n["loads"].first()["p_set"] == 25.5
    with pytest.raises(SourceError, match="columns 30-40"):
        cases.cdf(spark, text.replace("    0.2", "    x.2"))


def test_ucte(spark):
    node = lambda code, **more: put(96, c1=code, c23="0", c27="400.00", **more)
    text = "\n".join([
        "##C 2020", "note", "##N", "##ZAA", node("AXX___11", c50=" -300.0", c66=" -500.0", c74=" -100.0", c90="  200.0"), node("AYY___11", c34="  120.0", c42="   30.0"), node("AZZ___51"), "##ZBB", node("BXX___21"),
        "##L", put(60, c1="AXX___11", c10="AYY___11", c19="1", c21="0", c23="  1.44", c30=" 14.44", c37="   10.00", c46="  1000"), put(60, c1="AXX___11", c10="AYY___11", c19="2", c21="8", c30=" 14.44"),
        "##T", put(76, c1="AYY___11", c10="AZZ___51", c19="1", c21="0", c23="380.0", c29="110.0", c35=" 200.", c41="  0.00", c48=" 12.10"),
        "##R", put(70, c1="AYY___11", c10="AZZ___51", c19="1", c21=" 2.00", c31="  5", c41=" 1.00", c47="90.00", c57=" 10", c67="ASYM"),
        "##TT", put(40, c1="AYY___11", c10="AZZ___51", c19="1", c21="  5", c25="  0.00", c32=" 24.20"),
    ])
    assert cases.sniff_text(text) == "ucte"
    n = cases.load_bytes(spark, text.encode(), "x.uct")
    lines, g = by_name(n["lines"]), n["generators"].first()
    assert (g["p_nom"], g["p_min_pu"], g["q_min"], g["q_max"]) == (500.0, 0.2, -200.0, float("inf"))
    line = lines["AXX___11-AYY___11-1"]
    assert (line["resistance"], line["reactance"], line["s_nom"]) == (pytest.approx(1.44 / 1444), pytest.approx(0.01), pytest.approx(math.sqrt(3) * 380)) and len(lines) == 2
    t = lines["AYY___11-AZZ___51-1"]
    size = 1.1 * abs(1 + 0.1j)
    assert (t["reactance"], t["tap_ratio"], t["phase_shift"], t["s_nom"]) == (pytest.approx(0.2), pytest.approx(1 / size), pytest.approx(-math.atan2(0.1, 1)), 200.0)
    assert {r["name"]: r["country"] for r in n["buses"].collect()}["BXX___21"] == "BB"


def sample(spark):
    return Network.of(
        spark, Globals(base_mva=100.0, co2_limit=7.5), snapshots=[{"t": 0, "weight": 1.0}, {"t": 1, "weight": 2.0}],
        buses=[{"name": 'a "quoted"', "country": "DE", "v_nom": 380.0, "x": 1.0, "y": 50.0}, {"name": "b, c", "country": "FR", "v_nom": 380.0, "x": 2.0, "y": 51.0}, {"name": "d\\e", "v_nom": 110.0, "g_shunt": 0.1, "x": 0.0, "y": 0.0}],
        generators=[{"name": "g 'one'", "bus_id": 0, "p_nom": 100.0, "marginal_cost": 12.0, "p_min_pu": 0.25, "q_max": 30.0, "carrier": "hydro"}, {"name": "g2", "bus_id": 1, "p_nom": 50.0}],
        lines=[{"name": "l1", "bus0": 0, "bus1": 1, "s_nom": 70.0, "susceptance": 5.0, "reactance": 0.2, "resistance": 0.01}, {"name": "l2", "bus0": 1, "bus1": 2, "s_nom": 1e6, "susceptance": 4.0, "reactance": 0.25, "tap_ratio": 1.05}],
        loads=[{"name": "d1", "bus_id": 1, "p_set": 40.0, "q_set": 4.0, "value_tranches": [(30.0, 200.0), (5.0, 500.0)]}], load_profile=[{"load_id": 0, "t": 0, "value": 35.0}, {"load_id": 0, "t": 1, "value": 45.0}],
        links=[{"name": "k", "bus0": 0, "bus1": 2, "p_nom": 9.0, "efficiency": 0.9}], storage_units=[{"name": "s1", "bus_id": 0, "p_nom": 5.0, "downstream_id": 1}, {"name": "s2", "bus_id": 1, "p_nom": 6.0}],
    )


def same(a, b, table, *but):
    cols = [c for c in a[table].columns if c not in but]
    assert sorted(map(str, a[table].select(*cols).collect())) == sorted(map(str, b[table].select(*cols).collect()))


def test_folders_come_back(spark, tmp_path):
    n = sample(spark)
    write_csv(n, f"file://{tmp_path}/csv")
    writers.write_parquet(n, f"file://{tmp_path}/parquet")
    for folder, load in (("csv", load_csv), ("parquet", load_parquet)):
        again = load(spark, f"file://{tmp_path}/{folder}")
        for table in ("buses", "generators", "lines", "links", "loads", "storage_units", "load_profile", "snapshots"):
            same(n, again, table)
        assert cases.sniff_path(spark, f"file://{tmp_path}/{folder}") == folder
    assert load_csv(spark, f"file://{tmp_path}/csv").settings.co2_limit == 7.5
    any_of = cases.load_any(spark, f"file://{tmp_path}/csv")
    assert any_of.notes[0] == "read as CSV folder"
    writers.write_pypsa(n, f"file://{tmp_path}/pypsa")
    x = {r["name"]: float(r["x"]) for r in spark.read.csv(f"file://{tmp_path}/pypsa/lines.csv", header=True).collect()}
    assert x["l1"] == pytest.approx(0.2 * 380 * 380 / 100)


def test_profile_rows_keep_their_order(spark, tmp_path):
    n = 5000
    (tmp_path / "buses.csv").write_text("name\na\n")
    (tmp_path / "loads.csv").write_text("name,bus,p_set\nd,a,1\n")
    (tmp_path / "snapshots.csv").write_text("weight\n" + "1\n" * n)
    (tmp_path / "load_profile.csv").write_text("D\n" + "".join(f"{k * 3 % n}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["t"]: r["value"] for r in load_csv(spark, f"file://{tmp_path}")["load_profile"].collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: float(k * 3 % n) for k in range(n)}
    (tmp_path / "load_profile.csv").write_text("D\n1\n")
    with pytest.raises(SourceError, match="1 rows for 5000"):
        load_csv(spark, f"file://{tmp_path}")


def test_case_texts_come_back(spark):
    n = sample(spark)
    m = writers.to_matpower(n)
    again = cases.load_bytes(spark, m.text.encode(), "x.m")
    assert [(r["p_nom"], r["marginal_cost"], r["p_min_pu"]) for r in again["generators"].orderBy("gen_id").collect()] == [(100.0, 12.0, 0.25), (50.0, 0.0, 0.0)]
    assert [(r["s_nom"], r["susceptance"], r["tap_ratio"]) for r in again["lines"].orderBy("line_id").collect()] == [(70.0, 5.0, 1.0), (1e6, 4.0, 1.05)]
    assert again["loads"].first()["p_set"] == 35.0 and any("first of 2" in x for x in m.notes) and any("storage" in x for x in m.notes)
    p = writers.to_psse(n, "own")
    again = cases.load_bytes(spark, p.text.encode(), "x.raw")
    lines = again["lines"].orderBy("line_id").collect()
    assert [(r["s_nom"], r["susceptance"], r["tap_ratio"]) for r in lines] == [(70.0, 5.0, 1.0), (1e6, 4.0, 1.05)]
    assert again["loads"].first()["p_set"] == 35.0 and any("no costs" in x for x in p.notes)


EQ = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="http://iec.ch/TC57/2013/CIM-schema-cim16#">
<cim:BaseVoltage rdf:ID="_v"><cim:BaseVoltage.nominalVoltage>220</cim:BaseVoltage.nominalVoltage></cim:BaseVoltage>
<cim:VoltageLevel rdf:ID="_level"><cim:VoltageLevel.BaseVoltage rdf:resource="#_v"/></cim:VoltageLevel>
<cim:ACLineSegment rdf:ID="_l"><cim:IdentifiedObject.name>wire &amp; more</cim:IdentifiedObject.name><cim:Equipment.EquipmentContainer rdf:resource="#_level"/><cim:ACLineSegment.r>4.84</cim:ACLineSegment.r><cim:ACLineSegment.x>48.4</cim:ACLineSegment.x></cim:ACLineSegment>
<cim:ACLineSegment rdf:ID="_off"><cim:ConductingEquipment.BaseVoltage rdf:resource="#_v"/><cim:ACLineSegment.x>48.4</cim:ACLineSegment.x></cim:ACLineSegment>
<cim:Terminal rdf:ID="_t1"><cim:ACDCTerminal.sequenceNumber>1</cim:ACDCTerminal.sequenceNumber><cim:Terminal.ConductingEquipment rdf:resource="#_l"/></cim:Terminal>
<cim:Terminal rdf:ID="_t2"><cim:ACDCTerminal.sequenceNumber>2</cim:ACDCTerminal.sequenceNumber><cim:Terminal.ConductingEquipment rdf:resource="#_l"/></cim:Terminal>
<cim:Terminal rdf:ID="_t3"><cim:Terminal.ConductingEquipment rdf:resource="#_g"/></cim:Terminal><cim:Terminal rdf:ID="_t4"><cim:Terminal.ConductingEquipment rdf:resource="#_d"/></cim:Terminal>
<cim:OperationalLimitSet rdf:ID="_s"><cim:OperationalLimitSet.Terminal rdf:resource="#_t1"/></cim:OperationalLimitSet>
<cim:CurrentLimit rdf:ID="_c1"><cim:OperationalLimit.OperationalLimitSet rdf:resource="#_s"/><cim:CurrentLimit.value>1000</cim:CurrentLimit.value></cim:CurrentLimit>
<cim:ActivePowerLimit rdf:ID="_c2"><cim:OperationalLimit.OperationalLimitSet rdf:resource="#_s"/><cim:ActivePowerLimit.value>900</cim:ActivePowerLimit.value></cim:ActivePowerLimit>
<cim:HydroGeneratingUnit rdf:ID="_u"><cim:GeneratingUnit.maxOperatingP>80</cim:GeneratingUnit.maxOperatingP><cim:GeneratingUnit.minOperatingP>20</cim:GeneratingUnit.minOperatingP></cim:HydroGeneratingUnit>
<cim:SynchronousMachine rdf:ID="_g"><cim:IdentifiedObject.name>G</cim:IdentifiedObject.name><cim:RotatingMachine.GeneratingUnit rdf:resource="#_u"/></cim:SynchronousMachine>
<cim:ConformLoad rdf:ID="_d"><cim:IdentifiedObject.name>D</cim:IdentifiedObject.name></cim:ConformLoad></rdf:RDF>"""
_DOC = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="http://iec.ch/TC57/2013/CIM-schema-cim16#">{}</rdf:RDF>'
TP = _DOC.format(
    "".join(f'<cim:TopologicalNode rdf:ID="_n{k}"><cim:IdentifiedObject.name>n{k}</cim:IdentifiedObject.name><cim:TopologicalNode.BaseVoltage rdf:resource="#_v"/></cim:TopologicalNode>' for k in (1, 2))
    + "".join(f'<cim:Terminal rdf:about="#_t{t}"><cim:Terminal.TopologicalNode rdf:resource="#_n{n}"/></cim:Terminal>' for t, n in ((1, 2), (2, 1), (3, 1), (4, 2)))
)
SSH = _DOC.format('<cim:ConformLoad rdf:about="#_d"><cim:EnergyConsumer.p>33</cim:EnergyConsumer.p><cim:EnergyConsumer.q>3</cim:EnergyConsumer.q></cim:ConformLoad><cim:ACLineSegment rdf:about="#_off"><cim:Equipment.inService>false</cim:Equipment.inService></cim:ACLineSegment>')
SV = _DOC.format('<cim:SvVoltage rdf:ID="_sv"><cim:SvVoltage.TopologicalNode rdf:resource="#_n2"/><cim:SvVoltage.v>231</cim:SvVoltage.v><cim:SvVoltage.angle>-30</cim:SvVoltage.angle></cim:SvVoltage><cim:SvPowerFlow rdf:ID="_sp"><cim:SvPowerFlow.Terminal rdf:resource="#_t2"/><cim:SvPowerFlow.p>17</cim:SvPowerFlow.p></cim:SvPowerFlow>')


def test_cgmes(spark, tmp_path):
    files = {"m_EQ.xml": EQ, "m_TP.xml": TP, "m_SSH.xml": SSH, "m_SV.xml": SV}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert cases.sniff_path(spark, f"file://{tmp_path}") == "cgmes"
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("part.zip", inner.getvalue())
    for n in (cases.load_any(spark, f"file://{tmp_path}"), cases.load_files(spark, {k: v.encode() for k, v in files.items()}), cases.load_bytes(spark, outer.getvalue(), "x.zip")):
        (line,) = n["lines"].collect()
        assert (line["name"], line["bus0"], line["bus1"]) == ("wire & more", 1, 0)
        assert (line["resistance"], line["reactance"], line["s_nom"]) == (pytest.approx(0.01), pytest.approx(0.1), pytest.approx(math.sqrt(3) * 220))  # amperes are tighter than 900 MW
        g, d = n["generators"].first(), n["loads"].first()
        assert (g["p_nom"], g["p_min_pu"], g["carrier"], g["bus_id"]) == (80.0, 0.25, "hydro", 0) and (d["p_set"], d["bus_id"]) == (33.0, 1)
        assert {r["synchronous_area"] for r in n["buses"].collect()} == {"sync0"}
    c = cgmes.case(spark, spark.read.format("binaryFile").load(f"file://{tmp_path}/*.xml"))
    assert [(r["bus_id"], r["v_pu"], round(r["angle"], 6)) for r in cgmes.bus_voltages(c).collect()] == [(1, 1.05, round(-math.pi / 6, 6))]
    assert [tuple(r) for r in cgmes.power_flows(c).collect()] == [("line", 0, 1, 17.0, 0.0)]
    assert tuple(cgmes.covered(c).first()) == (1, 1) and cgmes.controls(c).count() == 0
    with pytest.raises(Exception, match="TopologicalNode"):
        cgmes.case(spark, spark.createDataFrame([("x", bytearray(SSH.encode()))], "path string, content binary"))


def test_cgmes_comes_back(spark, tmp_path):
    n = sample(spark)
    volts = spark.createDataFrame([(0, 390.0, 1.5)], "bus_id int, v_kv double, angle double")
    cgmes.write(n, f"file://{tmp_path}/out", "m", volts)
    c = cgmes.case(spark, spark.read.format("binaryFile").load(f"file://{tmp_path}/out/*.xml"))
    lines = by_name(c.network["lines"])
    assert lines["l1"]["reactance"] == pytest.approx(0.2) and lines["l1"]["s_nom"] == 70.0
    assert lines["l2"]["reactance"] == pytest.approx(0.25) and lines["l2"]["tap_ratio"] == pytest.approx(1.05) and lines["l2"]["s_nom"] == 1e6
    g = by_name(c.network["generators"])
    assert (g["g 'one'"]["p_nom"], g["g 'one'"]["p_min_pu"], g["g 'one'"]["carrier"], g["g 'one'"]["q_max"]) == (100.0, 0.25, "hydro", 30.0) and g["g2"]["carrier"] == "unknown"
    assert {r["name"]: r["v_nom"] for r in c.network["buses"].collect()} == {'a "quoted"': 380.0, "b, c": 380.0, "d\\e": 110.0}
    assert c.network["loads"].first()["p_set"] == 40.0 and cgmes.bus_voltages(c).first()["v_pu"] == pytest.approx(390 / 380)


def test_workbook_and_memory(spark):
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(c for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    text, num, shared = (lambda r, s: f'<c r="{r}" t="inlineStr"><is><t>{s}</t></is></c>'), (lambda r, v: f'<c r="{r}"><v>{v}</v></c>'), (lambda r, k: f'<c r="{r}" t="s"><v>{k}</v></c>')
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name=" Buses " r:id="r1"/><sheet name="loads" r:id="r2"/><sheet name="snapshots" r:id="r3"/><sheet name="load_profile" r:id="r4"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in (1, 2, 3, 4)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>a</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", sheet([[shared("A1", 0), text("C1", "v_nom")], [shared("A2", 1), num("C2", 220)], []]))
        z.writestr("xl/worksheets/s2.xml", sheet([[text("A1", "name"), text("B1", "bus"), text("C1", "p_set")], [text("A2", "d"), text("B2", "a"), num("C2", 5.5)]]))
        z.writestr("xl/worksheets/s3.xml", sheet([[text("A1", "weight")], [num("A2", 1)], [num("A3", 2)]]))
        z.writestr("xl/worksheets/s4.xml", sheet([[text("A1", "D")], [num("A2", 7)], [num("A3", 8)]]))
    n = cases.load_bytes(spark, book.getvalue(), "x.xlsx")
    assert (n["buses"].first()["v_nom"], n["loads"].first()["p_set"]) == (220.0, 5.5) and sorted(r["value"] for r in n["load_profile"].collect()) == [7.0, 8.0]
    again = cases.load_files(spark, {"net/buses.csv": b"name\na\n", "net/loads.csv": b"name,bus,p_set\nd,a,5.5\n", "net/co2_price.txt": b"3"})
    assert again["loads"].first()["p_set"] == 5.5 and again.settings.co2_price == 3.0
    with pytest.raises(SourceError, match="library"):
        cases.load_bytes(spark, b"\x89HDF....", "x.nc")
    assert cases.sniff_bytes(b"PAR1...") == "parquet" and not cases.Format.NETCDF.available and cases.Format("ucte").label == "UCTE-DEF"
    with pytest.raises(SourceError, match="no known format"):
        cases.load_bytes(spark, b"hello")
