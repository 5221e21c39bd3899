"""Readers on small inputs of our own."""

import pytest

from feederflow.functions.scalars import fuzzy_score
from feederflow.operators.validate import NetworkError, validate
from feederflow.sources import cases
from feederflow.sources.draft import SourceError
from feederflow.sources.tables import load_csv, parse_csv, tranches

CASE = """function mpc = three
mpc.baseMVA = 100;
mpc.bus = [
 1 3 0 0 0 0 1 1 0 230 1 1.1 0.9; % slack
 2 1 50 10 0 0 1 1 0 230 1 1.1 0.9;
 7 1 0 0 1 0 1 1 0 230 1 1.1 0.9;
];
mpc.gen = [ 1 0 0 30 -30 1 100 1 80 20; 2 0 0 30 -30 1 100 0 80 0 ];
mpc.gencost = [ 2 0 0 3 0.01 12 5; 2 0 0 3 0 1 0 ];
mpc.branch = [ 1 2 0.01 0.1 0 0 0 0 0 0 1 -360 360; 2 7 0 0 0 40 0 0 0 0 1 -360 360; 1 7 0 0.2 0 40 0 0 0 0 0 -360 360 ];
"""


def test_matpower(spark):
    assert cases.sniff_text(CASE) == "matpower"
    n = cases.matpower(spark, CASE)
    g = n["generators"].collect()
    assert [(r["p_nom"], r["marginal_cost"], r["p_min_pu"]) for r in g] == [(80.0, 12.0, 0.25)]
    lines = n["lines"].orderBy("line_id").collect()
    assert [(r["s_nom"], r["susceptance"]) for r in lines] == [(1e6, 10.0), (40.0, 0.0)]
    assert {r["name"]: r["synchronous_area"] for r in n["buses"].collect()} == {"bus1": "sync0", "bus2": "sync0", "bus7": "sync2"}
    with pytest.raises(SourceError):
        cases.matpower(spark, CASE.replace(" 2 7 0 0", " 2 9 0 0"))


def test_csv_folder_and_json(spark, tmp_path):
    d = tmp_path / "net"
    d.mkdir()
    (d / "buses.csv").write_text("name,country,x,y\na,DE,9,53\n\"b, c\",FR,2,48\n")
    (d / "generators.csv").write_text("Name,bus,p_nom,p_nom_max,committable\ng1,a,100,inf,yes\ng2,\"b, c\",50,,\n")
    (d / "loads.csv").write_text("name,bus,p_set,value_tranches\nl1,a,70,30@200;x;20@500\n")
    (d / "snapshots.csv").write_text("weight\n1\n2\n")
    (d / "gen_availability.csv").write_text("G1,g2\n0.5,\n1,0.25\n")
    (d / "co2_limit.txt").write_text("12.5\n")
    n = load_csv(spark, f"file://{d}")
    validate(n)
    assert n.settings.co2_limit == 12.5
    assert sorted(map(tuple, n["gen_availability"].collect())) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.25)]
    assert [tuple(x) for x in n["loads"].first()["value_tranches"]] == [(30.0, 200.0), (20.0, 500.0)]
    again = cases.native_json(spark, cases.to_native_json(n))
    for t in ("buses", "generators", "loads", "gen_availability"):
        assert sorted(map(str, n[t].collect())) == sorted(map(str, again[t].collect()))
    (d / "generators.csv").write_text("name,bus\ng1,nowhere\n")
    with pytest.raises(SourceError, match="generators row 1"):
        load_csv(spark, f"file://{d}")


def test_violation_comes_first(spark):
    from feederflow.network import Network

    n = Network.of(spark, snapshots=[{"t": 0}], buses=[{"name": "a"}], generators=[{"bus_id": 0, "p_nom": -1.0}, {"bus_id": 5}], lines=[{"bus0": 0, "bus1": 0}])
    with pytest.raises(NetworkError) as e:
        validate(n)
    assert (e.value.code, e.value.component) == ("generator_bus", 1)


def test_small_things():
    assert tranches("30@200;20@500;oops;0@9") == [(30.0, 200.0), (20.0, 500.0)]
    assert parse_csv('a,b\n"x ""y""",2\n\n3\n', "t") == [{"a": 'x "y"', "b": "2"}, {"a": "3", "b": ""}]
    with pytest.raises(SourceError):
        parse_csv("a\n1,2\n", "t")
    assert cases.sniff_text("0, 100.0, 33 / case") == "psse" and cases.sniff_text("##C 2007") == "ucte"
    assert fuzzy_score("ber", "Berlin") > fuzzy_score("ber", "Oberursel") and fuzzy_score("xyz", "Berlin") is None
