"""Small networks whose answers are arithmetic."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feederflow.network import SMALL_ROWS, Globals, Network
from feederflow.plans import lp, simplex
from feederflow.plans.lp import Assembly, Model, row_counts, structural_faults, triplets
from feederflow.plans.merit import demand, price_and_shed
from feederflow.plans.solve import Collected, Horizon, solve, solve_many, solve_rolling
from feederflow.sources.synthetic import ring


def hours(n, w=1.0):
    return [{"t": t, "weight": w} for t in range(n)]


def stack(spark, load, n=1):
    gens = [{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 10.0 * (k + 1)} for k in range(5)]
    return Network.of(spark, Globals(value_of_lost_load=3000.0), snapshots=hours(n), buses=[{"name": "a"}], generators=gens, loads=[{"bus_id": 0, "p_set": load}])


@pytest.mark.parametrize(("load", "cost", "price", "shed"), [(250.0, 4500.0, 30.0, 0.0), (600.0, 315000.0, 3000.0, 100.0)])
def test_merit_order(spark, load, cost, price, shed):
    net = stack(spark, load)
    s = solve(net, families=())
    assert s.status == "optimal" and s.objective == pytest.approx(cost)
    assert s.prices()["value"].iloc[0] == pytest.approx(price) and s.total_shed() == pytest.approx(shed)
    row = price_and_shed(net["generators"], demand(net["loads"], net["snapshots"], net["load_profile"]), 3000.0).first()
    assert (row["price"], row["shed"]) == (price, shed)


def test_flow_divides_by_susceptance(spark):
    lines = [{"bus0": 0, "bus1": 1, "s_nom": 1e3, "susceptance": 1.0}, {"bus0": 1, "bus1": 2, "s_nom": 1e3, "susceptance": 1.0}, {"bus0": 2, "bus1": 0, "s_nom": 1e3, "susceptance": 1.0}]
    net = Network.of(spark, snapshots=hours(1), buses=[{"name": x} for x in "abc"], generators=[{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 1.0}], loads=[{"bus_id": 1, "p_set": 30.0}], lines=lines)
    s = solve(net, families=("dc_flow",))
    assert s.trajectory("flow", 0)[0] == pytest.approx(20.0)
    assert s.objective == pytest.approx(30.0)


def test_storage_carries_energy_and_loses_some(spark):
    net = Network.of(
        spark, Globals(value_of_lost_load=1000.0), snapshots=hours(2), buses=[{"name": "a"}], generators=[{"bus_id": 0, "p_nom": 200.0, "marginal_cost": 10.0}], gen_availability=[{"gen_id": 0, "t": 0, "value": 1.0}, {"gen_id": 0, "t": 1, "value": 0.0}],
        loads=[{"bus_id": 0, "p_set": 50.0}], storage_units=[{"bus_id": 0, "p_nom": 100.0, "max_hours": 4.0, "efficiency_store": 0.8, "efficiency_dispatch": 0.5, "cyclic": False}],
    )
    s = solve(net, families=("storage_balance",))
    assert s.total_shed() == pytest.approx(50 - 0.5 * 80)  # 100 MW in keeps 80 MWh, which gives 40
    assert s.objective == pytest.approx(150 * 10 + 10 * 1000)


def test_expansion_pays_from_its_break_even(spark):
    for capital, built in ((90.0, 100.0), (110.0, 0.0)):
        gens = [{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 20.0}, {"bus_id": 0, "p_nom": 0.0, "marginal_cost": 10.0, "p_nom_extendable": True, "p_nom_max": 500.0, "capital_cost": capital}]
        net = Network.of(spark, snapshots=hours(10), buses=[{"name": "a"}], generators=gens, loads=[{"bus_id": 0, "p_set": 100.0}])
        assert solve(net, families=("capacity_ties",)).built("gen_capacity", 1) == pytest.approx(built)


def test_commitment_runs_the_cheaper_start(spark):
    gens = [{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 10.0, "p_min_pu": 0.5, "committable": True, "start_up_cost": 500.0, "initially_on": False}, {"bus_id": 0, "p_nom": 100.0, "marginal_cost": 30.0}]
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": "a"}], generators=gens, loads=[{"bus_id": 0, "p_set": 20.0}])
    s = solve(net, families=("commitment_rows",))
    assert s.status == "optimal" and s.objective == pytest.approx(2 * 20 * 30)  # 50 MW at least would spill
    net = net.with_tables(loads=net["loads"].selectExpr("load_id", "bus_id", "80D as p_set"))
    assert solve(net, families=("commitment_rows",)).objective == pytest.approx(500 + 2 * 80 * 10)


def test_ramps_budget_losses_and_links_change_the_answer(spark):
    gens = [{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 1.0, "ramp_up": 0.2, "co2_emissions": 1.0}, {"bus_id": 0, "p_nom": 100.0, "marginal_cost": 50.0}]
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": "a"}], generators=gens, loads=[{"bus_id": 0, "p_set": 0.0}], load_profile=[{"load_id": 0, "t": 0, "value": 10.0}, {"load_id": 0, "t": 1, "value": 60.0}])
    assert solve(net, families=()).objective == pytest.approx(70.0)
    assert solve(net, families=("ramps",)).objective == pytest.approx(10 + 30 + 30 * 50)
    assert solve(net.set(co2_limit=20.0), families=("co2",)).objective == pytest.approx(20 + 50 * 50)
    tie = Network.of(spark, snapshots=hours(1), buses=[{"name": "a"}, {"name": "b"}], generators=[{"bus_id": 0, "p_nom": 100.0, "marginal_cost": 9.0}], loads=[{"bus_id": 1, "p_set": 45.0}], links=[{"bus0": 0, "bus1": 1, "p_nom": 100.0, "efficiency": 0.9}])
    assert solve(tie, families=()).objective == pytest.approx(50 * 9)


def test_rolling_matches_the_whole_without_coupling(spark):
    net = stack(spark, 250.0, n=5)
    r = solve_rolling(net, Horizon(3, 2))
    assert r.windows == 3 and r.objective_reported == pytest.approx(5 * 4500) == r.objective_full
    assert sorted(r.prices["t"]) == list(range(5))


def test_ring_has_the_published_shape(spark):
    net = ring(spark, 256, 168)
    m = Assembly(net).model(("dc_flow", "storage_balance"))
    assert (m.cols.count(), m.rows.count(), m.coef.count()) == (311_808, 118_272, 559_104)
    assert {r["family"]: r["rows"] for r in row_counts(m).collect()} == {"balance": 256 * 168, "dc_flow": 384 * 168, "storage": 64 * 168}


def test_numbers_are_dense_and_sound(spark):
    cols, rows, coef = triplets(Assembly(ring(spark, 12, 3)).model())
    assert [r["n"] for r in structural_faults(cols, rows, coef).collect()] == [0, 0, 0]
    assert sorted(r["col"] for r in cols.select("col").collect()) == list(range(cols.count()))
    first = rows.where("family = 'balance'").select("id", "t", "row").collect()
    assert all(r["row"] == r["id"] * 3 + r["t"] for r in first)


def gusts(spark):
    """Two units in commitment over 200 hours, one of them without wind at both ends, beside words' ends and over a whole word."""
    calm = {0, 3, 62, 63, *range(100, 195), 199}
    gens = [{"bus_id": 0, "p_nom": 100.0, "p_min_pu": 0.5, "committable": True, "min_up_time": 3, "min_down_time": 2}] * 2
    return Network.of(spark, snapshots=hours(200), buses=[{"name": "a"}], generators=gens, gen_availability=[{"gen_id": 0, "t": t, "value": float(t not in calm)} for t in range(200)], loads=[{"bus_id": 0, "p_set": 50.0}])


@pytest.mark.parametrize(("few", "there"), [(SMALL_ROWS, "true"), (0, "family <> 'status' or id = 1 or t % 70 between 5 and 63")])
def test_numbers_over_missing_snapshots_against_the_driver(spark, monkeypatch, few, there):
    monkeypatch.setattr(lp, "SMALL_ROWS", few, raising=False)  # blocks broadcast, and not
    m = Assembly(gusts(spark)).model(("commitment_rows",))
    assert m.rows.where("family = 'commitment' and id = 0 and k = 1").count() == 100
    m = Model(m.cols.where(there), m.rows, m.coef)
    whole, (cols, rows, coef) = Collected.of(m), triplets(m)
    for got, want, number in ((cols, whole.cols, "col"), (rows, whole.rows, "row")):
        assert [tuple(r) for r in got.orderBy(number).select("family", "id", "k", "t", number).collect()] == [(*r, i) for i, r in enumerate(want[["family", "id", "k", "t"]].itertuples(index=False, name=None))]
    assert sorted(tuple(r) for r in coef.collect()) == sorted(whole.coef[["row", "col", "val"]].itertuples(index=False, name=None))
    assert [r["n"] for r in structural_faults(cols, rows, coef).collect()] == [0, 0, 0]


def test_a_snapshot_twice_in_a_block_is_an_error(spark):
    rows = spark.createDataFrame([("ramp", 1, 0, t) for t in (0, 1, 1, 3)], "family string, id bigint, k int, t int")
    with pytest.raises(Exception, match="ramp 1 has a snapshot twice"):
        lp.numbered(rows, lp.ROW_ORDER, "row").collect()


def unfolded(spark):
    """Series of a row for each component, unfolded over the snapshots: to the planner, as small as the components."""
    net = Network.of(spark, snapshots=hours(50), buses=[{"name": "a"}], generators=[{"bus_id": 0, "p_nom": 100.0, "committable": True, "p_nom_extendable": True, "p_nom_max": 200.0}] * 3, loads=[{"bus_id": 0, "p_set": 50.0, "shiftable_pu": 0.1}])
    series = lambda n, key: spark.range(n).selectExpr(f"cast(id as int) {key}", "explode(sequence(0, 48)) as t", "0.5D as value")
    return net.with_tables(gen_availability=series(2, "gen_id"), load_profile=series(1, "load_id"))


def by_estimate(df):
    """The joins with a series that the driver would gather."""
    return re.findall(r"BroadcastHashJoin \[(?:gen|load|storage)_id#\d+, t#\d+\]", df._jdf.queryExecution().executedPlan().toString())


def test_dispatch_columns_do_not_gather_the_series(spark):
    df = Assembly(unfolded(spark)).dispatch()
    assert by_estimate(df) == []
    assert {(r["id"], r["t"]): r["upper"] for r in df.collect()} == {(g, t): 100.0 if g < 2 and t < 49 else 200.0 for g in range(3) for t in range(50)}


def test_columns_do_not_gather_the_series(spark):
    df = Assembly(unfolded(spark)).columns()
    assert by_estimate(df) == []
    per = {r["family"]: r["n"] for r in df.groupBy("family").agg(F.count("*").alias("n")).collect()}
    assert per == {"dispatch": 150, "gen_capacity": 3, "status": 150, "start_up": 150, "shut_down": 150, "load_shift": 50, "shed": 50}


def test_rows_do_not_gather_the_series_and_entries_are_the_triplets(spark):
    m = Assembly(unfolded(spark)).model(("commitment_rows", "capacity_ties", "shift"))
    assert by_estimate(m.rows) == by_estimate(m.coef) == []
    _, rows, coef = triplets(m)
    want = coef.join(rows.select("row", "family"), "row").select("family", "row", "col", "val")
    assert sorted(map(tuple, lp.entries(m).collect())) == sorted(map(tuple, want.collect()))


def test_simplex_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a = rng.integers(-3, 6, (3, 5)).astype(float)
        p = simplex.Problem(a, np.zeros(5), np.full(5, 3.0), rng.integers(-9, 5, 5).astype(float), np.full(3, -np.inf), rng.integers(3, 15, 3).astype(float))
        grid = np.stack(np.meshgrid(*[np.arange(4)] * 5), -1).reshape(-1, 5)
        ok = (grid @ a.T <= p.row_upper + 1e-9).all(axis=1)
        m = simplex.solve_mip(p, np.ones(5, bool))
        assert m.proved and m.best.objective == pytest.approx((grid[ok] @ p.obj).min())


def test_infeasible_and_unbounded():
    one = np.ones((1, 1))
    assert simplex.solve(simplex.Problem(one, np.zeros(1), np.ones(1), np.ones(1), np.array([2.0]), np.array([3.0]))).status == "infeasible"
    assert simplex.solve(simplex.Problem(one, np.zeros(1), np.array([np.inf]), -np.ones(1), np.array([0.0]), np.array([np.inf]))).status == "unbounded"


def test_many_models_at_once(spark):
    cols = spark.createDataFrame([(m, 0, 0.0, 10.0, float(m), False) for m in (1, 2)], "model_id int, col bigint, lower double, upper double, obj double, is_int boolean")
    rows = spark.createDataFrame([(m, 0, 4.0, float("inf")) for m in (1, 2)], "model_id int, row bigint, lower double, upper double")
    coef = spark.createDataFrame([(m, 0, 0, 2.0) for m in (1, 2)], "model_id int, row bigint, col bigint, val double")
    got = {r["model_id"]: (r["status"], r["objective"]) for r in solve_many(cols, rows, coef).collect()}
    assert got == {1: ("optimal", 2.0), 2: ("optimal", 4.0)}
