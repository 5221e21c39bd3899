"""Values that SQL cannot express against plain versions, and families of rows that change an optimum."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feederflow.functions.scalars import cut_name, fuzzy_score, quoted_fields
from feederflow.network import Globals, Network
from feederflow.operators import accounting, reductions, topology
from feederflow.plans import account, cuts, simplex
from feederflow.plans.basis import Columns, Factors
from feederflow.plans.lp import Assembly, triplets
from feederflow.plans.solve import Horizon, solve, solve_head_iterated, solve_rolling
from feederflow.sources.synthetic import ring


def hours(n):
    return [{"t": t} for t in range(n)]


def meshed(spark, n=7, extra=5, seed=0):
    rng = np.random.default_rng(seed)
    ends = [(k, (k + 1) % n) for k in range(n)] + [tuple(rng.choice(n, 2, replace=False)) for _ in range(extra)]
    lines = [{"bus0": int(a), "bus1": int(b), "susceptance": float(rng.integers(1, 9)), "s_nom": 50.0} for a, b in ends]
    lines += [{"bus0": 0, "bus1": n, "susceptance": 2.0, "s_nom": 50.0}, {"bus0": 1, "bus1": n, "susceptance": 0.0, "s_nom": 9.0}]  # a stub, and a corridor beside it
    return Network.of(spark, snapshots=hours(1), buses=[{"name": f"b{k}"} for k in range(n + 1)], lines=lines)


def flows(lines, n, injected):
    b = np.zeros((n, n))
    for r in lines:
        i, j, y = r["bus0"], r["bus1"], r["susceptance"]
        b[[i, j], [i, j]] += y
        b[[i, j], [j, i]] -= y
    angle = np.zeros(n)
    angle[1:] = np.linalg.solve(b[1:, 1:], injected[1:])
    return np.array([r["susceptance"] * (angle[r["bus0"]] - angle[r["bus1"]]) for r in lines])


def test_outage_factors_predict_the_flows_after_an_outage(spark):
    net = meshed(spark)
    lines = [r for r in net["lines"].orderBy("line_id").collect() if r["susceptance"] > 0]
    areas = topology.synchronous_areas(net["buses"], net["lines"])
    got = {(r["monitored"], r["outaged"]): r for r in topology.outage_factors(net["lines"], areas).collect()}
    assert len(got) == len(lines) * (len(lines) - 1)
    injected = np.random.default_rng(1).standard_normal(8)
    injected -= injected.mean()
    before = flows(lines, 8, injected)
    for k, out in enumerate(lines):
        rest = [r for r in lines if r is not out]
        if out["line_id"] == lines[-1]["line_id"]:
            assert all(got[r["line_id"], out["line_id"]]["islanding"] and got[r["line_id"], out["line_id"]]["factor"] == 0 for r in rest)
            continue
        after = dict(zip((r["line_id"] for r in rest), flows(rest, 8, injected), strict=True))
        for i, r in enumerate(lines):
            if r is not out:
                assert before[i] + got[r["line_id"], out["line_id"]]["factor"] * before[k] == pytest.approx(after[r["line_id"]])
    some = net.spark.createDataFrame([(2,), (3,)], "line_id int")
    few = topology.outage_factors(net["lines"], areas, some).collect()
    assert {r["outaged"] for r in few} == {2, 3} and all(r["factor"] == pytest.approx(got[r["monitored"], r["outaged"]]["factor"]) for r in few)


def test_cycles_close(spark):
    net = meshed(spark, 9, 6, seed=3)
    areas = topology.synchronous_areas(net["buses"], net["lines"])
    lines = {r["line_id"]: r for r in net["lines"].collect() if r["susceptance"] > 0}
    near = {frozenset((r["bus0"], r["bus1"])) for r in lines.values()}
    loops = topology.fundamental_cycles(net["lines"], areas, longest=100).collect()
    pairs = len(near)
    assert len(loops) == pairs - 10 + 1  # of 10 buses in one piece, parallel lines close loops of two, which don't count
    for r in loops:
        b = list(r["buses"])
        assert len(set(b)) == len(b) >= 3 and all(frozenset((x, y)) in near for x, y in zip(b, [*b[1:], b[0]], strict=True))
        assert frozenset((lines[r["line_id"]]["bus0"], lines[r["line_id"]]["bus1"])) in {frozenset((x, y)) for x, y in zip(b, [*b[1:], b[0]], strict=True)}
    assert topology.fundamental_cycles(net["lines"], areas, longest=3).count() == sum(len(r["buses"]) == 3 for r in loops)


def plain_intensity(gens, lines, flow, n):
    """Shares passed on until they settle."""
    made, co2 = np.zeros(n), np.zeros(n)
    for bus, mw, rate in gens:
        made[bus] += mw
        co2[bus] += mw * rate
    ways = [(a, b, f) if f > 0 else (b, a, -f) for (a, b), f in zip(lines, flow, strict=True) if f]
    entered = made + np.bincount([w[1] for w in ways], [w[2] for w in ways], n)
    x = np.zeros(n)
    for _ in range(5000):
        carried = co2.copy()
        for a, b, f in ways:
            carried[b] += f * x[a]
        x = np.where(entered > 1e-9, carried / np.maximum(entered, 1e-9), 0.0)
    return x, entered > 1e-9


def test_intensity_by_proportional_sharing(spark):
    gens = [{"bus_id": 0, "p_nom": 9.0, "co2_emissions": 1.0}, {"bus_id": 1, "p_nom": 9.0, "co2_emissions": 0.0}, {"bus_id": 3, "p_nom": 9.0, "co2_emissions": 0.5}]
    ends = [(0, 2), (1, 2), (2, 3), (3, 4), (4, 2), (5, 6)]
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": x} for x in "abcdefg"], generators=gens, lines=[{"bus0": a, "bus1": b, "susceptance": 1.0} for a, b in ends])
    mw = {0: [100.0, 100.0, 20.0], 1: [0.0, 50.0, 30.0]}
    flow = {0: [100.0, 100.0, 120.0, 60.0, 10.0, 0.0], 1: [0.0, 50.0, -20.0, 10.0, -5.0, 0.0]}
    dispatch = spark.createDataFrame([(g, t, x) for t, xs in mw.items() for g, x in enumerate(xs)], "gen_id int, t int, mw double")
    sent = spark.createDataFrame([(k, t, x) for t, xs in flow.items() for k, x in enumerate(xs)], "line_id int, t int, mw double")
    got = {(r["t"], r["bus_id"]): r for r in accounting.intensity(net, dispatch, sent).collect()}
    for t in (0, 1):
        want, traced = plain_intensity([(g["bus_id"], x, g["co2_emissions"]) for g, x in zip(gens, mw[t], strict=True)], ends, flow[t], 7)
        for b in range(7):
            assert got[t, b]["intensity"] == pytest.approx(want[b], abs=1e-9) and got[t, b]["traced"] == traced[b]
    half = accounting.intensity(net, spark.createDataFrame([(0, 0, 100.0), (1, 0, 100.0)], "gen_id int, t int, mw double"), spark.createDataFrame([(0, 0, 100.0), (1, 0, 100.0)], "line_id int, t int, mw double"))
    assert {r["bus_id"]: r["intensity"] for r in half.where("t = 0").collect()}[2] == pytest.approx(0.5)


def test_account_of_an_exporter(spark):
    """Coal at A serves 40 MW there and 60 MW at B over a lossless line."""
    net = Network.of(
        spark, Globals(value_of_lost_load=1e4), snapshots=hours(2), buses=[{"name": "A", "country": "A"}, {"name": "B", "country": "B"}], generators=[{"bus_id": 0, "p_nom": 200.0, "marginal_cost": 10.0, "co2_emissions": 1.0, "carrier": "coal", "embodied_co2": 3.0}],
        lines=[{"bus0": 0, "bus1": 1, "s_nom": 100.0, "susceptance": 1.0}], loads=[{"bus_id": 0, "p_set": 40.0}, {"bus_id": 1, "p_set": 60.0}],
    )
    a = account.account(net, solve(net))
    pick = lambda df, key: {r[key]: r["tonnes"] for r in df.collect()}
    assert pick(a.production, "country") == pytest.approx({"A": 200.0}) and pick(a.consumption, "country") == pytest.approx({"A": 80.0, "B": 120.0})
    assert pick(a.by_generator, "gen_id") == pytest.approx({0: 200.0}) and a.average.first()["intensity"] == pytest.approx(1.0)
    assert {r["intensity"] for r in a.intensity.collect()} == {1.0} and a.losses.count() == 0 and a.embodied.first()["tonnes"] == 0.0
    assert [(r["t"], r["gen_id"]) for r in a.marginal.orderBy("t").collect()] == [(0, 0), (1, 0)]
    assert a.by_carrier.first()["carrier"] == "coal"


def test_shifted_demand_moves_to_the_cheap_hour(spark):
    gens = [{"bus_id": 0, "p_nom": 50.0, "marginal_cost": 10.0}, {"bus_id": 0, "p_nom": 100.0, "marginal_cost": 100.0}]
    loads = [{"bus_id": 0, "p_set": 0.0, "shiftable_pu": 0.5, "shift_window": 2, "shift_cost": 1.0}]
    profile = [{"load_id": 0, "t": 0, "value": 60.0}, {"load_id": 0, "t": 1, "value": 20.0}]
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": "a"}], generators=gens, loads=loads, load_profile=profile)
    s = solve(net, families=("shift",))
    assert s.objective == pytest.approx(80 * 10 + 2 * 10 * 1)  # 10 MWh moved, paid in both hours
    dear = net.with_tables(loads=net["loads"].selectExpr("load_id", "bus_id", "p_set", "shiftable_pu", "shift_window", "500D as shift_cost"))
    assert solve(dear, families=("shift",)).objective == pytest.approx(70 * 10 + 10 * 100)


def test_interruptions_are_whole_and_few(spark):
    loads = [{"bus_id": 0, "p_set": 100.0, "interruptible_mw": 30.0, "max_interruptions": 1, "interruption_cost": 50.0}]
    gens = [{"bus_id": 0, "p_nom": 80.0, "marginal_cost": 10.0}, {"bus_id": 0, "p_nom": 50.0, "marginal_cost": 200.0}]
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": "a"}], generators=gens, loads=loads)
    assert solve(net, families=("interruptible",)).objective == pytest.approx(2 * 800 + 20 * 50 + 20 * 200)


def test_demand_tranches_give_way_by_value(spark):
    net = Network.of(spark, Globals(value_of_lost_load=1000.0), snapshots=hours(1), buses=[{"name": "a"}], generators=[{"bus_id": 0, "p_nom": 50.0, "marginal_cost": 10.0}], loads=[{"bus_id": 0, "p_set": 100.0, "value_tranches": [(20.0, 100.0), (10.0, 300.0)]}])
    assert solve(net, families=()).objective == pytest.approx(500 + 20 * 100 + 10 * 300 + 20 * 1000)


def test_outages_bind_before_they_happen(spark):
    """Three equal lines between two buses in a triangle's place: after one is lost its flow doubles on the rest."""
    lines = [{"bus0": 0, "bus1": 1, "s_nom": 60.0, "susceptance": 1.0} for _ in range(2)]
    gens = [{"bus_id": 0, "p_nom": 200.0, "marginal_cost": 10.0}, {"bus_id": 1, "p_nom": 200.0, "marginal_cost": 50.0}]
    net = Network.of(spark, snapshots=hours(1), buses=[{"name": "a"}, {"name": "b"}], generators=gens, loads=[{"bus_id": 1, "p_set": 110.0}], lines=lines)
    assert solve(net, families=("dc_flow",)).objective == pytest.approx(1100)
    safe = net.with_tables(contingencies=net["lines"].select("line_id"))
    assert solve(safe, families=("dc_flow", "security")).objective == pytest.approx(60 * 10 + 50 * 50)


def reservoir(spark, **more):
    units = [{"bus_id": 0, "p_nom": 100.0, "max_hours": 2.0, "cyclic": False, "soc_initial": 100.0, **more}]
    return Network.of(spark, Globals(value_of_lost_load=1000.0), snapshots=hours(2), buses=[{"name": "a"}], loads=[{"bus_id": 0, "p_set": 90.0}], storage_units=units)


def test_head_holds_discharge_back(spark):
    free = solve(reservoir(spark), families=("storage_balance",))
    assert free.total_shed() == pytest.approx(80.0)  # 100 MWh for 180
    s = solve(reservoir(spark, head_min_pu=0.5), families=("storage_balance", "head"))
    level = [100.0, s.trajectory("soc", 0)[0]]
    assert all(d <= 50 + 0.25 * z + 1e-6 for d, z in zip(s.trajectory("discharge", 0), level, strict=True))
    b = solve(reservoir(spark, head_min_pu=0.5, head_bands=2), families=("storage_balance", "head_bands"))
    assert b.status == "optimal" and b.total_shed() > free.total_shed()  # a band's level makes water worth less
    it, rounds, settled = solve_head_iterated(reservoir(spark, head_min_pu=0.5))
    assert settled and rounds > 1 and it.total_shed() > free.total_shed()


def test_rolling_hands_on_its_reservoir(spark):
    gens = [{"bus_id": 0, "p_nom": 60.0, "marginal_cost": 10.0}]
    profile = [{"load_id": 0, "t": t, "value": v} for t, v in enumerate([20.0, 20.0, 90.0, 90.0])]
    net = Network.of(spark, Globals(value_of_lost_load=1000.0), snapshots=hours(4), buses=[{"name": "a"}], generators=gens, loads=[{"bus_id": 0, "p_set": 0.0}], load_profile=profile, storage_units=[{"bus_id": 0, "p_nom": 40.0, "max_hours": 2.0, "cyclic": False}])
    whole, rolled = solve(net, families=("storage_balance",)), solve_rolling(net, Horizon(3, 2))
    assert rolled.windows == 2 and rolled.objective_full >= whole.objective - 1e-6
    soc = rolled.values[rolled.values["family"] == "soc"].sort_values("t")["value"].to_numpy()
    charge, give = (rolled.values[rolled.values["family"] == f].sort_values("t")["value"].to_numpy() for f in ("charge", "discharge"))
    assert np.allclose(np.diff(np.concatenate([[0.0], soc])), charge - give)


def test_reservoir_that_feeds_itself_counts_once(spark):
    net = Network.of(spark, snapshots=hours(2), buses=[{"name": "a"}], storage_units=[{"bus_id": 0, "p_nom": 9.0, "max_hours": 1.0, "downstream_id": 0, "efficiency_dispatch": 0.5, "spillable": True}], links=[{"bus0": 0, "bus1": 0, "efficiency": 0.9, "p_nom": 1.0}], lines=[{"bus0": 0, "bus1": 0, "loss": 0.1, "susceptance": 1.0}])
    m = Assembly(net).model()
    assert m.coef.groupBy("family", "id", "k", "t", "cfamily", "cid", "ck", "ct").count().where("count > 1").count() == 0
    at = {(r["cfamily"], r["ct"]): r["val"] for r in m.coef.where("family = 'storage' and t = 1").collect()}
    assert at["discharge", 1] == pytest.approx(2.0 - 1.0) and ("spill", 1) not in at
    assert {r["cfamily"]: r["val"] for r in m.coef.where("family = 'balance' and t = 0").collect()}["link_flow"] == pytest.approx(-0.1)


def test_numbers_at_many_components(spark):
    net = ring(spark, 5000, 2)
    cols, rows, coef = triplets(Assembly(net).model(("dc_flow",)))
    n = cols.count()
    assert cols.selectExpr("count(distinct col)", "min(col)", "max(col)").first()[:] == (n, 0, n - 1)
    assert rows.where("family = 'balance' and row <> id * 2 + t").count() == 0
    assert coef.selectExpr("max(row)").first()[0] == rows.count() - 1


def test_areas_that_do_not_settle_are_an_error(spark):
    chain = Network.of(spark, buses=[{"name": str(k)} for k in range(40)], lines=[{"bus0": k, "bus1": k + 1, "susceptance": 1.0} for k in range(39)])
    assert {r["area"] for r in topology.synchronous_areas(chain["buses"], chain["lines"]).collect()} == {"sync0"}
    with pytest.raises(RuntimeError, match="settle"):
        topology.synchronous_areas(chain["buses"], chain["lines"], rounds=2).count()


def test_fuzzy_scores():
    assert fuzzy_score("gen", "gen_bus2") == 14 + 11 + 11 - 2 and fuzzy_score("hv", "north_hv") == 9 + 11 - 2
    assert fuzzy_score("b", "aB") == 9 - 0 and fuzzy_score("", "x") == 0 and fuzzy_score("xy", "yx") is None
    assert fuzzy_score("ab", "axb") == 14 + 1 and fuzzy_score("bus", "BUS1") == 14 + 11 + 11 - 1


def test_text_scalars(spark):
    df = spark.createDataFrame([("é" * 200, "a,'b, c',,d"), ("x", "one"), ("", "p,")], "t string, l string")
    cut = [r[0] for r in df.select(cut_name(F.col("t"))).collect()]
    assert cut == ["é" * 127, "x", ""]
    assert [list(r[0]) for r in df.select(quoted_fields(F.col("l"))).collect()] == [["a", "b, c", "", "d"], ["one"], ["p", ""]]


def test_axis_fits(spark):
    fit = lambda *v: tuple(reductions.axis_fit(spark.createDataFrame([(float(x),) for x in v], "value double")).first())
    assert fit(3, 5, float("nan"), float("inf")) == (3.0, 5.0) and fit(-3, -1) == (-3.0, 0.0) and fit(4) == pytest.approx((3.6, 4.4)) and fit(float("nan")) == (0.0, 1.0)


def test_factors_solve_both_ways():
    rng = np.random.default_rng(7)
    for m in (1, 5, 40, 120):
        b = np.where(rng.random((m, m)) < 4 / m, rng.standard_normal((m, m)), 0.0) + np.diag(rng.uniform(1, 2, m))[:, rng.permutation(m)]
        c = Columns.of(b)
        f = Factors(m, [c.column(j) for j in range(m)])
        if not f.ok:
            assert np.linalg.cond(b) > 1e8
            continue
        for _ in range(3):
            v = rng.standard_normal(m)
            assert np.allclose(b @ f.column(v), v, atol=1e-6) and np.allclose(f.row_of(v) @ b, v, atol=1e-6)
            r, new = int(rng.integers(m)), rng.standard_normal(m)
            w = f.column(new)
            if abs(w[r]) > 0.1:
                f.replace(r, w)
                b[:, r] = new
    assert not Factors(2, [(np.array([0]), np.array([1.0])), (np.array([0]), np.array([2.0]))]).ok


def random_problem(rng, m=8, n=12):
    a = np.where(rng.random((m, n)) < 0.5, rng.integers(-4, 7, (m, n)), 0).astype(float)
    return simplex.Problem(a, np.zeros(n), np.full(n, 3.0), rng.integers(-9, 6, n).astype(float), np.full(m, -np.inf), rng.integers(4, 20, m).astype(float))


def test_sparse_and_dense_bases_agree():
    rng = np.random.default_rng(5)
    for _ in range(25):
        p = random_problem(rng)
        dense, sparse = simplex.solve(p), simplex.solve(p, simplex.Options(dense_rows=0, etas=5))
        assert dense.status == sparse.status == "optimal" and sparse.objective == pytest.approx(dense.objective)


def test_cuts_leave_every_integer_solution():
    rng = np.random.default_rng(11)
    found = 0
    for _ in range(40):
        n = 6
        a = rng.integers(-3, 8, (3, n)).astype(float)
        p = simplex.Problem(a, np.zeros(n), np.ones(n), -rng.integers(1, 9, n).astype(float), np.full(3, -np.inf), rng.integers(3, 12, 3).astype(float))
        whole = np.arange(n) < 5
        s = simplex.solve(p)
        rows, least = cuts.at_root(p, s, whole, 1e-6)
        found += len(rows)
        grid = np.stack(np.meshgrid(*[np.arange(2)] * n, indexing="ij"), -1).reshape(-1, n).astype(float)
        ok = grid[(grid @ a.T <= p.row_upper + 1e-9).all(axis=1)]
        assert len(rows) == 0 or ((ok @ rows.T >= least - 1e-6).all() and (rows @ s.x < least).all())
        plain, cut = simplex.solve_mip(p, whole), simplex.solve_mip(p, whole, simplex.MipOptions(cut_rounds=5))
        assert plain.proved and cut.proved and cut.best.objective == pytest.approx(plain.best.objective) and len(cut.best.dual) == 3
    assert found > 20


def test_published_ring_solves_sparsely(spark):
    """Eight buses over two days: the sparse basis and a plain merit order where nothing binds agree on the status."""
    s = solve(ring(spark, 8, 48), families=("dc_flow", "storage_balance"))
    assert s.status == "optimal" and s.objective > 0 and isinstance(s.values, pd.DataFrame)
