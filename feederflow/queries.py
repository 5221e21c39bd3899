"""The registered queries of the engine: each applies operators to the network derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.functions import scalars
from feederflow.operators import accounting, reductions, topology, validate
from feederflow.plans import derive, lp, merit

QUERIES: dict = {}
VOLL = 3000.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def net(spark: SparkSession, sf_dir: str, *parts: str):
    return derive.network(spark, sf_dir, *parts)


def facts(spark: SparkSession, sf_dir: str):
    """The network with one snapshot a day of shipments, and its ready dispatch."""
    d = derive.dispatch_facts(derive.Tables(spark, sf_dir))
    days = d.select("t").distinct().withColumn("weight", F.lit(1.0))
    return net(spark, sf_dir, "buses", "generators").with_tables(snapshots=days), d


@query
def merit_dispatch(spark, sf_dir):
    n = net(spark, sf_dir, "generators", "loads", "snapshots", "load_profile")
    return rounded(merit.dispatch(n["generators"], merit.demand(n["loads"], n["snapshots"], n["load_profile"])), "mw")


@query
def nodal_price(spark, sf_dir):
    n = net(spark, sf_dir, "generators", "loads", "snapshots", "load_profile")
    return rounded(merit.price_and_shed(n["generators"], merit.demand(n["loads"], n["snapshots"], n["load_profile"]), VOLL), "demand", "price", "shed")


@query
def balance_incidence(spark, sf_dir):
    return topology.components_by_bus(net(spark, sf_dir, "generators", "loads", "storage_units"))


@query
def net_trade(spark, sf_dir):
    return derive.trade(derive.Tables(spark, sf_dir))


@query
def line_incidence(spark, sf_dir):
    return topology.lines_by_bus(net(spark, sf_dir, "lines")["lines"])


@query
def link_incidence(spark, sf_dir):
    return topology.links_by_bus(net(spark, sf_dir, "links")["links"])


@query
def period_range_join(spark, sf_dir):
    n = net(spark, sf_dir, "snapshots", "periods")
    return topology.period_of_snapshot(n["snapshots"], n["periods"])


@query
def scenario_weight(spark, sf_dir):
    n = net(spark, sf_dir, "snapshots", "scenarios")
    return topology.scenario_weight(n["snapshots"], n["scenarios"])


@query
def cost_factor(spark, sf_dir):
    return rounded(topology.cost_factor(net(spark, sf_dir, "snapshots", "periods", "scenarios")), "factor")


@query
def sync_areas(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "lines")
    return topology.synchronous_areas(n["buses"], n["lines"])


@query
def triangle_search(spark, sf_dir):
    return topology.triangles(net(spark, sf_dir, "lines")["lines"])


@query
def submodel_severed(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "generators", "loads", "storage_units", "lines", "links")
    return topology.submodel(n, n["buses"].where("synchronous_area = 'EUROPE'"))[1]


@query
def submodel_generators(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "generators", "loads", "storage_units", "lines", "links")
    return topology.submodel(n, n["buses"].where("synchronous_area = 'EUROPE'"))[0]["generators"].select("gen_id", "bus_id", "p_nom")


@query
def violations(spark, sf_dir):
    return validate.violations(net(spark, sf_dir, "snapshots", "buses", "generators", "lines", "loads", "storage_units", "gen_availability", "load_profile")).select("code", "component_id")


@query
def violations_planted(spark, sf_dir):
    """The derived network with faults of every kind."""
    n = net(spark, sf_dir, "snapshots", "buses", "generators", "lines", "loads", "storage_units", "load_profile")
    k = lambda key, every: F.col(key) % every == 0
    swap = lambda df, **new: df.withColumns({c: F.when(when, value).otherwise(F.col(c)) for c, (when, value) in new.items()})
    faulty = n.with_tables(
        snapshots=swap(n["snapshots"], weight=(F.col("t") % 50 == 7, 0.0)),
        generators=swap(n["generators"], bus_id=(k("gen_id", 13), 999), p_nom=(k("gen_id", 11), -1.0), p_min_pu=(k("gen_id", 17), 1.5), co2_emissions=(k("gen_id", 19), -1.0), p_nom_max=(k("gen_id", 2), -5.0)),
        lines=swap(n["lines"], bus0=(k("line_id", 23), 999), bus1=(k("line_id", 29), F.col("bus0")), s_nom=(k("line_id", 31), -1.0), s_nom_extendable=(k("line_id", 37), True), s_nom_max=(k("line_id", 37), 0.0)),
        loads=swap(n["loads"], bus_id=(k("load_id", 6), 999)),
        storage_units=swap(n["storage_units"], bus_id=(F.col("storage_id") == 2, 999), efficiency_store=(F.col("storage_id") == 3, 0.0), efficiency_dispatch=(F.col("storage_id") == 4, 1.2), max_hours=(F.col("storage_id") == 5, -1.0), p_nom_extendable=(F.col("storage_id") == 1, True), p_nom_max=(F.col("storage_id") == 1, 0.0)),
    )
    return validate.violations(faulty).select("code", "component_id")


@query
def knn_places(spark, sf_dir):
    t = derive.Tables(spark, sf_dir)
    places = t.supplier.select(F.col("s_suppkey").alias("place_id"), (F.col("s_suppkey") * 37 % 400 / 10 - 10).alias("x"), (F.col("s_suppkey") * 53 % 300 / 10 + 35).alias("y"))
    return rounded(topology.nearest_buses(places, derive.buses(t)), "distance")


@query
def duration_curve(spark, sf_dir):
    return reductions.duration_curve(net(spark, sf_dir, "load_profile", "snapshots")["load_profile"], "load_id")


@query
def dispatch_stack(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return reductions.dispatch_stack(n["generators"], d)


@query
def price_spread(spark, sf_dir):
    return rounded(reductions.envelope(net(spark, sf_dir, "load_profile", "snapshots")["load_profile"]), "low", "high", "spread")


@query
def stack_totals(spark, sf_dir):
    return rounded(reductions.stack_totals(net(spark, sf_dir, "load_profile", "snapshots")["load_profile"]), "total")


@query
def stress_hour(spark, sf_dir):
    n = net(spark, sf_dir, "generators", "loads", "snapshots", "load_profile")
    p = merit.price_and_shed(n["generators"], merit.demand(n["loads"], n["snapshots"], n["load_profile"]), VOLL)
    score = reductions.stress_score(p.select("t", F.col("price").alias("value")), p.select("t", F.col("shed").alias("mw")))
    return rounded(reductions.interesting_hour(score), "score")


@query
def peak_and_mean(spark, sf_dir):
    return rounded(reductions.peak_and_mean(net(spark, sf_dir, "load_profile", "snapshots")["load_profile"], "load_id"), "peak", "peak_abs", "mean")


@query
def bus_balance(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return rounded(reductions.bus_balance(n.with_tables(loads=derive.loads(derive.Tables(spark, sf_dir))), d), "generated", "consumed", "net")


@query
def regions_by_size(spark, sf_dir):
    return reductions.regions_by_size(net(spark, sf_dir, "buses")["buses"], "synchronous_area")


@query
def region_extents(spark, sf_dir):
    return rounded(reductions.region_extents(net(spark, sf_dir, "buses")["buses"], "synchronous_area"), "cx", "cy")


@query
def label_weight(spark, sf_dir):
    return reductions.label_weight(net(spark, sf_dir, "buses", "generators", "loads", "lines"))


@query
def area_peak(spark, sf_dir):
    return rounded(reductions.area_peak(net(spark, sf_dir, "buses", "loads", "snapshots", "load_profile")), "peak")


@query
def capacity_credit(spark, sf_dir):
    return rounded(reductions.capacity_credit(net(spark, sf_dir, "generators", "gen_availability")), "credit")


@query
def allocation_share(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "generators")
    w = n["generators"].join(n["buses"].select("bus_id", F.col("synchronous_area").alias("country")), "bus_id").groupBy("bus_id", "country").agg(F.sum("p_nom").alias("weight"))
    totals = n["buses"].select(F.col("synchronous_area").alias("country")).distinct().select("country", F.lit(1000.0).alias("mw"))
    return rounded(reductions.allocation(w, totals), "mw")


@query
def results_pivot(spark, sf_dir):
    n = net(spark, sf_dir, "loads", "snapshots", "load_profile")
    wide = reductions.widen(n["load_profile"], n["loads"].select("load_id", F.col("name")), "load_id")
    return wide


@query
def unpivot_wide(spark, sf_dir):
    n = net(spark, sf_dir, "loads", "snapshots", "load_profile")
    wide = reductions.widen(n["load_profile"], n["loads"], "load_id")
    return reductions.lengthen(wide, n["loads"], "load_id")


@query
def emissions_by_generator(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return rounded(accounting.by_generator(n, d), "tonnes")


@query
def production_by_country(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return rounded(accounting.production_by_country(n, d), "tonnes")


@query
def by_carrier(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return rounded(accounting.by_carrier(n, d), "tonnes", "mwh", "intensity")


@query
def average_intensity(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    return rounded(accounting.average_intensity(n, d), "tonnes", "mwh", "intensity")


@query
def marginal_unit(spark, sf_dir):
    n = net(spark, sf_dir, "generators", "loads", "snapshots", "load_profile")
    d = merit.dispatch(n["generators"], merit.demand(n["loads"], n["snapshots"], n["load_profile"]))
    return accounting.marginal_unit(n, d)


@query
def lp_cols(spark, sf_dir):
    """Every column family: how many, and the sums of its finite bounds and costs."""
    c = lp.Assembly(net(spark, sf_dir)).columns()
    finite = lambda x: F.coalesce(F.sum(F.when(F.abs(x) < float("inf"), F.round(F.col(x) * 1e6).cast("decimal(38,0)"))), F.lit(0)).cast("double") / 1e6
    return rounded(c.groupBy("family").agg(F.count("*").alias("n"), finite("lower").alias("lower"), finite("upper").alias("upper"), F.count_if("is_int").alias("ints")), "lower", "upper")


@query
def lp_cols_dispatch(spark, sf_dir):
    c = lp.Assembly(net(spark, sf_dir, "generators", "snapshots", "periods", "scenarios", "gen_availability")).dispatch()
    return rounded(c.select("id", "t", "lower", "upper", "obj"), "lower", "upper", "obj")


def _terms(df: DataFrame) -> DataFrame:
    """The terms of rows. A value that rounds to zero keeps its sign, as in SQL: -0.0 and 0.0 are two texts."""
    signed = lambda c: F.when(F.round(c, 6) == 0, F.col(c) * 0.0).otherwise(F.round(c, 6)).alias(c)
    long = df.select("id", "k", "t", "lower", "upper", F.inline("terms"))
    return long.select(*[signed(c) if c in ("lower", "upper", "val") else c for c in long.columns])


@query
def lp_rows_balance(spark, sf_dir):
    a = lp.Assembly(net(spark, sf_dir))
    return rounded(a.balance_terms().groupBy("id", "cfamily").agg(F.count("*").alias("n"), F.sum("val").alias("val")), "val")


@query
def lp_rhs_balance(spark, sf_dir):
    return rounded(lp.Assembly(net(spark, sf_dir, "buses", "loads", "snapshots", "load_profile")).balance_rows().select("id", "t", "lower", "upper"), "lower", "upper")


@query
def lp_rows_dcflow(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "lines", "snapshots")).dc_flow())


@query
def lp_rows_storage(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "storage_units", "snapshots", "storage_inflow")).storage_balance())


@query
def lp_rows_ramps(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "generators", "snapshots")).ramps())


@query
def lp_rows_commitment(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "generators", "snapshots", "gen_availability")).commitment_rows())


@query
def lp_rows_losses(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "lines", "snapshots")).losses())


@query
def lp_rows_reserve(spark, sf_dir):
    r = lp.Assembly(net(spark, sf_dir, "buses", "generators", "loads", "storage_units", "snapshots", "load_profile", "gen_availability", "periods")).reserve()
    return rounded(r.select("id", "lower", F.size("terms").cast("bigint").alias("n"), F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["val"]).alias("val")), "lower", "val")


def _budget(spark, sf_dir, name):
    _, per_mwh, per_mw = next(b for b in lp.Assembly.BUDGETS if b[0] == name)
    b = lp.Assembly(net(spark, sf_dir, "generators", "snapshots", "periods")).budget_terms(name, per_mwh, per_mw)
    return rounded(b.select("cfamily", "cid", "ck", "ct", "val"), "val")


@query
def lp_budget_co2(spark, sf_dir):
    return _budget(spark, sf_dir, "co2")


@query
def lp_budget_water(spark, sf_dir):
    return _budget(spark, sf_dir, "water")


@query
def lp_budget_land(spark, sf_dir):
    return _budget(spark, sf_dir, "land")


@query
def csc_transpose(spark, sf_dir):
    """The flow rows' coefficients by column: each column's entries, first row and sum."""
    a = lp.Assembly(net(spark, sf_dir, "lines", "snapshots"))
    m = lp.Model(a.flow().unionByName(a.angle_columns()), a.dc_flow().select(*lp.KEY, "lower", "upper"), a.dc_flow().select(*lp.KEY, F.inline("terms")))
    coef = lp.compressed(lp.triplets(m)[2])
    return rounded(coef.groupBy("col").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.sum("val").alias("val")), "val")


@query
def outage_factors(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "lines")
    return rounded(topology.outage_factors(n["lines"], topology.synchronous_areas(n["buses"], n["lines"])), "factor")


@query
def fundamental_cycles(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "lines")
    return topology.fundamental_cycles(n["lines"], topology.synchronous_areas(n["buses"], n["lines"]))


def _trade_flows(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    lines = net(spark, sf_dir, "lines")["lines"]
    flows = lines.join(n["snapshots"].select("t")).select("line_id", "t", (F.pmod(F.col("line_id") * 31 + F.col("t") * 17, F.lit(41)) - 20).cast("double").alias("mw"))
    return n.with_tables(lines=lines, loads=derive.loads(derive.Tables(spark, sf_dir))), d, flows


@query
def intensity_trace(spark, sf_dir):
    return rounded(accounting.intensity(*_trade_flows(spark, sf_dir)), "intensity")


@query
def consumption_by_country(spark, sf_dir):
    n, d, flows = _trade_flows(spark, sf_dir)
    shed = n["buses"].join(n["snapshots"].select("t")).select("t", "bus_id", F.lit(1.0).alias("mw"))
    return accounting.consumption_by_country(n, local_intensity(n, d), shed).withColumn("tonnes", F.round("tonnes", 3))


def local_intensity(n, d) -> DataFrame:
    """The mix of each bus's own generation, where there is any."""
    own = d.join(n["generators"].select("gen_id", "bus_id", "co2_emissions"), "gen_id").groupBy("t", "bus_id").agg(F.sum("mw").alias("mw"), F.sum(F.col("mw") * F.col("co2_emissions")).alias("co2"))
    return own.select("t", "bus_id", (F.col("co2") / F.col("mw")).alias("intensity"))


@query
def losses_carbon(spark, sf_dir):
    n, d, flows = _trade_flows(spark, sf_dir)
    lost = flows.join(n["lines"].select("line_id", "loss"), "line_id").select("line_id", "t", (F.abs("mw") * F.col("loss")).alias("mw"))
    return accounting.losses_carbon(n, local_intensity(n, d), lost).withColumn("tonnes", F.round("tonnes", 3))


@query
def embodied_carbon(spark, sf_dir):
    n = net(spark, sf_dir, "generators")
    return rounded(accounting.embodied(n, n["generators"].where("p_nom_extendable").select("gen_id", (F.col("p_nom") / 2).alias("mw"))), "tonnes")


@query
def line_loading(spark, sf_dir):
    n, _, flows = _trade_flows(spark, sf_dir)
    lines = n["lines"].withColumn("s_nom", F.when(F.col("line_id") % 11 == 0, float("inf")).otherwise(F.col("line_id") % 21 + 0.0))
    return rounded(reductions.loading(lines, flows), "loading", "mean_flow")


@query
def mean_load(spark, sf_dir):
    return rounded(reductions.mean_positive(net(spark, sf_dir, "load_profile", "snapshots")["load_profile"], "load_id", more_than=10), "mean")


def _levels(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "lines")
    return n.with_tables(buses=n["buses"].withColumn("v_nom", (F.col("bus_id") * 37 % 500).cast("double")))


@query
def line_voltage_band(spark, sf_dir):
    return reductions.line_voltage(_levels(spark, sf_dir)).select("line_id", "kv", reductions.voltage_band("kv").alias("band"))


@query
def voltages_stated(spark, sf_dir):
    return reductions.voltages_stated(_levels(spark, sf_dir)["buses"])


@query
def shown_buses(spark, sf_dir):
    b = net(spark, sf_dir, "buses")["buses"].withColumn("country", F.col("synchronous_area"))
    hidden, only = reductions.shown_buses(b, ["ASIA", "EUROPE"]), reductions.shown_buses(b, only="ASIA")
    return hidden.select(F.lit("hidden").alias("filter"), "bus_id").unionByName(only.select(F.lit("only").alias("filter"), "bus_id"))


def _places(spark, sf_dir):
    t = derive.Tables(spark, sf_dir)
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("place_id"), (k * 37 % 400 / 10 - 10).alias("x"), (k * 53 % 300 / 10 + 35).alias("y"), (k * 7919 % 1000).alias("rank"), (k * 1000).cast("double").alias("population"))


@query
def places_within(spark, sf_dir):
    return reductions.places_within(_places(spark, sf_dir).withColumn("rank", F.col("rank") * 10_000 + F.col("place_id")), -5.0, 40.0, 20.0, 60.0, 15).select("place_id", "rank")


@query
def population_weight(spark, sf_dir):
    return reductions.population_weight(_places(spark, sf_dir), net(spark, sf_dir, "buses")["buses"]).withColumn("weight", F.round("weight", 3))


@query
def axis_fit(spark, sf_dir):
    p = net(spark, sf_dir, "load_profile", "snapshots")["load_profile"]
    return rounded(reductions.axis_fit(p.withColumn("value", -F.col("value"))), "low", "high")


@query
def full_stack(spark, sf_dir):
    n, d = facts(spark, sf_dir)
    given = n["snapshots"].select(F.lit(3).alias("storage_id"), "t", (F.col("t") % 7 - 2).cast("double").alias("mw"))
    return reductions.full_stack(n["generators"], d, given)


@query
def label_order(spark, sf_dir):
    return reductions.label_order(net(spark, sf_dir, "buses", "generators", "loads", "lines"), [7, 3])


@query
def hvdc_ties(spark, sf_dir):
    n = net(spark, sf_dir, "buses", "links")
    ties = n["buses"].where("bus_id < 4").select(F.concat(F.lit("dc"), F.col("bus_id").cast("string")).alias("name"), F.col("bus_id").alias("bus_a"), (F.col("bus_id") + 10).alias("bus_b"), F.lit(500.0).alias("p_nom"), scalars.dc_efficiency(F.col("bus_id") * 200.0, 0.03).alias("efficiency"))
    return rounded(topology.with_hvdc_ties(n, ties)["links"].select("link_id", "name", "bus0", "bus1", "p_nom", "efficiency"), "efficiency")


@query
def contingencies_all_lines(spark, sf_dir):
    return topology.contingencies_all_lines(net(spark, sf_dir, "lines")["lines"])


@query
def first_appearance(spark, sf_dir):
    return topology.first_appearance(net(spark, sf_dir, "generators")["generators"], "carrier", "gen_id")


@query
def scatter_back(spark, sf_dir):
    n = net(spark, sf_dir, "generators")
    cut = n["generators"].where("gen_id % 3 = 0").select("gen_id", F.col("p_nom").alias("value"))
    return topology.scatter_back(n["generators"], cut, "gen_id")


@query
def scalar_formulas(spark, sf_dir):
    """Formulas over the lines: efficiency, admittance, head, envelopes, ratings."""
    k, km = F.col("line_id"), F.col("s_nom")
    g, b = scalars.admittance(F.col("resistance"), (k % 3) * 0.1)
    lo, hi = -(k % 5).cast("double"), (k % 7).cast("double")
    slope, start = scalars.secant(lo, hi)
    kv = (k % 8 * 100).cast("double")
    out = net(spark, sf_dir, "lines")["lines"].select(
        "line_id", scalars.dc_efficiency(km, 0.03).alias("dc"), g.alias("g"), b.alias("b"), scalars.head_level(F.lit(0.4), km / 1000).alias("head"), slope.alias("slope"), start.alias("start"),
        scalars.thermal_mw(kv).alias("thermal"), scalars.line_susceptance(kv, km, F.lit(2.0)).alias("susceptance"), scalars.quantise(km, 500.0).alias("steps"),
    )
    return rounded(out, "dc", "g", "b", "head", "susceptance")


@query
def envelope_planes(spark, sf_dir):
    k = F.col("line_id")
    planes = scalars.mccormick((k % 5).cast("double"), (k % 5 + 3).cast("double"), (k % 4).cast("double"), (k % 4 + 2).cast("double"))
    return net(spark, sf_dir, "lines")["lines"].select("line_id", F.inline(planes))


@query
def text_formulas(spark, sf_dir):
    """Formulas over texts: points, projections, key-value pairs, carriers, cuts and escapes."""
    b = net(spark, sf_dir, "buses")["buses"]
    point = scalars.wkt_point(F.format_string("POINT(%s %s)", F.col("x").cast("int"), F.col("y").cast("int")))
    pairs = scalars.hstore(F.concat(F.lit('"name"=>"'), F.col("name"), F.lit('", "kv"=>"'), F.col("bus_id").cast("string"), F.lit('"')))
    kinds = F.element_at(F.array(*map(F.lit, ["Hydro Pure Storage", "Brown coal/Lignite", "Hard coal", "Wind Onshore", "unknown"])), F.col("bus_id") % 5 + 1)
    return rounded(
        b.select(
            "bus_id", point["lon"].alias("lon"), point["lat"].alias("lat"), scalars.mercator(F.col("y")).alias("mercator"), scalars.place(F.col("x") * 10, F.col("y")).isNotNull().alias("placed"), pairs["kv"].alias("kv"), scalars.fuel(kinds).alias("fuel"),
            scalars.cut_name(F.repeat(F.col("name"), 40)).alias("cut"), scalars.xml_escape(F.concat(F.lit("<a & 'b'> "), "name")).alias("xml"), scalars.xsd_datetime(F.col("bus_id") * 86401).alias("time"), scalars.place_kind(F.concat(F.lit("Admin-"), (F.col("bus_id") % 3).cast("string"), F.lit(" capital")), F.col("bus_id") * 10_000).alias("kind"),
        ),
        "mercator",
    )


@query
def lp_rows_ties(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "buses", "generators", "snapshots", "periods", "gen_availability")).capacity_ties())


@query
def lp_rows_shift(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "loads", "snapshots", "load_profile")).shift())


@query
def lp_rows_interrupt(spark, sf_dir):
    return _terms(lp.Assembly(net(spark, sf_dir, "loads", "snapshots")).interruptible())


def _heads(spark, sf_dir, bands: int):
    n = net(spark, sf_dir, "storage_units", "snapshots")
    return lp.Assembly(n.with_tables(storage_units=n["storage_units"].withColumn("head_min_pu", F.lit(0.5)).withColumn("head_bands", F.lit(bands))))


@query
def lp_rows_head(spark, sf_dir):
    return _terms(_heads(spark, sf_dir, 0).head())


@query
def lp_rows_head_bands(spark, sf_dir):
    return _terms(_heads(spark, sf_dir, 3).head_bands())


@query
def lp_rows_security(spark, sf_dir):
    """How many monitored lines each listed outage binds, and the sum of what moves; factors have no SQL twin."""
    n = net(spark, sf_dir, "buses", "lines", "snapshots")
    n = n.with_tables(contingencies=derive.contingencies(derive.Tables(spark, sf_dir)))
    rows = lp.Assembly(n).security().where("t = 0")
    return rounded(rows.groupBy(F.col("k").alias("outaged")).agg(F.count("*").alias("n"), F.sum(F.col("terms")[1]["val"]).alias("moved")), "moved")


@query
def numbered_model(spark, sf_dir):
    """The whole model as numbered triplets: entries, sums and ends by row family."""
    coef = lp.entries(lp.Assembly(net(spark, sf_dir)).model())
    # Distinct rows as bits: a word for 64 rows, so that neither rows nor coefficients are dealt out.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("row").bitwiseAND(63).cast("int"))
    words = coef.groupBy("family", F.shiftright("row", 6).alias("word")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"), F.min("row").alias("first"), F.max("row").alias("last"))
    return words.groupBy("family").agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits").cast("bigint")).alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
