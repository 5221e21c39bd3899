"""The same queries in DuckDB SQL, over the same derived network written as common table expressions."""

from __future__ import annotations

#: Common table expressions by name, with the ones each needs.
PARTS: dict[str, tuple[str, str]] = {
    "buses": ("", "SELECT n_nationkey AS bus_id, n_name AS name, n_name AS country, r_name AS area, CAST(n_nationkey * 7 % 40 - 10 AS DOUBLE) AS x, CAST(n_nationkey * 11 % 30 + 35 AS DOUBLE) AS y FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "gens": ("", """SELECT CAST(s_suppkey AS INT) AS gen_id, s_nationkey AS bus_id, CAST(100 + s_suppkey % 400 AS DOUBLE) AS p_nom, CAST(10 + s_suppkey * 7 % 90 AS DOUBLE) AS cost,
        ['wind','gas','oil','lignite','coal'][CAST(s_suppkey % 5 AS INT) + 1] AS carrier, CAST([0.0,0.2,0.4,0.8,1.0][CAST(s_suppkey % 5 AS INT) + 1] AS DOUBLE) AS co2, s_suppkey % 7 = 0 AS ext, s_suppkey % 3 = 0 AS uc,
        s_suppkey % 4 * CAST(0.1 AS DOUBLE) AS p_min, s_suppkey % 4 * CAST(0.3 AS DOUBLE) AS ramp_up, s_suppkey % 5 * CAST(0.25 AS DOUBLE) AS ramp_down, CAST(s_suppkey % 4 AS INT) AS up, CAST(s_suppkey % 3 AS INT) AS down,
        s_suppkey % 11 * CAST(0.5 AS DOUBLE) AS water, s_suppkey % 6 * CAST(0.25 AS DOUBLE) AS land, s_suppkey % 9 * CAST(1.5 AS DOUBLE) AS embodied FROM supplier"""),
    "loads": ("", """SELECT c_nationkey AS load_id, c_nationkey AS bus_id, 'load' || c_nationkey AS name, CAST(floor(sum(CAST(round(greatest(c_acctbal, 0.0) * 100) AS BIGINT)) / 100000) AS DOUBLE) AS p_set, c_nationkey % 3 * CAST(0.1 AS DOUBLE) AS pu,
        CAST(c_nationkey % 4 * 6 AS INT) AS win, c_nationkey % 2 * 5 AS shift_cost, CAST(c_nationkey % 5 * 10 AS DOUBLE) AS imw, c_nationkey % 5 * 2 AS imax FROM customer GROUP BY c_nationkey"""),
    "snaps": ("", "SELECT CAST(n AS INT) AS t, CAST(1 + n % 2 AS DOUBLE) AS weight, hour FROM (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS n FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events))"),
    "profile": ("snaps", "SELECT CAST(user_id % 25 AS INT) AS load_id, t, sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS value FROM events JOIN snaps ON date_trunc('hour', ts) = hour GROUP BY 1, 2"),
    "trade": ("", """SELECT least(src, dst) AS bus0, greatest(src, dst) AS bus1, CAST(sum(CASE WHEN src < dst THEN q ELSE -q END) AS BIGINT) AS net FROM (SELECT s_nationkey AS src, c_nationkey AS dst, CAST(l_quantity AS BIGINT) AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) WHERE src <> dst GROUP BY 1, 2"""),
    "lines": ("trade", """SELECT bus0 * 25 + bus1 AS line_id, bus0, bus1, CAST(abs(net) + 1 AS DOUBLE) AS s_nom, CASE WHEN (bus0 + bus1) % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(1 + (bus0 * 25 + bus1) % 10 AS DOUBLE) END AS b,
        (bus0 * 25 + bus1) % 3 * CAST(0.01 AS DOUBLE) AS loss, (bus0 * 25 + bus1) % 4 * CAST(0.001 AS DOUBLE) AS phase FROM trade"""),
    "stores": ("", """SELECT CAST(n_nationkey // 4 AS INT) AS storage_id, n_nationkey AS bus_id, CAST(50 + n_nationkey AS DOUBLE) AS p_nom, CAST(2 + n_nationkey % 5 AS DOUBLE) AS hours, n_nationkey % 8 = 0 AS cyclic,
        CASE WHEN n_nationkey < 24 THEN n_nationkey // 4 + 1 END AS down, n_nationkey % 3 AS lag, CASE WHEN n_nationkey % 8 <> 0 THEN 10.0::DOUBLE END AS soc0, n_nationkey % 8 = 4 AS spills FROM nation WHERE n_nationkey % 4 = 0"""),
    "links": ("", "SELECT a.r AS link_id, a.bus AS bus0, b.bus AS bus1, CAST(100 + a.r * 10 AS DOUBLE) AS p_nom, CAST(a.r AS DOUBLE) AS cost FROM (SELECT n_regionkey AS r, min(n_nationkey) AS bus FROM nation GROUP BY 1) a JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS bus FROM nation GROUP BY 1) b ON b.r = (a.r + 1) % 5"),
    "horizon": ("snaps", "SELECT CAST(max(t) + 1 AS INT) AS n FROM snaps"),
    "periods": ("horizon", "SELECT CAST(p AS INT) AS period, CAST(p * (n // 3) - CASE WHEN p = 2 THEN 5 ELSE 0 END AS INT) AS a, n // 3 AS len, CAST([1.0,0.75,0.5][p + 1] AS DOUBLE) AS discount FROM horizon, range(3) r(p)"),
    "scens": ("horizon", "SELECT CAST(s AS INT) AS scenario, CAST(s * (n // 2) AS INT) AS a, n // 2 AS len, CAST(CASE WHEN s = 0 THEN 0.25 ELSE 0.75 END AS DOUBLE) AS prob FROM horizon, range(2) r(s)"),
    "pmap": ("snaps periods", "SELECT t, CAST(coalesce(max(period), 0) AS INT) AS period FROM snaps LEFT JOIN periods ON t >= a AND t < a + len GROUP BY t"),
    "smap": ("snaps scens", "SELECT t, coalesce(arg_max(prob, scenario), 1.0::DOUBLE) AS probability FROM snaps LEFT JOIN scens ON t >= a AND t < a + len GROUP BY t"),
    "factors": ("pmap smap", "SELECT t, weight * coalesce(discount, 1.0) * probability AS factor FROM snaps JOIN pmap USING (t) JOIN smap USING (t) LEFT JOIN periods USING (period)"),
    "avail": ("snaps gens", "SELECT gen_id, t, coalesce(CASE WHEN carrier = 'wind' THEN (t * 7 + gen_id * 13) % 100 / 100.0::DOUBLE END, 1.0) AS a FROM gens, snaps"),
    "need": ("snaps loads profile", "SELECT l.load_id, l.bus_id, s.t, coalesce(p.value, l.p_set) AS mw FROM loads l CROSS JOIN snaps s LEFT JOIN profile p ON p.load_id = l.load_id AND p.t = s.t"),
    "demand": ("need", "SELECT t, sum(mw) AS demand FROM need GROUP BY t"),
    "stack": ("gens", "SELECT gen_id, cost, p_nom, sum(p_nom) OVER (ORDER BY cost, gen_id ROWS UNBOUNDED PRECEDING) - p_nom AS below, sum(p_nom) OVER (ORDER BY cost, gen_id ROWS UNBOUNDED PRECEDING) AS upto FROM gens"),
    "merit": ("stack demand", "SELECT gen_id, t, least(greatest(demand - below, 0.0), p_nom) AS mw FROM stack JOIN demand ON below < demand"),
    "prices": ("stack demand", "SELECT t, demand, coalesce(min(cost), 3000.0::DOUBLE) AS price, greatest(demand - (SELECT sum(p_nom) FROM gens), 0.0) AS shed FROM demand LEFT JOIN stack ON upto >= demand GROUP BY t, demand"),
    "facts": ("", "SELECT gen_id, CAST(dense_rank() OVER (ORDER BY day) - 1 AS INT) AS t, CAST(q AS DOUBLE) AS mw FROM (SELECT CAST(l_suppkey AS INT) AS gen_id, CAST(l_shipdate AS DATE) AS day, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)"),
    "energy": ("facts gens", "SELECT gen_id, bus_id, carrier, sum(mw) AS mwh, sum(mw) * co2 AS tonnes FROM facts JOIN gens USING (gen_id) GROUP BY gen_id, bus_id, carrier, co2"),
    "incidence": ("lines", "SELECT bus0 AS bus_id, line_id, -1.0::DOUBLE AS sign, loss FROM lines UNION ALL SELECT bus1, line_id, 1.0, loss FROM lines"),
}

TWINS = {
    "merit_dispatch": ("merit", "SELECT gen_id, t, round(mw, 6) AS mw FROM merit WHERE mw > 0"),
    "nodal_price": ("prices", "SELECT t, round(demand, 6) AS demand, round(price, 6) AS price, round(shed, 6) AS shed FROM prices"),
    "balance_incidence": ("gens loads stores", "SELECT bus_id, 'generator' AS kind, gen_id AS component_id FROM gens UNION ALL SELECT bus_id, 'load', load_id FROM loads UNION ALL SELECT bus_id, 'storage', storage_id FROM stores"),
    "net_trade": ("trade", "SELECT bus0, bus1, net FROM trade"),
    "line_incidence": ("incidence", "SELECT bus_id, line_id, sign FROM incidence"),
    "link_incidence": ("links", "SELECT bus0 AS bus_id, link_id, -1.0::DOUBLE AS coefficient FROM links UNION ALL SELECT bus1, link_id, 0.97 FROM links"),
    "period_range_join": ("pmap", "SELECT t, period FROM pmap"),
    "scenario_weight": ("smap", "SELECT t, probability FROM smap"),
    "cost_factor": ("factors", "SELECT t, round(factor, 6) AS factor FROM factors"),
    "triangle_search": ("lines", "SELECT p.bus0 AS a, p.bus1 AS b, q.bus1 AS c FROM lines p JOIN lines q ON p.bus1 = q.bus0 JOIN lines r ON r.bus0 = p.bus0 AND r.bus1 = q.bus1 WHERE p.b > 0 AND q.b > 0 AND r.b > 0"),
    "submodel_severed": ("buses lines links", """SELECT 'lines' AS kind, line_id AS id FROM lines JOIN buses a ON a.bus_id = bus0 JOIN buses z ON z.bus_id = bus1 WHERE (a.area = 'EUROPE') <> (z.area = 'EUROPE')
        UNION ALL SELECT 'links', link_id FROM links JOIN buses a ON a.bus_id = bus0 JOIN buses z ON z.bus_id = bus1 WHERE (a.area = 'EUROPE') <> (z.area = 'EUROPE')"""),
    "submodel_generators": ("gens buses", "SELECT gen_id, bus_id, p_nom FROM gens JOIN buses USING (bus_id) WHERE area = 'EUROPE'"),
    "violations": ("gens buses lines loads horizon profile", """SELECT 'line_across_areas' AS code, CAST(line_id AS BIGINT) AS component_id FROM lines JOIN buses a ON a.bus_id = bus0 JOIN buses z ON z.bus_id = bus1 WHERE b > 0 AND a.area <> z.area
        UNION ALL SELECT 'profile_shape', CAST(load_id AS BIGINT) FROM (SELECT load_id, count(DISTINCT t) AS c FROM profile GROUP BY load_id) JOIN loads USING (load_id) CROSS JOIN horizon WHERE c <> n"""),
    "knn_places": ("buses", """SELECT place_id, bus_id, round(d, 6) AS distance FROM (SELECT place_id, bus_id, d, row_number() OVER (PARTITION BY place_id ORDER BY d, bus_id) AS k FROM (SELECT s_suppkey AS place_id, bus_id,
        sqrt(pow(s_suppkey * 37 % 400 / 10.0::DOUBLE - 10 - x, 2) + pow(s_suppkey * 53 % 300 / 10.0::DOUBLE + 35 - y, 2)) AS d FROM supplier, buses) WHERE d <= 3) WHERE k <= 5"""),
    "duration_curve": ("profile", "SELECT load_id, CAST(row_number() OVER (PARTITION BY load_id ORDER BY value DESC, t) AS INT) AS rank, value FROM profile"),
    "dispatch_stack": ("facts gens", "SELECT t, gen_id, mw, sum(mw) OVER (PARTITION BY t ORDER BY cost, gen_id ROWS UNBOUNDED PRECEDING) AS top FROM facts JOIN gens USING (gen_id)"),
    "price_spread": ("profile", "SELECT t, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(value) - min(value), 6) AS spread FROM profile GROUP BY t"),
    "stack_totals": ("profile", "SELECT t, round(sum(value), 6) AS total FROM profile GROUP BY t"),
    "stress_hour": ("prices", "SELECT t, round(CASE WHEN shed > 0 THEN 1e9::DOUBLE + shed ELSE price END, 6) AS score FROM prices ORDER BY score DESC, t DESC LIMIT 1"),
    "peak_and_mean": ("profile", "SELECT load_id, round(greatest(max(value), 0.0), 6) AS peak, round(max(abs(value)), 6) AS peak_abs, round(avg(value), 6) AS mean FROM profile GROUP BY load_id"),
    "bus_balance": ("buses facts gens loads", """SELECT bus_id, round(g, 6) AS generated, round(c, 6) AS consumed, round(g - c, 6) AS net FROM (SELECT b.bus_id, coalesce(m.mw, 0.0) / (SELECT count(DISTINCT t) FROM facts) AS g, coalesce(l.p, 0.0) AS c FROM buses b
        LEFT JOIN (SELECT bus_id, sum(mw) AS mw FROM facts JOIN gens USING (gen_id) GROUP BY bus_id) m USING (bus_id) LEFT JOIN (SELECT bus_id, sum(p_set) AS p FROM loads GROUP BY bus_id) l USING (bus_id))"""),
    "regions_by_size": ("buses", "SELECT area AS synchronous_area, count(*) AS buses FROM buses GROUP BY area"),
    "region_extents": ("buses", "SELECT area AS synchronous_area, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM buses GROUP BY area"),
    "label_weight": ("buses gens loads incidence", """SELECT bus_id, weight, CAST(row_number() OVER (ORDER BY weight DESC, name, bus_id) AS INT) AS place FROM (SELECT b.bus_id, name, coalesce(sum(w), 0.0) AS weight FROM buses b LEFT JOIN
        (SELECT bus_id, 2 * p_nom AS w FROM gens UNION ALL SELECT bus_id, abs(p_set) FROM loads UNION ALL SELECT bus_id, 25.0 FROM incidence) p ON p.bus_id = b.bus_id GROUP BY b.bus_id, name)"""),
    "area_peak": ("need buses", "SELECT area, round(max(mw), 6) AS peak FROM (SELECT area, t, sum(mw) AS mw FROM need JOIN buses USING (bus_id) GROUP BY area, t) GROUP BY area"),
    "capacity_credit": ("avail", "SELECT gen_id, round(least(min(a), 1.0), 6) AS credit FROM avail GROUP BY gen_id"),
    "allocation_share": ("gens buses", """SELECT bus_id, country, round(mw, 6) AS mw FROM (SELECT bus_id, country, 1000.0::DOUBLE * w / sum(w) OVER (PARTITION BY country) AS mw FROM (SELECT bus_id, area AS country, sum(p_nom) AS w FROM gens JOIN buses USING (bus_id) GROUP BY bus_id, area)) WHERE mw >= 1"""),
    "unpivot_wide": ("profile loads", "SELECT load_id, t, value FROM profile JOIN loads USING (load_id)"),
    "emissions_by_generator": ("energy", "SELECT gen_id, round(tonnes, 6) AS tonnes FROM energy"),
    "production_by_country": ("energy buses", "SELECT country, round(sum(tonnes), 6) AS tonnes, min(bus_id) AS first FROM energy JOIN buses USING (bus_id) GROUP BY country"),
    "by_carrier": ("energy", "SELECT carrier, round(sum(tonnes), 6) AS tonnes, round(sum(mwh), 6) AS mwh, round(CASE WHEN sum(mwh) > 1e-9 THEN sum(tonnes) / sum(mwh) END, 6) AS intensity FROM energy GROUP BY carrier"),
    "average_intensity": ("energy", "SELECT round(sum(tonnes), 6) AS tonnes, round(sum(mwh), 6) AS mwh, round(sum(tonnes) / sum(mwh), 6) AS intensity FROM energy"),
    "marginal_unit": ("merit gens snaps", """SELECT t, gen_id, co2 FROM (SELECT t, gen_id, co2, row_number() OVER (PARTITION BY t ORDER BY rank, CASE WHEN rank = 1 THEN cost END, gen_id) AS k FROM (SELECT s.t, g.gen_id, g.co2, g.cost,
        CASE WHEN coalesce(m.mw, 0) > 1e-6 AND coalesce(m.mw, 0) < g.p_nom - 1e-6 THEN 0 WHEN coalesce(m.mw, 0) <= 1e-6 AND g.p_nom > 1e-6 THEN 1 END AS rank FROM gens g CROSS JOIN snaps s LEFT JOIN merit m ON m.gen_id = g.gen_id AND m.t = s.t) WHERE rank IS NOT NULL) WHERE k = 1"""),
    "lp_cols_dispatch": ("avail gens factors", """SELECT CAST(gen_id AS BIGINT) AS id, t, round(CASE WHEN ext OR uc THEN 0.0 ELSE least(p_nom * p_min, p_nom * a) END, 6) AS lower, round(CASE WHEN ext THEN 1000.0 * a ELSE p_nom * a END, 6) AS upper,
        round((cost + 5.0 * co2) * factor, 6) AS obj FROM avail JOIN gens USING (gen_id) JOIN factors USING (t)"""),
    "lp_rhs_balance": ("buses snaps need", "SELECT CAST(b.bus_id AS BIGINT) AS id, s.t, round(coalesce(d, 0.0), 6) AS lower, round(coalesce(d, 0.0), 6) AS upper FROM buses b CROSS JOIN snaps s LEFT JOIN (SELECT bus_id, t, sum(mw) AS d FROM need GROUP BY 1, 2) n ON n.bus_id = b.bus_id AND n.t = s.t"),
    "lp_rows_balance": ("gens incidence stores links buses loads snaps need", """SELECT CAST(bus_id AS BIGINT) AS id, cfamily, CAST(sum(m) AS BIGINT) AS n, round(sum(v * m), 6) AS val FROM (
        SELECT bus_id, 'dispatch' AS cfamily, 1.0::DOUBLE AS v, n AS m FROM gens, h UNION ALL SELECT bus_id, 'flow', sign, n FROM incidence, h UNION ALL SELECT bus_id, 'discharge', 1.0, n FROM stores, h UNION ALL SELECT bus_id, 'charge', -1.0, n FROM stores, h
        UNION ALL SELECT bus0, 'link_flow', -1.0, n FROM links, h UNION ALL SELECT bus1, 'link_flow', 0.97, n FROM links, h UNION ALL SELECT bus_id, 'line_loss', -0.5, n FROM incidence, h WHERE loss > 0 UNION ALL SELECT bus_id, 'shed', 1.0, n FROM buses, h
        UNION ALL SELECT bus_id, 'interrupt_mw', 1.0, n FROM loads, h WHERE imw > 0 AND imax > 0 UNION ALL SELECT bus_id, 'load_shift', -1.0, n FROM loads, h WHERE pu > 0 AND load_id IN (SELECT load_id FROM need WHERE mw > 0)) GROUP BY bus_id, cfamily"""),
    "lp_rows_dcflow": ("lines snaps", """SELECT CAST(line_id AS BIGINT) AS id, 0 AS k, t, round(-b * phase, 6) AS lower, round(-b * phase, 6) AS upper, x.f AS cfamily, CAST(x.c AS BIGINT) AS cid, 0 AS ck, t AS ct, round(x.v, 6) AS val
        FROM (SELECT *, unnest([{'f': 'flow', 'c': line_id, 'v': 1.0::DOUBLE}, {'f': 'angle', 'c': bus0, 'v': -b}, {'f': 'angle', 'c': bus1, 'v': b}]) AS x FROM lines WHERE b > 0), snaps"""),
    "lp_rows_storage": ("stores snaps horizon", """SELECT CAST(r.storage_id AS BIGINT) AS id, 0 AS k, r.t, round(rhs, 6) AS lower, round(rhs, 6) AS upper, cfamily, CAST(cid AS BIGINT) AS cid, 0 AS ck, ct, round(val, 6) AS val FROM
        (SELECT storage_id, t, CAST((t * 3 + storage_id * 5) % 17 AS DOUBLE) * weight + CASE WHEN t = 0 THEN coalesce(soc0, 0.0) ELSE 0.0 END AS rhs FROM stores, snaps) r JOIN (
        SELECT storage_id, t, 'soc' AS cfamily, storage_id AS cid, t AS ct, 1.0::DOUBLE AS val FROM stores, snaps UNION ALL
        SELECT storage_id, t, 'soc', storage_id, CAST(CASE WHEN t > 0 THEN t - 1 ELSE n - 1 END AS INT), -1.0 FROM stores, snaps, horizon WHERE t > 0 OR (cyclic AND soc0 IS NULL) UNION ALL
        SELECT storage_id, t, 'charge', storage_id, t, -0.9::DOUBLE * weight FROM stores, snaps UNION ALL SELECT storage_id, t, 'discharge', storage_id, t, weight / 0.8::DOUBLE FROM stores, snaps UNION ALL
        SELECT storage_id, t, 'spill', storage_id, t, weight FROM stores, snaps WHERE spills UNION ALL
        SELECT down, t, f, storage_id, CAST(t - lag AS INT), -weight FROM stores, snaps, (VALUES ('discharge'), ('spill')) v(f) WHERE down IS NOT NULL AND lag <= t AND (f = 'discharge' OR spills)) c ON c.storage_id = r.storage_id AND c.t = r.t"""),
    "lp_rows_ramps": ("gens snaps", """SELECT CAST(gen_id AS BIGINT) AS id, k, t, round(lower, 6) AS lower, round(upper, 6) AS upper, 'dispatch' AS cfamily, CAST(gen_id AS BIGINT) AS cid, 0 AS ck, CAST(t - d AS INT) AS ct, CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS val FROM (
        SELECT gen_id, 0 AS k, '-inf'::DOUBLE AS lower, ramp_up * p_nom AS upper FROM gens WHERE ramp_up > 0 AND ramp_up < 1 UNION ALL SELECT gen_id, 1, -ramp_down * p_nom, 'inf'::DOUBLE FROM gens WHERE ramp_down > 0 AND ramp_down < 1), snaps, range(2) r(d) WHERE t >= 1"""),
    "lp_rows_commitment": ("avail gens horizon", """SELECT CAST(gen_id AS BIGINT) AS id, k, t, lower, upper, cfamily, CAST(gen_id AS BIGINT) AS cid, 0 AS ck, CAST(ct AS INT) AS ct, round(val, 6) AS val FROM (WITH u AS (SELECT * FROM avail JOIN gens USING (gen_id) CROSS JOIN horizon WHERE uc)
        SELECT gen_id, 0 AS k, t, '-inf'::DOUBLE AS lower, 0.0::DOUBLE AS upper, 'dispatch' AS cfamily, t AS ct, 1.0::DOUBLE AS val FROM u UNION ALL SELECT gen_id, 0, t, '-inf'::DOUBLE, 0.0, 'status', t, -p_nom * a FROM u UNION ALL
        SELECT gen_id, 1, t, 0.0, 'inf'::DOUBLE, 'dispatch', t, 1.0 FROM u WHERE p_nom * p_min * a > 0 UNION ALL SELECT gen_id, 1, t, 0.0, 'inf'::DOUBLE, 'status', t, -p_nom * p_min * a FROM u WHERE p_nom * p_min * a > 0 UNION ALL
        SELECT gen_id, 2, t, 0.0, 0.0, 'status', t, 1.0 FROM u UNION ALL SELECT gen_id, 2, t, 0.0, 0.0, 'status', CASE WHEN t > 0 THEN t - 1 ELSE n - 1 END, -1.0 FROM u UNION ALL SELECT gen_id, 2, t, 0.0, 0.0, 'start_up', t, -1.0 FROM u UNION ALL SELECT gen_id, 2, t, 0.0, 0.0, 'shut_down', t, 1.0 FROM u UNION ALL
        SELECT gen_id, 3, t, '-inf'::DOUBLE, 0.0, 'start_up', s, 1.0 FROM u, range(4) r(d), LATERAL (SELECT t - d AS s) WHERE up > 1 AND t + 1 >= up AND d < up UNION ALL SELECT gen_id, 3, t, '-inf'::DOUBLE, 0.0, 'status', t, -1.0 FROM u WHERE up > 1 AND t + 1 >= up UNION ALL
        SELECT gen_id, 4, t, '-inf'::DOUBLE, 1.0, 'shut_down', s, 1.0 FROM u, range(4) r(d), LATERAL (SELECT t - d AS s) WHERE down > 1 AND t + 1 >= down AND d < down UNION ALL SELECT gen_id, 4, t, '-inf'::DOUBLE, 1.0, 'status', t, 1.0 FROM u WHERE down > 1 AND t + 1 >= down)"""),
    "lp_rows_losses": ("lines snaps", """SELECT CAST(line_id AS BIGINT) AS id, CAST(k AS INT) AS k, t, 0.0::DOUBLE AS lower, 'inf'::DOUBLE AS upper, f AS cfamily, CAST(line_id AS BIGINT) AS cid, 0 AS ck, t AS ct, round(CASE WHEN f = 'line_loss' THEN 1.0::DOUBLE WHEN k = 0 THEN -loss ELSE loss END, 6) AS val
        FROM lines, snaps, range(2) r(k), (VALUES ('line_loss'), ('flow')) v(f) WHERE loss > 0"""),
    "lp_rows_reserve": ("buses need avail gens stores", """SELECT CAST(first AS BIGINT) AS id, round(coalesce(peak, 0.0) * 1.1::DOUBLE - coalesce(firm, 0.0), 6) AS lower, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(val, 0.0), 6) AS val FROM (SELECT area, min(bus_id) AS first FROM buses GROUP BY area) a
        LEFT JOIN (SELECT area, max(mw) AS peak FROM (SELECT area, t, sum(mw) AS mw FROM need JOIN buses USING (bus_id) GROUP BY area, t) GROUP BY area) USING (area)
        LEFT JOIN (SELECT area, sum(f) AS firm, sum(CASE WHEN ext THEN 3 ELSE 0 END) AS n, sum(CASE WHEN ext THEN 3 * credit ELSE 0 END) AS val FROM (SELECT bus_id, p_nom * credit AS f, ext, credit FROM gens JOIN (SELECT gen_id, least(min(a), 1.0) AS credit FROM avail GROUP BY gen_id) USING (gen_id) WHERE credit > 0
        UNION ALL SELECT bus_id, p_nom, false, 1.0 FROM stores) JOIN buses USING (bus_id) GROUP BY area) USING (area)"""),
    "lp_budget_co2": ("gens snaps", "SELECT 'dispatch' AS cfamily, CAST(gen_id AS BIGINT) AS cid, 0 AS ck, t AS ct, round(co2 * weight, 6) AS val FROM gens, snaps WHERE co2 > 0 UNION ALL SELECT 'gen_capacity', CAST(gen_id AS BIGINT), CAST(q AS INT), 0, round(embodied, 6) FROM gens, range(3) r(q) WHERE ext AND embodied > 0"),
    "lp_budget_water": ("gens snaps", "SELECT 'dispatch' AS cfamily, CAST(gen_id AS BIGINT) AS cid, 0 AS ck, t AS ct, round(water * weight, 6) AS val FROM gens, snaps WHERE water > 0"),
    "lp_budget_land": ("gens", "SELECT 'gen_capacity' AS cfamily, CAST(gen_id AS BIGINT) AS cid, CAST(q AS INT) AS ck, 0 AS ct, round(land, 6) AS val FROM gens, range(3) r(q) WHERE ext AND land > 0"),
    "sync_areas": ("buses lines", """SELECT bus_id, 'sync' || min(root) AS area FROM (WITH RECURSIVE e AS (SELECT bus0 AS u, bus1 AS v FROM lines WHERE b > 0 UNION SELECT bus1, bus0 FROM lines WHERE b > 0), walk(bus_id, root) AS (SELECT bus_id, bus_id FROM buses UNION SELECT e.v, root FROM walk JOIN e ON e.u = walk.bus_id) SELECT * FROM walk) GROUP BY bus_id"""),
    "csc_transpose": ("lines snaps horizon", """SELECT col, n, first, round(val, 6) AS val FROM (WITH ac AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS r FROM lines WHERE b > 0), fl AS (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS c FROM lines),
        ang AS (SELECT bus_id, row_number() OVER (ORDER BY bus_id) - 1 AS c FROM (SELECT bus0 AS bus_id FROM ac UNION SELECT bus1 FROM ac)), nl AS (SELECT count(*) AS nl FROM lines),
        e AS (SELECT r * n + t AS row, fl.c * n + t AS col, 1.0::DOUBLE AS val FROM ac JOIN fl USING (line_id), snaps, horizon UNION ALL SELECT r * n + t, (nl + c) * n + t, -b FROM ac JOIN ang ON bus_id = bus0, snaps, horizon, nl UNION ALL SELECT r * n + t, (nl + c) * n + t, b FROM ac JOIN ang ON bus_id = bus1, snaps, horizon, nl)
        SELECT CAST(col AS BIGINT) AS col, count(*) AS n, CAST(min(row) AS BIGINT) AS first, sum(val) AS val FROM e GROUP BY col)"""),
}

INF = "'inf'::DOUBLE"


def _terms(rows: str) -> str:
    """Rows ``(id, k, t, lower, upper, cfamily, cid, ck, ct, val)`` in the types and to the places of the engine's."""
    return f"""SELECT CAST(id AS BIGINT) AS id, CAST(k AS INT) AS k, CAST(t AS INT) AS t, round(CAST(lower AS DOUBLE), 6) AS lower, round(CAST(upper AS DOUBLE), 6) AS upper, cfamily, CAST(cid AS BIGINT) AS cid, CAST(ck AS INT) AS ck, CAST(ct AS INT) AS ct,
        round(CAST(val AS DOUBLE), 6) AS val FROM ({rows}) AS r(id, k, t, lower, upper, cfamily, cid, ck, ct, val)"""


def _family(name: str, lower: str, upper: str, rest: str, ints: int = 0) -> str:
    """A line of the report on column families; bounds are summed in millionths, infinite ones left out."""
    total = lambda x: f"coalesce(sum(CASE WHEN abs({x}) < {INF} THEN CAST(round({x} * 1e6) AS HUGEINT) END), 0)::DOUBLE / 1e6"
    return f"SELECT '{name}' AS family, count(*) AS n, round({total(f'CAST({lower} AS DOUBLE)')}, 6) AS lower, round({total(f'CAST({upper} AS DOUBLE)')}, 6) AS upper, count(*) * {ints} AS ints FROM {rest} HAVING count(*) > 0"


TWINS |= {
    "violations_planted": ("gens buses lines loads stores snaps horizon profile", """SELECT code, CAST(id AS BIGINT) AS component_id FROM (WITH l AS (SELECT line_id, CASE WHEN line_id % 23 = 0 THEN 999 ELSE bus0 END AS b0, CASE WHEN line_id % 29 = 0 THEN bus0 ELSE bus1 END AS b1, b, CASE WHEN line_id % 31 = 0 THEN -1 ELSE s_nom END AS s FROM lines)
        SELECT 'bad_weight' AS code, t AS id FROM snaps WHERE t % 50 = 7 UNION ALL SELECT 'generator_bus', gen_id FROM gens WHERE gen_id % 13 = 0 UNION ALL SELECT 'generator_p_nom', gen_id FROM gens WHERE gen_id % 11 = 0 UNION ALL SELECT 'generator_p_min_pu', gen_id FROM gens WHERE gen_id % 17 = 0 UNION ALL
        SELECT 'co2_emissions', gen_id FROM gens WHERE gen_id % 19 = 0 UNION ALL SELECT 'generator_ceiling', gen_id FROM gens WHERE ext AND gen_id % 2 = 0 UNION ALL SELECT 'line_bus0', line_id FROM l WHERE b0 = 999 UNION ALL SELECT 'self_loop', line_id FROM l WHERE b0 = b1 UNION ALL SELECT 'line_s_nom', line_id FROM l WHERE s < 0 UNION ALL
        SELECT 'line_across_areas', line_id FROM l JOIN buses a ON a.bus_id = b0 JOIN buses z ON z.bus_id = b1 WHERE b > 0 AND a.area <> z.area UNION ALL SELECT 'extendable_line', line_id FROM l WHERE line_id % 37 = 0 AND b > 0 UNION ALL SELECT 'line_ceiling', line_id FROM l WHERE line_id % 37 = 0 AND s > 0 UNION ALL
        SELECT 'load_bus', load_id FROM loads WHERE load_id % 6 = 0 UNION ALL SELECT 'storage_bus', storage_id FROM stores WHERE storage_id = 2 UNION ALL SELECT 'storage_efficiency', storage_id FROM stores WHERE storage_id IN (3, 4) UNION ALL SELECT 'storage_max_hours', storage_id FROM stores WHERE storage_id = 5 UNION ALL SELECT 'storage_ceiling', storage_id FROM stores WHERE storage_id = 1 UNION ALL
        SELECT 'profile_shape', load_id FROM (SELECT load_id, count(DISTINCT t) AS c FROM profile GROUP BY load_id) JOIN loads USING (load_id) CROSS JOIN horizon WHERE c <> n)"""),
    "consumption_by_country": ("loads facts gens buses", """SELECT country, round(sum(greatest(p_set - 1.0, 0.0) * i), 3) AS tonnes FROM loads JOIN (SELECT t, bus_id, sum(mw * co2) / sum(mw) AS i FROM facts JOIN gens USING (gen_id) GROUP BY 1, 2) USING (bus_id) JOIN buses USING (bus_id) GROUP BY country"""),
    "losses_carbon": ("lines facts gens", """SELECT line_id, round(sum(mw * 0.5 * (p.i + q.i)), 3) AS tonnes FROM (SELECT line_id, bus0, bus1, t, abs((line_id * 31 + t * 17) % 41 - 20) * loss AS mw FROM lines, (SELECT DISTINCT t FROM facts))
        JOIN (SELECT t, bus_id AS bus0, sum(mw * co2) / sum(mw) AS i FROM facts JOIN gens USING (gen_id) GROUP BY 1, 2) p USING (t, bus0) JOIN (SELECT t, bus_id AS bus1, sum(mw * co2) / sum(mw) AS i FROM facts JOIN gens USING (gen_id) GROUP BY 1, 2) q USING (t, bus1) WHERE mw > 0 GROUP BY line_id"""),
    "embodied_carbon": ("gens", "SELECT round(coalesce(sum(p_nom / 2 * embodied), 0.0), 6) AS tonnes FROM gens WHERE ext"),
    "line_loading": ("lines facts", """SELECT line_id, round(l, 6) AS loading, round(m, 6) AS mean_flow, coalesce(l >= 0.995, false) AS binding FROM (SELECT line_id, CASE WHEN line_id % 11 <> 0 AND line_id % 21 <> 0 THEN max(abs(f)) / (line_id % 21)::DOUBLE END AS l, avg(f) AS m
        FROM (SELECT line_id, ((line_id * 31 + t * 17) % 41 - 20)::DOUBLE AS f FROM lines, (SELECT DISTINCT t FROM facts)) GROUP BY line_id)"""),
    "mean_load": ("profile", "SELECT load_id, round(avg(value), 6) AS mean FROM profile WHERE value > 0 GROUP BY load_id HAVING count(*) > 10"),
    "line_voltage_band": ("lines", """SELECT line_id, kv, CASE WHEN kv >= 500 THEN 500 WHEN kv >= 380 THEN 380 WHEN kv >= 300 THEN 300 WHEN kv >= 220 THEN 220 WHEN kv >= 110 THEN 110 ELSE 0 END AS band FROM (SELECT line_id, CAST(greatest(bus0 * 37 % 500, bus1 * 37 % 500) AS DOUBLE) AS kv FROM lines)"""),
    "voltages_stated": ("buses", "SELECT count(DISTINCT bus_id * 37 % 500) FILTER (bus_id * 37 % 500 >= 1) >= 2 AS stated FROM buses"),
    "shown_buses": ("buses", "SELECT 'hidden' AS filter, bus_id FROM buses WHERE area NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'only', bus_id FROM buses WHERE area = 'ASIA'"),
    "places_within": ("", """SELECT place_id, r AS rank FROM (SELECT s_suppkey AS place_id, s_suppkey * 37 % 400 / 10.0 - 10 AS x, s_suppkey * 53 % 300 / 10.0 + 35 AS y, s_suppkey * 7919 % 1000 * 10000 + s_suppkey AS r FROM supplier) WHERE x BETWEEN -5 AND 20 AND y BETWEEN 40 AND 60 ORDER BY r LIMIT 15"""),
    "population_weight": ("buses", """SELECT bus_id, round(1 + coalesce(sum(w), 0.0), 3) AS weight FROM buses LEFT JOIN (SELECT bus_id, pop * share / sum(share) OVER (PARTITION BY place_id) AS w FROM (SELECT place_id, pop, bus_id, 1 / greatest(d * d, 0.0025) AS share, row_number() OVER (PARTITION BY place_id ORDER BY d, bus_id) AS k
        FROM (SELECT s_suppkey AS place_id, s_suppkey * 1000.0::DOUBLE AS pop, bus_id, sqrt(pow(s_suppkey * 37 % 400 / 10.0::DOUBLE - 10 - x, 2) + pow(s_suppkey * 53 % 300 / 10.0::DOUBLE + 35 - y, 2)) AS d FROM supplier, buses) WHERE d < 3) WHERE k <= 5) USING (bus_id) GROUP BY bus_id"""),
    "axis_fit": ("profile", "SELECT round(min(-value), 6) AS low, round(CASE WHEN min(-value) < 0 THEN greatest(max(-value), 0.0) ELSE max(-value) END, 6) AS high FROM profile"),
    "full_stack": ("facts gens", """SELECT t, kind, id, mw, sum(mw) OVER (PARTITION BY t ORDER BY kind, cost, id ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT t, 'generator' AS kind, gen_id AS id, mw, cost FROM facts JOIN gens USING (gen_id)
        UNION ALL SELECT t, 'storage', 3, greatest(CAST(t % 7 - 2 AS DOUBLE), 0.0), 'inf'::DOUBLE FROM (SELECT DISTINCT t FROM facts))"""),
    "label_order": ("buses gens loads incidence", """SELECT bus_id, CAST(row_number() OVER (ORDER BY CASE WHEN bus_id IN (7, 3) THEN 0 ELSE 1 END, weight DESC, name, bus_id) AS INT) AS place FROM (SELECT b.bus_id, name, coalesce(sum(w), 0.0) AS weight FROM buses b LEFT JOIN
        (SELECT bus_id, 2 * p_nom AS w FROM gens UNION ALL SELECT bus_id, abs(p_set) FROM loads UNION ALL SELECT bus_id, 25.0 FROM incidence) p ON p.bus_id = b.bus_id GROUP BY b.bus_id, name)"""),
    "hvdc_ties": ("links buses", """SELECT CAST(link_id AS INT) AS link_id, 'tie' || link_id AS name, bus0, bus1, p_nom, 0.97::DOUBLE AS efficiency FROM links UNION ALL SELECT CAST((SELECT max(link_id) FROM links) + row_number() OVER (ORDER BY name) AS INT), name, b0, b1, 500.0, round(e, 6) FROM (
        SELECT 'dc' || bus_id || '_fwd' AS name, bus_id AS b0, bus_id + 10 AS b1, greatest(0.0, least(1.0, 1 - 0.03::DOUBLE * (bus_id * 200.0::DOUBLE) / 1000)) AS e FROM buses WHERE bus_id < 4 UNION ALL SELECT 'dc' || bus_id || '_rev', bus_id + 10, bus_id, greatest(0.0, least(1.0, 1 - 0.03::DOUBLE * (bus_id * 200.0::DOUBLE) / 1000)) FROM buses WHERE bus_id < 4)"""),
    "contingencies_all_lines": ("lines", "SELECT line_id FROM lines WHERE b > 0"),
    "first_appearance": ("gens", "SELECT carrier, min(gen_id) AS first FROM gens GROUP BY carrier"),
    "scatter_back": ("gens", "SELECT gen_id, CASE WHEN gen_id % 3 = 0 THEN p_nom ELSE 0.0 END AS value FROM gens"),
    "scalar_formulas": ("lines", """SELECT line_id, round(greatest(0.0, least(1.0, 1 - 0.03::DOUBLE * s_nom / 1000)), 6) AS dc, round(CASE WHEN z >= 1e-12 THEN r / z END, 6) AS g, round(CASE WHEN z >= 1e-12 THEN -x / z END, 6) AS b, round(greatest(1e-6::DOUBLE, 0.4 + (1 - 0.4::DOUBLE) * greatest(0.0, least(1.0, s_nom / 1000))), 6) AS head,
        lo + hi AS slope, -lo * hi AS start, CASE WHEN kv >= 700 THEN 4000.0 WHEN kv >= 500 THEN 2500.0 WHEN kv >= 360 THEN 1700.0 WHEN kv >= 280 THEN 1200.0 WHEN kv >= 200 THEN 550.0 WHEN kv >= 100 THEN 180.0 ELSE 100.0 END::DOUBLE AS thermal,
        round(greatest(0.5::DOUBLE, least(5000.0::DOUBLE, kv * kv / (0.3::DOUBLE * s_nom * 100.0) * 2.0)), 6) AS susceptance, CAST(greatest(-32767, least(32767, round(s_nom / 500.0::DOUBLE * 32767))) AS INT) AS steps
        FROM (SELECT *, r * r + x * x AS z FROM (SELECT line_id, s_nom, line_id % 10 * 0.01::DOUBLE AS r, line_id % 3 * 0.1::DOUBLE AS x, -CAST(line_id % 5 AS DOUBLE) AS lo, CAST(line_id % 7 AS DOUBLE) AS hi, CAST(line_id % 8 * 100 AS DOUBLE) AS kv FROM lines))"""),
    "envelope_planes": ("lines", """SELECT line_id, unnest([yl, yu, yl, yu]) AS a, unnest([xl, xu, xu, xl]) AS b, unnest([-xl * yl, -xu * yu, -xu * yl, -xl * yu]) AS c, unnest([true, true, false, false]) AS at_least
        FROM (SELECT line_id, (line_id % 5)::DOUBLE AS xl, (line_id % 5 + 3)::DOUBLE AS xu, (line_id % 4)::DOUBLE AS yl, (line_id % 4 + 2)::DOUBLE AS yu FROM lines)"""),
    "text_formulas": ("buses", """SELECT bus_id, x AS lon, y AS lat, round(ln(tan(pi() / 4 + radians(greatest(-85.0, least(85.0, y))) / 2)), 6) AS mercator, abs(x * 10) <= 180 AND abs(y) <= 90 AS placed, CAST(bus_id AS VARCHAR) AS kv, ['storage', 'lignite', 'coal', 'wind', 'other'][bus_id % 5 + 1] AS fuel,
        substring(repeat(name, 40), 1, 255) AS cut, '&lt;a &amp; &apos;b&apos;&gt; ' || name AS xml, strftime(to_timestamp(bus_id * 86401)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS time,
        CASE WHEN bus_id % 3 = 0 THEN 'country' WHEN bus_id % 3 = 1 THEN 'region' WHEN bus_id * 10000 >= 100000 THEN 'city' ELSE 'town' END AS kind FROM buses"""),
    "lp_rows_ties": ("avail gens pmap", _terms(f"""WITH u AS (SELECT *, p_min * a AS low FROM avail JOIN gens USING (gen_id) JOIN pmap USING (t) WHERE ext)
        SELECT gen_id, 0, t, -{INF}, a * p_nom, 'dispatch', gen_id, 0, t, 1.0 FROM u UNION ALL SELECT gen_id, 0, t, -{INF}, a * p_nom, 'gen_capacity', gen_id, q, 0, -a FROM u, range(3) g(q) WHERE q <= period UNION ALL
        SELECT gen_id, 1, t, low * p_nom, {INF}, 'dispatch', gen_id, 0, t, 1.0 FROM u WHERE p_min > 0 UNION ALL SELECT gen_id, 1, t, low * p_nom, {INF}, 'gen_capacity', gen_id, q, 0, -low FROM u, range(3) g(q) WHERE q <= period AND p_min > 0""")),
    "lp_rows_shift": ("need loads horizon", _terms(f"""WITH u AS (SELECT l.*, t, mw, n, least(pu, 1.0) * mw AS most, CASE WHEN win = 0 OR win > n THEN n ELSE win END AS w FROM need JOIN loads l USING (load_id), horizon WHERE pu > 0 AND load_id IN (SELECT load_id FROM need WHERE mw > 0))
        SELECT load_id, 0, t // w, 0.0, 0.0, 'load_shift', load_id, 0, t, 1.0 FROM u UNION ALL SELECT load_id, 1, t, -{INF}, 0.0, 'load_shift', load_id, 0, t, 1.0 FROM u WHERE shift_cost > 0 UNION ALL SELECT load_id, 1, t, -{INF}, 0.0, 'load_shift_abs', load_id, 0, t, -1.0 FROM u WHERE shift_cost > 0 UNION ALL
        SELECT load_id, 2, t, -{INF}, 0.0, 'load_shift', load_id, 0, t, -1.0 FROM u WHERE shift_cost > 0 UNION ALL SELECT load_id, 2, t, -{INF}, 0.0, 'load_shift_abs', load_id, 0, t, -1.0 FROM u WHERE shift_cost > 0 UNION ALL SELECT load_id, 3, t, -most, most, 'load_shift', load_id, 0, t, 1.0 FROM u""")),
    "lp_rows_interrupt": ("loads snaps", _terms(f"""WITH u AS (SELECT * FROM loads, snaps WHERE imw > 0 AND imax > 0) SELECT load_id, 0, t, -{INF}, 0.0, 'interrupt_mw', load_id, 0, t, 1.0 FROM u UNION ALL SELECT load_id, 0, t, -{INF}, 0.0, 'interrupt', load_id, 0, t, -imw FROM u UNION ALL SELECT load_id, 1, 0, -{INF}, imax, 'interrupt', load_id, 0, t, 1.0 FROM u""")),
    "lp_rows_head": ("stores snaps horizon", _terms(f"""WITH u AS (SELECT *, p_nom * 0.5 / (p_nom * hours) AS slope, p_nom * 0.5 + CASE WHEN t = 0 AND soc0 IS NOT NULL THEN p_nom * 0.5 / (p_nom * hours) * soc0 ELSE 0.0 END AS top FROM stores, snaps, horizon)
        SELECT storage_id, 0, t, -{INF}, top, 'discharge', storage_id, 0, t, 1.0 FROM u UNION ALL SELECT storage_id, 0, t, -{INF}, top, 'soc', storage_id, 0, CASE WHEN t = 0 THEN n - 1 ELSE t - 1 END, -slope FROM u WHERE t > 0 OR (soc0 IS NULL AND cyclic)""")),
    "lp_rows_head_bands": ("stores snaps horizon", _terms(f"""WITH u AS (SELECT *, p_nom * hours AS e, t = 0 AND (soc0 IS NOT NULL OR NOT cyclic) AS fixed, CASE WHEN t = 0 THEN n - 1 ELSE t - 1 END AS prev FROM stores, snaps, horizon),
        v AS (SELECT *, CASE WHEN b = least(floor(coalesce(soc0, 0.0) / e * 3), 2) THEN 1.0 ELSE 0.0 END AS pin FROM u, range(3) g(b))
        SELECT storage_id, 0, t, 1.0, 1.0, 'head_band', storage_id, b, t, 1.0 FROM v UNION ALL SELECT storage_id, 1, t, 0.0, 0.0, 'discharge', storage_id, 0, t, 1.0 FROM u UNION ALL SELECT storage_id, 1, t, 0.0, 0.0, 'head_discharge', storage_id, b, t, -1.0 FROM v UNION ALL
        SELECT storage_id, 2 + 4 * b, t, -{INF}, 0.0, 'head_discharge', storage_id, b, t, 1.0 FROM v UNION ALL SELECT storage_id, 2 + 4 * b, t, -{INF}, 0.0, 'head_band', storage_id, b, t, -p_nom FROM v UNION ALL SELECT storage_id, 3 + 4 * b, t, pin, pin, 'head_band', storage_id, b, t, 1.0 FROM v WHERE fixed UNION ALL
        SELECT storage_id, 4 + 4 * b, t, -{INF}, e - e * b / 3, 'soc', storage_id, 0, prev, -1.0 FROM v WHERE NOT fixed UNION ALL SELECT storage_id, 4 + 4 * b, t, -{INF}, e - e * b / 3, 'head_band', storage_id, b, t, e FROM v WHERE NOT fixed UNION ALL
        SELECT storage_id, 5 + 4 * b, t, -{INF}, e * (b + 1) / 3 + e, 'soc', storage_id, 0, prev, 1.0 FROM v WHERE NOT fixed UNION ALL SELECT storage_id, 5 + 4 * b, t, -{INF}, e * (b + 1) / 3 + e, 'head_band', storage_id, b, t, e FROM v WHERE NOT fixed""")),
    "lp_cols": ("avail gens lines stores snaps links loads need buses", " UNION ALL ".join([
        _family("dispatch", "CASE WHEN ext OR uc THEN 0.0 ELSE least(p_nom * p_min, p_nom * a) END", "CASE WHEN ext THEN 1000.0 * a ELSE p_nom * a END", "avail JOIN gens USING (gen_id)"),
        _family("gen_capacity", "0", "1000", "gens, range(3) WHERE ext"), _family("flow", "-s_nom", "s_nom", "lines, snaps"), _family("soc", "0", "p_nom * hours", "stores, snaps"), _family("charge", "0", "p_nom", "stores, snaps"), _family("discharge", "0", "p_nom", "stores, snaps"),
        _family("line_loss", "0", INF, "lines, snaps WHERE loss > 0"), _family("link_flow", "0", "p_nom", "links, snaps"), _family("interrupt", "0", "1", "loads, snaps WHERE imw > 0 AND imax > 0", 1), _family("interrupt_mw", "0", "imw", "loads, snaps WHERE imw > 0 AND imax > 0"),
        _family("load_shift", "-m", "m", "(SELECT least(pu, 1.0) * greatest(max(mw) OVER (PARTITION BY load_id), 0.0) AS m FROM need JOIN loads USING (load_id) WHERE pu > 0) WHERE m > 0"),
        _family("load_shift_abs", "0", INF, "need JOIN loads USING (load_id) WHERE pu > 0 AND shift_cost > 0 AND load_id IN (SELECT load_id FROM need WHERE mw > 0)"),
        _family("status", "0", "1", "gens, snaps WHERE uc", 1), _family("start_up", "0", "1", "gens, snaps WHERE uc"), _family("shut_down", "0", "1", "gens, snaps WHERE uc"), _family("spill", "0", INF, "stores, snaps WHERE spills"), _family("shed", "0", INF, "buses, snaps"),
        _family("angle", "CASE WHEN first THEN 0.0 ELSE -'inf'::DOUBLE END", "CASE WHEN first THEN 0.0 ELSE 'inf'::DOUBLE END", "(SELECT min(bus_id) OVER (PARTITION BY area) = bus_id AS first FROM buses), snaps"),
    ])),
}

#: A column for each nation's load, as the report names them.
TWINS["results_pivot"] = ("profile loads", "SELECT t, " + ", ".join(f"round(max(CASE WHEN load_id = {k} THEN value END), 6) AS load{k}" for k in range(25)) + " FROM profile JOIN loads USING (load_id) GROUP BY t")


def sql(name: str) -> str:
    """The query with the expressions that it needs in front."""
    wanted, body = TWINS[name]
    ordered: list[str] = []

    def need(part: str) -> None:
        if part not in ordered:
            for p in PARTS[part][0].split():
                need(p)
            ordered.append(part)

    for p in wanted.split():
        need(p)
    ctes = [f"{p} AS ({PARTS[p][1]})" for p in ordered]
    if name == "lp_rows_balance":
        ctes.append("h AS (SELECT count(*) AS n FROM snaps)")
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


ORACLE_SQL = {name: sql(name) for name in TWINS}
