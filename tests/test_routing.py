"""What-if semantics (S4-S10) on small hand-made inputs."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargoscope.operators import routing
from cargoscope.sources.fixtures import Fixtures

ROUTE_SCHEMA = ("route_id string, origin_hub string, destination_hub string, carrier_id string, "
                "estimated_transit_days double, base_cost_usd double, cost_per_kg_usd double, "
                "waypoints array<string>, carrier_ids_filter array<string>, active boolean")
SCEN_SCHEMA = ("scenario_id long, origin_hub string, destination_hub string, cargo_weight_kg double, "
               "carrier_ids array<string>, max_transit_days int, avoid_anomaly_routes boolean")
EV_SCHEMA = "event_id long, route_id string, anomaly_score double, event_time timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def carriers(spark):
    return spark.createDataFrame([("C1", "One"), ("C2", "Two")], "carrier_id string, carrier_name string")


def route(rid, cost, carrier="C1", days=2.0, filt=None, wp=None):
    return (rid, "A", "B", carrier, days, cost, 0.0, wp, filt, True)


def scen(sid=1, ids=(), days=7, avoid=True):
    return (sid, "A", "B", 100.0, list(ids), days, avoid)


def events(spark, rows):
    return spark.createDataFrame(rows, EV_SCHEMA)


def test_event_grain_fills_top10_with_one_route(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(i, "R1", 0.25, T0 + dt.timedelta(hours=i)) for i in range(15)])
    s = spark.createDataFrame([scen()], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), ev).collect()
    assert len(out) == 10 and {x.route_id for x in out} == {"R1"}
    assert sorted(x.event_id for x in out) == list(range(5, 15))  # newest ten


def test_route_grain_keeps_one_row_per_route(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(i, "R1", 0.25, T0 + dt.timedelta(hours=i)) for i in range(15)])
    s = spark.createDataFrame([scen()], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), ev, grain="route").collect()
    assert sorted(x.route_id for x in out) == ["R1", "R2"]


def test_window_is_31_rows(spark):
    r = spark.createDataFrame([route("R1", 10.0)], ROUTE_SCHEMA)
    # 40 events: the newest has score 1.0, the 31 before it... frame = newest 31
    rows = [(i, "R1", 1.0 if i >= 9 else 0.0, T0 + dt.timedelta(hours=i)) for i in range(40)]
    s = spark.createDataFrame([scen(avoid=False)], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), events(spark, rows)).collect()
    newest = max(out, key=lambda x: x.event_id)
    assert newest.event_id == 39 and newest.anomaly_risk_score == 1.0  # events 9..39 = 31 rows
    tenth = min(out, key=lambda x: x.event_id)
    assert tenth.event_id == 30 and tenth.anomaly_risk_score == pytest.approx(22 / 31)


def test_risk_drop_after_limit_is_not_backfilled(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(i, "R1", 1.0, T0 + dt.timedelta(hours=i)) for i in range(12)])
    s = spark.createDataFrame([scen(avoid=True)], SCEN_SCHEMA)
    assert routing.score_routes(s, r, carriers(spark), ev).count() == 0


def test_no_recommendation_when_cheapest_is_risky(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(1, "R1", 0.6, T0)])
    s = spark.createDataFrame([scen()], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), ev).collect()
    assert len(out) == 2 and not any(x.is_recommended for x in out)


def test_ties_recommend_several(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 10.0)], ROUTE_SCHEMA)
    s = spark.createDataFrame([scen()], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), events(spark, [])).collect()
    assert [x.is_recommended for x in out] == [True, True]


def test_carrier_rule(spark):
    r = spark.createDataFrame([
        route("R1", 1.0, carrier="C1", filt=None), route("R2", 2.0, carrier="C1", filt=[]),
        route("R3", 3.0, carrier="C1", filt=["C9"]), route("R4", 4.0, carrier="C2", filt=["C9"])],
        ROUTE_SCHEMA)
    s = spark.createDataFrame([scen(1, ids=["C2"]), scen(2, ids=[])], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), events(spark, [])).collect()
    got = {(x.scenario_id, x.route_id) for x in out}
    # Scenario 1 lists C2: R1/R2 pass (no own list), R3 fails, R4 passes (C2 listed).
    assert {rid for sid, rid in got if sid == 1} == {"R1", "R2", "R4"}
    assert {rid for sid, rid in got if sid == 2} == {"R1", "R2", "R3", "R4"}


def test_inactive_routes_and_unknown_carriers(spark):
    r = spark.createDataFrame([route("R1", 1.0, carrier="C7"), route("R2", 2.0)], ROUTE_SCHEMA)
    r = r.withColumn("active", F.lit(False))  # active is never filtered (S9)
    s = spark.createDataFrame([scen()], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), events(spark, [])).collect()
    assert [x.route_id for x in out] == ["R2"]  # inner join drops the unknown carrier


def test_transit_filter_and_waypoints(spark):
    r = spark.createDataFrame([route("R1", 1.0, days=9.0), route("R2", 2.0, wp=["X", "Y"])], ROUTE_SCHEMA)
    s = spark.createDataFrame([scen(days=7)], SCEN_SCHEMA)
    out = routing.route_options_display(routing.score_routes(s, r, carriers(spark), events(spark, [])))
    [row] = out.collect()
    assert row.route_id == "R2" and row.route_label == "X → Y" and row.risk_band == "low"


def test_scenario_bounds(spark):
    s = spark.createDataFrame([scen(days=31), (2, "A", "B", 0.05, [], 7, True), scen(3)], SCEN_SCHEMA)
    got = {r.scenario_id: r.reject_reason for r in routing.validate_scenarios(s).collect()}
    assert got == {1: "max_transit_days", 2: "cargo_weight_kg", 3: None}


def test_at_most_ten_rows_per_scenario(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    out = routing.score_routes(fx.scenarios(), fx.routes(), fx.carriers(), fx.anomaly_events())
    counts = out.groupBy("scenario_id").count().collect()
    assert all(c["count"] <= 10 for c in counts)


def brute_force_top_routes(spark, scen_rows, route_rows, k=10):
    """Every scenario x route pair of a lane, filtered, cheapest k per scenario."""
    out = {}
    for sid, o, d, w, ids, days, _ in scen_rows:
        cands = []
        for rid, ro, rd, carrier, tdays, base, pk, _, filt, _ in route_rows:
            if (ro, rd) != (o, d) or tdays > days or carrier not in ("C1", "C2"):
                continue
            if not (len(ids) == 0 or filt is None or len(filt) == 0 or carrier in ids):
                continue
            cands.append((base + w * pk, rid))
        out[sid] = sorted(cands)[:k]
    return out


@settings(max_examples=6, deadline=None)
@given(st.data())
def test_pruned_candidates_match_all_pairs(spark, data):
    rnd = data.draw(st.randoms(use_true_random=False))
    routes = []
    for i in range(rnd.randint(5, 80)):
        filt = rnd.choice([None, [], ["C9"]])
        routes.append((f"R{i:03d}", "A", rnd.choice(["B", "C"]), rnd.choice(["C1", "C2", "C7"]),
                       float(rnd.randint(1, 12)), float(rnd.randint(0, 20)),
                       rnd.choice([0.0, 0.5, 1.0, 2.0, rnd.uniform(-0.5, 3.0)]), None, filt, True))
    scens = []
    for j in range(rnd.randint(1, 12)):
        w = rnd.choice([0.1, 1.0, 3.7, 100.0, rnd.uniform(0.1, 50000.0), 50000.0])
        ids = rnd.choice([[], ["C1"], ["C2", "C1"], ["C2", "C2"]])
        scens.append((j, "A", rnd.choice(["B", "C"]), w, ids, rnd.randint(1, 30), False))
    r = spark.createDataFrame(routes, ROUTE_SCHEMA)
    s = spark.createDataFrame(scens, SCEN_SCHEMA)
    expected = brute_force_top_routes(spark, scens, routes)
    for levels in ((1,), (4, 64)):
        got = {}
        for row in routing.cheapest_routes(s, r, carriers(spark), levels=levels).collect():
            got.setdefault(row.scenario_id, []).append((row.estimated_cost_usd, row.route_id))
        for sid, rows in expected.items():
            assert sorted(got.get(sid, [])) == rows


def test_narrow_costs_on_one_lane_do_not_pair_up(spark):
    routes = [(f"R{i:03d}", "A", "B", "C1", 2.0, 500 + i / 10, 0.5, None, None, True) for i in range(500)]
    scens = [(j, "A", "B", 1.0 + j, [], 7, False) for j in range(200)]
    r, s = spark.createDataFrame(routes, ROUTE_SCHEMA), spark.createDataFrame(scens, SCEN_SCHEMA)
    points = s.select(F.col("origin_hub").alias("_o"), F.col("destination_hub").alias("_d"),
                      F.lit("all").alias("_group"), "max_transit_days", "cargo_weight_kg")
    assert routing.candidate_routes(points, r, carriers(spark)).count() == 200 * 10
    equal = r.withColumn("base_cost_usd", F.lit(500.0))
    assert routing.candidate_routes(points, equal, carriers(spark)).count() == 200 * 10


@pytest.mark.parametrize("through_one_point", [True, False])
def test_crossing_costs_keep_few_routes_per_weight(spark, through_one_point):
    """400 lines cross inside one narrow range of 400 weights, in one point or in many."""
    n = 400
    routes = []
    for i in range(n):
        pk = 1.0 + i / n
        at = 1000.0 if through_one_point else 1000.0 + (i % 97) / 97
        routes.append((f"R{i:03d}", "A", "B", "C1", 2.0, 5000.0 - at * pk + (0 if through_one_point else i / 40),
                       pk, None, None, True))
    scens = [(j, "A", "B", 1000.0 + j / n, [], 7, False) for j in range(n)]
    r, s = spark.createDataFrame(routes, ROUTE_SCHEMA), spark.createDataFrame(scens, SCEN_SCHEMA)
    points = s.select(F.col("origin_hub").alias("_o"), F.col("destination_hub").alias("_d"),
                      F.lit("all").alias("_group"), "max_transit_days", "cargo_weight_kg")
    per_point = routing.candidate_routes(points, r, carriers(spark)).groupBy("cargo_weight_kg").count()
    assert per_point.agg(F.max("count")).first()[0] <= routing.CROWDED * routing.TOP_K
    expected = brute_force_top_routes(spark, scens, routes)
    got = {}
    for row in routing.cheapest_routes(s, r, carriers(spark)).collect():
        got.setdefault(row.scenario_id, []).append((row.estimated_cost_usd, row.route_id))
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_rejected_scenarios_come_back_with_a_reason(spark):
    s = spark.createDataFrame([scen(1), (2, "A", "B", 0.01, [], 7, True)], SCEN_SCHEMA)
    r = spark.createDataFrame([route("R1", 10.0)], ROUTE_SCHEMA)
    options, rejected = routing.simulate_many(s, r, carriers(spark), events(spark, []))
    assert [x.scenario_id for x in options.collect()] == [1]
    assert [(x.scenario_id, x.reject_reason) for x in rejected.collect()] == [(2, "cargo_weight_kg")]


def test_risk_drop_is_strict(spark):
    r = spark.createDataFrame([route("R1", 10.0), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(1, "R1", 0.75, T0), (2, "R2", 0.875, T0)])
    s = spark.createDataFrame([scen(avoid=True)], SCEN_SCHEMA)
    out = routing.score_routes(s, r, carriers(spark), ev).collect()
    assert [(x.route_id, x.anomaly_risk_score, x.is_recommended) for x in out] == [("R1", 0.75, False)]


def test_simulate_single_request(spark):
    r = spark.createDataFrame([route("R1", 10.0, wp=["X"]), route("R2", 20.0)], ROUTE_SCHEMA)
    ev = events(spark, [(1, "R2", 0.25, T0)])
    out = routing.simulate(spark, {"origin_hub": "A", "destination_hub": "B", "cargo_weight_kg": 100.0},
                           r, carriers(spark), ev)
    assert [(o["route_id"], o["waypoints"], o["is_recommended"]) for o in out] == [
        ("R1", ["X"], True), ("R2", [], False)]


@pytest.mark.parametrize("bad", [{"cargo_weight_kg": 0.01}, {"cargo_weight_kg": 10.0, "max_transit_days": 31}])
def test_simulate_refuses_invalid_requests(spark, bad):
    r = spark.createDataFrame([route("R1", 10.0)], ROUTE_SCHEMA)
    with pytest.raises(routing.InvalidScenario):
        routing.simulate(spark, {"origin_hub": "A", "destination_hub": "B", **bad}, r, carriers(spark),
                         events(spark, []))
