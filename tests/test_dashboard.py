"""Dashboard operators on one row for each kind of shipment, and limits."""

import datetime as dt

import pytest

from cargoscope.operators import dashboard
from cargoscope.session import plan_text

NOW = dt.datetime(2026, 1, 1, 12)
DEMO = [  # shipment, status, open anomalies: every status, alerts with and without it
    ("q-delayed", "delayed", 3), ("q-done", "delivered", 0), ("q-moving", "in_transit", 0),
    ("q-alert", "anomaly", 0), ("q-watched", "in_transit", 1), ("q-late", "delayed", 0),
    ("q-closed", "delivered", 4), ("q-far", "in_transit", 0),
]
SUMMARY_SCHEMA = ("shipment_id string, origin_hub string, destination_hub string, carrier_id string, "
                  "status string, updated_at timestamp_ntz, lat double, lon double, temperature double, "
                  "speed_kmh double, last_telemetry_at timestamp_ntz, open_anomalies long")


@pytest.fixture()
def demo(spark):
    rows = [(s, "H1", "H2", "C", st, NOW, -12.25, 130.75, 20.0, 50.0, NOW, n) for s, st, n in DEMO]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def test_fleet_metrics(demo):
    r = dashboard.fleet_metrics(demo).first()
    assert (r.total, r.in_transit, r.delayed, r.anomalies, r.delivered) == (8, 3, 2, 4, 2)
    assert r.in_transit_pct == 38.0  # 37.5 rounds up


def test_fleet_metrics_empty(demo):
    r = dashboard.fleet_metrics(demo.limit(0)).first()
    assert r.total == 0 and r.in_transit_pct == 0.0


def test_feed_order(demo):
    def feed(mode):
        return [r.shipment_id for r in dashboard.anomaly_feed(demo, mode).collect()]
    assert feed("all") == ["q-alert", "q-delayed", "q-late", "q-far", "q-moving", "q-watched"]
    assert feed("anomaly") == ["q-alert", "q-delayed", "q-watched", "q-closed"]
    assert feed("delayed") == ["q-delayed", "q-late"]
    severity = {r.shipment_id: r.severity for r in dashboard.anomaly_feed(demo, "all").collect()}
    assert severity["q-alert"] == "Critical" and severity["q-late"] == "Warning"


def test_feed_counts(demo):
    r = dashboard.feed_counts(demo).first()
    assert (r.anomaly_count, r.delayed_count) == (4, 2)


def test_feed_rejects_unknown_mode(demo):
    with pytest.raises(ValueError):
        dashboard.anomaly_feed(demo, "everything")


def test_map_points(demo, spark):
    pts = dashboard.map_points(demo).collect()
    assert len(pts) == 8
    alerts = {p.shipment_id for p in pts if p.is_alert}
    assert alerts == {"q-delayed", "q-watched", "q-closed"}


@pytest.mark.parametrize("raw,clamped", [(100, 100), ("250", 250), (900, 500), (0, 0)])
def test_limit_clamp(raw, clamped):
    assert dashboard.clamp_limit(raw) == clamped


@pytest.mark.parametrize("raw", ["abc", -1, None])
def test_limit_refused(raw):
    with pytest.raises(ValueError):
        dashboard.clamp_limit(raw)


def test_latest_telemetry_tie_break(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "s", t, 1.0), (2, "s", t, 2.0), (3, "s", t - dt.timedelta(hours=1), 3.0)]
    tel = spark.createDataFrame(rows, "id long, shipment_id string, event_time timestamp_ntz, lat double")
    from pyspark.sql import functions as F
    for c in ("lon", "temperature", "speed_kmh"):
        tel = tel.withColumn(c, F.lit(None).cast("double"))
    r = dashboard.latest_telemetry(tel).first()
    assert r.lat == 2.0


def test_summary_without_telemetry_or_events(spark):
    ships = spark.createDataFrame([("S1", "a", "b", "c", "in_transit", NOW, NOW, None)],
                                  "shipment_id string, origin_hub string, destination_hub string, "
                                  "carrier_id string, status string, created_at timestamp_ntz, "
                                  "updated_at timestamp_ntz, metadata string")
    tel = spark.createDataFrame([], "id long, shipment_id string, event_time timestamp_ntz, lat double, "
                                    "lon double, temperature double, speed_kmh double")
    ev = spark.createDataFrame([], "shipment_id string, resolved boolean")
    r = dashboard.shipments_summary(ships, tel, ev).first()
    assert r.open_anomalies == 0 and r.lat is None


def test_summary_pushes_page_keys_into_scans(spark, scratch):
    from cargoscope.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    fx.telemetry().write.parquet(f"{scratch}/tel")
    fx.anomaly_events().write.parquet(f"{scratch}/ev")
    tel, ev = spark.read.parquet(f"{scratch}/tel"), spark.read.parquet(f"{scratch}/ev")
    out = dashboard.shipments_summary(fx.shipments(), tel, ev, limit=20)
    plan = plan_text(out)
    assert "PushedFilters: [In(shipment_id" in plan  # telemetry scan
    assert "PushedFilters: [IsNotNull(resolved), In(shipment_id" in plan  # anomaly scan
    assert out.count() == 20
