"""Table, message and result schemas (data model of the reference, fixed).

Times are ``TimestampType`` in the canonical schemas. Operators accept either
``timestamp`` or ``timestamp_ntz`` columns: the driver's parquet loads as
``timestamp_ntz`` and results keep the input type.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, L, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType()
TS = T.TimestampType()
STR_ARRAY = T.ArrayType(T.StringType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SHIPMENTS = _struct(
    ("shipment_id", S, False), ("origin_hub", S, False), ("destination_hub", S, False),
    ("carrier_id", S, False), ("status", S, False), ("created_at", TS, False),
    ("updated_at", TS, False), ("metadata", S, True),
)

TELEMETRY = _struct(
    ("id", L, False), ("device_id", S, False), ("shipment_id", S, False),
    ("event_time", TS, False), ("lat", D, False), ("lon", D, False),
    ("temperature", D, True), ("humidity", D, True), ("speed_kmh", D, True),
    ("battery_pct", D, True),
)

ANOMALY_EVENTS = _struct(
    ("event_id", S, False), ("device_id", S, False), ("shipment_id", S, False),
    ("route_id", S, True), ("anomaly_score", D, False), ("event_time", TS, False),
    ("resolved", B, False), ("resolved_at", TS, True), ("details", S, True),
)

ROUTES = _struct(
    ("route_id", S, False), ("origin_hub", S, False), ("destination_hub", S, False),
    ("carrier_id", S, False), ("estimated_transit_days", D, False),
    ("base_cost_usd", D, False), ("cost_per_kg_usd", D, False),
    ("waypoints", STR_ARRAY, True), ("carrier_ids_filter", STR_ARRAY, True),
    ("active", B, False),
)

CARRIERS = _struct(
    ("carrier_id", S, False), ("carrier_name", S, False), ("country_code", S, True),
    ("active", B, False),
)

# Warehouse training table (DAY partition on timestamp, clustered by device_id).
TELEMETRY_RAW = _struct(
    ("device_id", S, False), ("timestamp", TS, False), ("lat", D, False), ("lon", D, False),
    ("temperature", D, True), ("humidity", D, True), ("speed_kmh", D, True),
    ("battery_pct", D, True), ("anomaly_label", L, True), ("ingested_at", TS, True),
)

# Message envelope of the telemetry / anomaly topics.
MESSAGE = _struct(
    ("message_id", S, False), ("value", S, True),
    ("attributes", T.MapType(T.StringType(), T.StringType()), True),
)

# Scenario request (one row per what-if scenario).
SCENARIO = _struct(
    ("scenario_id", L, False), ("origin_hub", S, False), ("destination_hub", S, False),
    ("cargo_weight_kg", D, False), ("carrier_ids", STR_ARRAY, True),
    ("max_transit_days", I, True), ("avoid_anomaly_routes", B, True),
)

# Fixed values of the reference.
FEATURE_COLS = [
    "temperature", "humidity", "lat", "lon", "speed_kmh", "battery_pct",
    "hours_since_last_checkpoint",
]
LABEL_COL = "anomaly_label"
ANOMALY_THRESHOLD = 0.75
SHIPMENT_STATUSES = ["in_transit", "delayed", "delivered", "anomaly"]

TABLES = {
    "shipments": SHIPMENTS, "telemetry": TELEMETRY, "anomaly_events": ANOMALY_EVENTS,
    "routes": ROUTES, "carriers": CARRIERS,
}

PRIMARY_KEYS = {
    "shipments": ["shipment_id"], "telemetry": ["id", "event_time"],
    "anomaly_events": ["event_id"], "routes": ["route_id"], "carriers": ["carrier_id"],
}

# Column domains written as comments in the reference DDL (checked by X4).
DOMAINS = {("shipments", "status"): SHIPMENT_STATUSES}
