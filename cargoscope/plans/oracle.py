"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark plans: windows over whole histories where
the plans cut them first, JSON by DuckDB's own functions, and so on. The
fixture views are prepended as CTEs over the driver's pre-registered tables.
"""

from __future__ import annotations

from cargoscope.schemas import FEATURE_COLS
from cargoscope.sources.fixtures import AS_OF, view_sql_for_oracle

ORACLE: dict[str, str] = {}
TS = f"TIMESTAMP '{AS_OF}'"


def with_views(views: list[str], body: str) -> str:
    if not views:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({view_sql_for_oracle(v)})" for v in views)
    return f"WITH {ctes}\n{body.strip()}"


def oracle(name: str, views: list[str]):
    def deco(fn):
        ORACLE[name] = with_views(views, fn())
        return fn
    return deco


SUMMARY_VIEWS = ["shipments", "telemetry", "anomaly_events"]


def summary_sql(status: str | None = None, limit: int = 100, telemetry: str = "telemetry",
                events: str = "anomaly_events") -> str:
    """Newest position by window, open counts by grouping, then the page."""
    wanted = f"status = '{status}'" if status else "true"
    return f"""
SELECT sh.shipment_id, sh.origin_hub, sh.destination_hub, sh.carrier_id, sh.status, sh.updated_at,
       pos.lat, pos.lon, pos.temperature, pos.speed_kmh, pos.event_time AS last_telemetry_at,
       COALESCE(unresolved.n, 0) AS open_anomalies
FROM (SELECT * FROM shipments WHERE {wanted}) sh
LEFT JOIN (
    SELECT * FROM {telemetry}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY shipment_id ORDER BY event_time DESC, id DESC) = 1
) pos USING (shipment_id)
LEFT JOIN (
    SELECT shipment_id, COUNT(*) AS n FROM {events} WHERE NOT resolved GROUP BY shipment_id
) unresolved USING (shipment_id)
ORDER BY sh.updated_at DESC, sh.shipment_id
LIMIT {limit}"""


# ---------------------------------------------------------------- dashboard
@oracle("shipments_summary", SUMMARY_VIEWS)
def _():
    return summary_sql()


@oracle("shipments_summary_delayed", SUMMARY_VIEWS)
def _():
    return summary_sql(status="delayed", limit=500)


@oracle("latest_telemetry", ["telemetry"])
def _():
    return """
SELECT shipment_id, lat, lon, temperature, speed_kmh, event_time AS last_telemetry_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY shipment_id ORDER BY event_time DESC, id DESC) AS rn
      FROM telemetry) x
WHERE rn = 1"""


@oracle("open_anomaly_counts", ["anomaly_events"])
def _():
    return """
SELECT shipment_id, COUNT(*) AS open_anomalies FROM anomaly_events WHERE NOT resolved
GROUP BY shipment_id"""


def page(body: str) -> str:
    return f"WITH page AS ({summary_sql(limit=200)})\n{body}"


def _nested(body: str) -> str:
    # A second WITH level keeps the fixture CTEs and the page CTE separate.
    return f"SELECT * FROM ({page(body)}) q"


@oracle("fleet_metrics", SUMMARY_VIEWS)
def _():
    return _nested("""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE status = 'in_transit') AS in_transit,
       COUNT(*) FILTER (WHERE status = 'delayed') AS delayed,
       COUNT(*) FILTER (WHERE status = 'anomaly' OR open_anomalies > 0) AS anomalies,
       COUNT(*) FILTER (WHERE status = 'delivered') AS delivered,
       CASE WHEN COUNT(*) > 0 THEN
            ROUND(CAST(COUNT(*) FILTER (WHERE status = 'in_transit') AS DOUBLE)
                  / CAST(COUNT(*) AS DOUBLE) * 100, 0)
            ELSE CAST(0 AS DOUBLE) END AS in_transit_pct
FROM page""")


@oracle("feed_counts", SUMMARY_VIEWS)
def _():
    return _nested("""
SELECT COUNT(*) FILTER (WHERE status = 'anomaly' OR open_anomalies > 0) AS anomaly_count,
       COUNT(*) FILTER (WHERE status = 'delayed') AS delayed_count
FROM page""")


def feed_sql(cond: str) -> str:
    return _nested(f"""
SELECT *,
       CASE status WHEN 'anomaly' THEN 0 WHEN 'delayed' THEN 1 WHEN 'in_transit' THEN 2
                   WHEN 'delivered' THEN 3 ELSE 4 END AS priority,
       CASE status WHEN 'anomaly' THEN 'Critical' WHEN 'delayed' THEN 'Warning'
                   WHEN 'in_transit' THEN 'Normal' WHEN 'delivered' THEN 'OK' ELSE 'Normal' END AS severity,
       CAST(TRUNC((EPOCH_US({TS}) - EPOCH_US(last_telemetry_at)) / 1000000.0) AS BIGINT) AS age_seconds
FROM page WHERE {cond}
ORDER BY priority, updated_at DESC, shipment_id
LIMIT 50""")


@oracle("anomaly_feed_all", SUMMARY_VIEWS)
def _():
    return feed_sql("status IS DISTINCT FROM 'delivered'")


@oracle("anomaly_feed_anomaly", SUMMARY_VIEWS)
def _():
    return feed_sql("(status = 'anomaly' OR open_anomalies > 0)")


@oracle("anomaly_feed_delayed", SUMMARY_VIEWS)
def _():
    return feed_sql("status = 'delayed'")


@oracle("anomaly_feed_display", SUMMARY_VIEWS)
def _():
    return f"""
SELECT shipment_id, ROUND(temperature, 1) AS temperature_shown, ROUND(speed_kmh, 0) AS speed_shown
FROM ({feed_sql("status IS DISTINCT FROM 'delivered'")}) f"""


@oracle("map_points", SUMMARY_VIEWS)
def _():
    return _nested("""
SELECT shipment_id, status, lat, lon,
       CASE status WHEN 'in_transit' THEN '#00d4ff' WHEN 'delayed' THEN '#ffaa00'
                   WHEN 'delivered' THEN '#34d399' WHEN 'anomaly' THEN '#ef4444'
                   ELSE '#94a3b8' END AS color,
       open_anomalies > 0 AS is_alert
FROM page WHERE lat IS NOT NULL AND lon IS NOT NULL""")


@oracle("recent_telemetry", ["telemetry"])
def _():
    return """
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY event_time DESC, id DESC) AS recency_rank
  FROM telemetry) x
WHERE recency_rank <= 5"""


@oracle("top_open_anomalies", ["anomaly_events"])
def _():
    return """
SELECT * FROM anomaly_events WHERE NOT resolved
ORDER BY anomaly_score DESC, event_id LIMIT 20"""


# ---------------------------------------------------------------- what-if routing
WHATIF_VIEWS = ["carriers", "anomaly_events", "routes_flat", "scenarios_flat"]


def whatif_sql(grain: str = "event") -> str:
    """Risk per route over its whole history; options per scenario; ten rows
    per scenario by cost; then the risk drop and the recommendation."""
    newest = "WHERE back = 1" if grain == "route" else ""
    return f"""
SELECT * FROM (
WITH history AS (
  SELECT route_id, event_id, event_time,
         AVG(anomaly_score) OVER (PARTITION BY route_id ORDER BY event_time, event_id
                                  ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS risk,
         ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY event_time DESC, event_id DESC) AS back
  FROM anomaly_events
), option AS (
  SELECT sc.scenario_id, sc.avoid_anomaly_routes, ro.*, ca.carrier_name,
         ro.base_cost_usd + sc.cargo_weight_kg * ro.cost_per_kg_usd AS total
  FROM routes_flat ro
  JOIN carriers ca ON ca.carrier_id = ro.carrier_id
  JOIN scenarios_flat sc ON sc.origin_hub = ro.origin_hub AND sc.destination_hub = ro.destination_hub
  WHERE sc.max_transit_days BETWEEN 1 AND 30 AND sc.max_transit_days >= ro.estimated_transit_days
    AND sc.cargo_weight_kg BETWEEN 0.1 AND 50000
    AND (sc.any_carrier OR COALESCE(ro.n_filter, 0) = 0 OR ro.carrier_id = 'C3')
), cheap AS (  -- a scenario's ten rows come from its ten cheapest routes
  SELECT * FROM option
  QUALIFY ROW_NUMBER() OVER (PARTITION BY scenario_id ORDER BY total, route_id) <= 10
), priced AS (
  SELECT option.*, h.event_id, h.event_time, COALESCE(h.risk, 0.0) AS risk,
         ROW_NUMBER() OVER (PARTITION BY scenario_id
             ORDER BY total, option.route_id, h.event_time DESC, h.event_id DESC) AS place
  FROM cheap AS option LEFT JOIN (SELECT * FROM history {newest}) h ON h.route_id = option.route_id
), shown AS (
  SELECT *, MIN(total) OVER (PARTITION BY scenario_id) AS least
  FROM priced WHERE place <= 10 AND (risk <= 0.75 OR NOT avoid_anomaly_routes)
)
SELECT scenario_id, route_id, carrier_id, carrier_name, estimated_transit_days,
       total AS estimated_cost_usd, risk AS anomaly_risk_score,
       COALESCE(waypoints_csv, '') AS waypoints_text, event_id, event_time, origin_hub, destination_hub,
       risk < 0.5 AND total = least AS is_recommended
FROM shown) q"""


@oracle("whatif_routes", WHATIF_VIEWS)
def _():
    return whatif_sql("event")


@oracle("whatif_routes_pruned", ["carriers", "routes_flat", "scenarios_flat"])
def _():
    return """
SELECT sc.scenario_id, ro.route_id,
       ro.base_cost_usd + sc.cargo_weight_kg * ro.cost_per_kg_usd AS estimated_cost_usd
FROM routes_flat ro SEMI JOIN carriers ca ON ca.carrier_id = ro.carrier_id
JOIN scenarios_flat sc ON sc.origin_hub = ro.origin_hub AND sc.destination_hub = ro.destination_hub
WHERE sc.max_transit_days BETWEEN 1 AND 30 AND sc.max_transit_days >= ro.estimated_transit_days
  AND sc.cargo_weight_kg BETWEEN 0.1 AND 50000
  AND (sc.any_carrier OR COALESCE(ro.n_filter, 0) = 0 OR ro.carrier_id = 'C3')
QUALIFY ROW_NUMBER() OVER (PARTITION BY sc.scenario_id ORDER BY estimated_cost_usd, ro.route_id) <= 10"""


@oracle("whatif_routes_by_route", WHATIF_VIEWS)
def _():
    return whatif_sql("route")


@oracle("whatif_route_display", WHATIF_VIEWS)
def _():
    return f"""
SELECT scenario_id, route_id, event_id,
       CASE WHEN anomaly_risk_score > 0.75 THEN 'high' WHEN anomaly_risk_score > 0.5 THEN 'medium'
            ELSE 'low' END AS risk_band,
       ROUND(anomaly_risk_score * 100, 0) AS risk_pct, ROUND(estimated_cost_usd, 0) AS cost_shown,
       CASE WHEN REPLACE(waypoints_text, ',', ' → ') <> '' THEN REPLACE(waypoints_text, ',', ' → ')
            ELSE UPPER(origin_hub) || ' → ' || UPPER(destination_hub) END AS route_label
FROM ({whatif_sql('event')}) w"""


@oracle("route_risk_latest", ["anomaly_events"])
def _():
    return """
SELECT route_id, event_id, event_time, anomaly_risk_score FROM (
  SELECT route_id, event_id, event_time,
         AVG(anomaly_score) OVER (PARTITION BY route_id ORDER BY event_time, event_id
                                  ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS anomaly_risk_score,
         ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY event_time DESC, event_id DESC) AS newest
  FROM anomaly_events WHERE route_id IS NOT NULL) x
WHERE newest = 1"""


@oracle("scenario_validation", ["scenarios_flat"])
def _():
    return """
SELECT CAST(scenario_id AS BIGINT) AS scenario_id,
       CASE WHEN origin_hub IS NULL THEN 'origin_hub'
            WHEN destination_hub IS NULL THEN 'destination_hub'
            WHEN cargo_weight_kg IS NULL OR isnan(cargo_weight_kg) OR cargo_weight_kg < 0.1
                 OR cargo_weight_kg > 50000 THEN 'cargo_weight_kg'
            WHEN max_transit_days < 1 OR max_transit_days > 30 THEN 'max_transit_days'
       END AS reject_reason
FROM scenarios_flat"""


# ---------------------------------------------------------------- ingest validation
def reason_sql(check_stale: bool = True) -> str:
    stale = f"WHEN event_time < {TS} - INTERVAL 24 HOURS THEN 'stale'" if check_stale else ""
    return f"""CASE
  WHEN device_id IS NULL OR device_id = '' THEN 'device_id'
  WHEN shipment_id IS NULL OR shipment_id = '' THEN 'shipment_id'
  WHEN event_time IS NULL THEN 'timestamp'
  {stale}
  WHEN COALESCE(lat, 0.0) < -90 OR COALESCE(lat, 0.0) > 90 THEN 'lat'
  WHEN COALESCE(lon, 0.0) < -180 OR COALESCE(lon, 0.0) > 180 THEN 'lon'
  WHEN temperature < -100 OR temperature > 200 THEN 'temperature'
  WHEN humidity < 0 OR humidity > 100 THEN 'humidity'
  WHEN battery_pct < 0 OR battery_pct > 100 THEN 'battery_pct'
END"""


@oracle("telemetry_validation", ["telemetry"])
def _():
    return f"""
SELECT id, reject_reason,
       CASE WHEN reject_reason IS NULL THEN 202 WHEN reject_reason = 'content_type' THEN 415 ELSE 400 END
           AS status_code,
       CASE reject_reason
         WHEN 'stale' THEN 'payload validation failed: stale timestamp — possible replay attack (device_id=' || device_id || ')'
         WHEN 'lat' THEN printf('payload validation failed: invalid latitude: %f (must be -90..90)', lat)
         WHEN 'lon' THEN printf('payload validation failed: invalid longitude: %f (must be -180..180)', lon)
         WHEN 'temperature' THEN printf('payload validation failed: temperature out of physical range: %f', temperature)
         WHEN 'humidity' THEN printf('payload validation failed: humidity out of range: %f', humidity)
         WHEN 'battery_pct' THEN printf('payload validation failed: battery_pct out of range: %f', battery_pct)
       END AS error
FROM (SELECT *, {reason_sql(True)} AS reject_reason FROM telemetry) t"""


@oracle("rejection_counts", ["telemetry"])
def _():
    return f"SELECT {reason_sql(True)} AS reject_reason, COUNT(*) AS n FROM telemetry GROUP BY 1"


@oracle("rejection_counts_no_stale", ["telemetry"])
def _():
    return f"SELECT {reason_sql(False)} AS reject_reason, COUNT(*) AS n FROM telemetry GROUP BY 1"


# ---------------------------------------------------------------- tables
@oracle("shipments_upsert", ["shipments", "shipment_updates"])
def _():
    return f"""
SELECT * FROM (
WITH p AS (
  SELECT shipment_id,
         arg_min(origin_hub, seq) AS origin_hub, arg_min(destination_hub, seq) AS destination_hub,
         arg_min(carrier_id, seq) AS carrier_id,
         arg_max(COALESCE(status, 'in_transit'), seq) AS status,
         arg_max(COALESCE(metadata, '{{}}'), seq) AS metadata
  FROM shipment_updates GROUP BY shipment_id)
SELECT COALESCE(c.shipment_id, p.shipment_id) AS shipment_id,
       CASE WHEN c.shipment_id IS NOT NULL THEN c.origin_hub ELSE p.origin_hub END AS origin_hub,
       CASE WHEN c.shipment_id IS NOT NULL THEN c.destination_hub ELSE p.destination_hub END AS destination_hub,
       CASE WHEN c.shipment_id IS NOT NULL THEN c.carrier_id ELSE p.carrier_id END AS carrier_id,
       CASE WHEN p.shipment_id IS NOT NULL THEN p.status ELSE c.status END AS status,
       CASE WHEN c.shipment_id IS NOT NULL THEN c.created_at ELSE {TS} END AS created_at,
       CASE WHEN p.shipment_id IS NOT NULL THEN {TS} ELSE c.updated_at END AS updated_at,
       CASE WHEN p.shipment_id IS NOT NULL THEN p.metadata ELSE c.metadata END AS metadata
FROM shipments c FULL OUTER JOIN p ON c.shipment_id = p.shipment_id) q"""


@oracle("orphan_telemetry", ["shipments", "telemetry"])
def _():
    return """
SELECT * FROM telemetry t
WHERE NOT EXISTS (SELECT 1 FROM shipments s WHERE s.shipment_id = t.shipment_id)"""


def _not_null_checks(table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{table}' AS table_name, 'not_null' AS check_name, '{c}' AS column_name, "
             f"COUNT(*) FILTER (WHERE {c} IS NULL) AS violations FROM {table}" for c in cols]
    return "\nUNION ALL\n".join(parts)


def _pk_check(table: str, key: list[str]) -> str:
    k = ", ".join(key)
    return (f"SELECT '{table}' AS table_name, 'primary_key' AS check_name, '{','.join(key)}' AS column_name, "
            f"COUNT(*) AS violations FROM (SELECT {k} FROM {table} GROUP BY {k} HAVING COUNT(*) > 1) d")


@oracle("table_checks", ["dirty_shipments", "telemetry", "dirty_events", "routes_flat", "carriers"])
def _():
    parts = [
        _not_null_checks("dirty_shipments", ["shipment_id", "origin_hub", "destination_hub",
                                             "carrier_id", "status", "created_at"])
        .replace("'dirty_shipments' AS", "'shipments' AS"),
        "SELECT 'shipments', 'not_null', 'updated_at', COUNT(*) FROM dirty_shipments",
        "SELECT 'shipments', 'domain', 'status', COUNT(*) FILTER (WHERE status IS NOT NULL AND status NOT IN "
        "('in_transit', 'delayed', 'delivered', 'anomaly')) FROM dirty_shipments",
        _pk_check("dirty_shipments", ["shipment_id"]).replace("'dirty_shipments' AS", "'shipments' AS"),
        _not_null_checks("telemetry", ["id", "device_id", "shipment_id", "event_time", "lat", "lon"]),
        _pk_check("telemetry", ["id", "event_time"]),
        _not_null_checks("dirty_events", ["event_id", "device_id", "shipment_id", "anomaly_score",
                                          "event_time", "resolved"])
        .replace("'dirty_events' AS", "'anomaly_events' AS"),
        _pk_check("dirty_events", ["event_id"]).replace("'dirty_events' AS", "'anomaly_events' AS"),
        _not_null_checks("routes_flat", ["route_id", "origin_hub", "destination_hub", "carrier_id",
                                         "estimated_transit_days", "base_cost_usd", "cost_per_kg_usd",
                                         "active"]).replace("'routes_flat' AS", "'routes' AS"),
        _pk_check("routes_flat", ["route_id"]).replace("'routes_flat' AS", "'routes' AS"),
        _not_null_checks("carriers", ["carrier_id", "carrier_name", "active"]),
        _pk_check("carriers", ["carrier_id"]),
    ]
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(parts) + "\n) q"


@oracle("telemetry_retention", ["telemetry"])
def _():
    return f"SELECT * FROM telemetry WHERE event_time >= {TS} - INTERVAL 7 DAYS"


@oracle("retention_drop", ["telemetry"])
def _():
    return f"SELECT * FROM telemetry WHERE event_time >= {TS} - INTERVAL 7 DAYS"


@oracle("anomaly_retention", ["anomaly_events"])
def _():
    return f"SELECT * FROM anomaly_events WHERE event_time >= {TS} - INTERVAL 1 DAYS"


@oracle("partition_range_violations", ["telemetry"])
def _():
    later = "TIMESTAMP '2024-02-10 00:00:00'"
    return f"""
SELECT id, event_time, strftime(event_time, '%Y_%m') AS event_month FROM telemetry
WHERE event_time < DATE_TRUNC('month', {later})
   OR event_time >= DATE_TRUNC('month', {later}) + INTERVAL 4 MONTHS"""


# ---------------------------------------------------------------- scoring
def _or(col: str, default: float) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} = 0 THEN {default} ELSE {col} END"


FEATURE_SQL = [("temperature", _or("temperature", "CAST(0.0 AS DOUBLE)")),
               ("humidity", _or("humidity", "CAST(0.0 AS DOUBLE)")),
               ("lat", "lat"), ("lon", "lon"),
               ("speed_kmh", _or("speed_kmh", "CAST(0.0 AS DOUBLE)")),
               ("battery_pct", _or("battery_pct", "CAST(100.0 AS DOUBLE)")),
               ("hours_since_last_checkpoint", "CAST(0.0 AS DOUBLE)")]


@oracle("feature_vectors", ["telemetry"])
def _():
    cols = ", ".join(f"{expr} AS f_{name}" for name, expr in FEATURE_SQL)
    return f"SELECT id, {cols} FROM telemetry"


def scored_sql() -> str:
    f = dict(FEATURE_SQL)
    raw = (f"((((CAST(0.5 AS DOUBLE) + CAST(0.0078125 AS DOUBLE) * ({f['temperature']})) "
           f"+ CAST(0.00390625 AS DOUBLE) * ({f['humidity']})) "
           f"+ CAST(0.001953125 AS DOUBLE) * ({f['speed_kmh']})) "
           f"+ CAST(-0.00390625 AS DOUBLE) * ({f['battery_pct']}))")
    return f"""
SELECT id, device_id, shipment_id, anomaly_score, anomaly_score >= 0.75 AS is_anomaly,
       CAST(0.75 AS DOUBLE) AS threshold
FROM (SELECT *, GREATEST(CAST(0.0 AS DOUBLE), LEAST(CAST(1.0 AS DOUBLE), COALESCE({raw}, 0.0))) AS anomaly_score
      FROM telemetry) t"""


@oracle("anomaly_scores", ["telemetry"])
def _():
    return scored_sql()


@oracle("anomaly_emissions", ["telemetry"])
def _():
    return f"""
SELECT 'm' || CAST(id AS VARCHAR) AS message_id, device_id, CAST(anomaly_score AS VARCHAR) AS score_text
FROM ({scored_sql()}) s WHERE is_anomaly"""


@oracle("checkpoint_gaps", ["telemetry"])
def _():
    return """
SELECT id, shipment_id,
       CAST(EPOCH_US(event_time) - EPOCH_US(LAG(event_time) OVER (PARTITION BY shipment_id ORDER BY event_time, id))
            AS DOUBLE) / 3.6e9 AS hours_since_last_checkpoint
FROM telemetry"""


@oracle("rate_violations", [])
def _():
    return """
SELECT * FROM (
SELECT DATE_TRUNC('day', ts) AS window_start, DATE_TRUNC('day', ts) + INTERVAL 1 DAY AS window_end,
       user_id, COUNT(*) AS n
FROM events GROUP BY 1, 2, 3 HAVING COUNT(*) > 3) q"""


# ---------------------------------------------------------------- training & evaluation
def training_set_sql() -> str:
    return f"""
SELECT event_id, device_id, event_time, score, temperature, humidity, lat, lon, speed_kmh, battery_pct,
       CAST(0.0 AS DOUBLE) AS hours_since_last_checkpoint, anomaly_label
FROM training WHERE anomaly_label IS NOT NULL AND event_time >= {TS} - INTERVAL 90 DAYS"""


def imputed_sql() -> str:
    cols = ["temperature", "humidity", "lat", "lon", "speed_kmh", "battery_pct",
            "hours_since_last_checkpoint"]
    filled = ", ".join(f"COALESCE({c}, AVG({c}) OVER ()) AS {c}" for c in cols)
    return f"SELECT event_id, device_id, event_time, score, {filled}, anomaly_label FROM ({training_set_sql()}) t"


def split_sql() -> str:
    return f"""
SELECT *, CASE WHEN row_pos < FLOOR(CAST(n AS DOUBLE) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY event_time, device_id, event_id) - 1 AS row_pos,
             COUNT(*) OVER () AS n
      FROM ({imputed_sql()}) i) r"""


def test_sql() -> str:
    return f"SELECT * FROM ({split_sql()}) s WHERE split = 'test'"


@oracle("training_set", ["training"])
def _():
    return training_set_sql()


@oracle("imputed_training", ["training"])
def _():
    return imputed_sql()


@oracle("temporal_split", ["training"])
def _():
    return f"SELECT event_id, row_pos, split FROM ({split_sql()}) s"


@oracle("temporal_split_narrow", ["training"])
def _():
    return f"SELECT event_id, split FROM ({split_sql()}) s"


@oracle("gbt_train_evaluate", ["training"])
def _():
    return f"""
SELECT COUNT(*) AS n_test, true AS in_range, true AS same_after_load, true AS metrics_in_range,
       true AS rounds_within_limit, true AS best_round_kept
FROM ({test_sql()}) t"""


@oracle("gbt_learns_rule", ["training"])
def _():
    x, y = FEATURE_COLS[:2]
    return f"""
SELECT COUNT(*) AS n_test, CAST(SUM(CAST({x} > mx + 0.001 AND {y} > my + 0.001 AS INT)) AS BIGINT) AS n_positive,
       true AS beats_constant, true AS beats_base_rate, true AS ranks_well
FROM ({test_sql()}) t, (SELECT AVG({x}) AS mx, AVG({y}) AS my FROM ({split_sql()}) s) m"""


@oracle("split_stats", ["training"])
def _():
    return f"""
SELECT split, COUNT(*) AS n_rows, AVG(CAST(anomaly_label AS DOUBLE)) AS anomaly_rate
FROM ({split_sql()}) s GROUP BY split"""


@oracle("classification_report", ["training"])
def _():
    return f"""
SELECT * FROM (
WITH c AS (
  SELECT COUNT(*) FILTER (WHERE anomaly_label = 1 AND score >= 0.75) AS tp,
         COUNT(*) FILTER (WHERE anomaly_label = 0 AND score >= 0.75) AS fp,
         COUNT(*) FILTER (WHERE anomaly_label = 1 AND score < 0.75) AS fn,
         COUNT(*) FILTER (WHERE anomaly_label = 0 AND score < 0.75) AS tn
  FROM ({test_sql()}) t),
m AS (
  SELECT tp + fp + fn + tn AS n, tn + fp AS s0, tp + fn AS s1,
         CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fn AS DOUBLE) ELSE 0.0 END AS p0,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) ELSE 0.0 END AS r0,
         CASE WHEN 2 * tn + fn + fp > 0 THEN CAST(2 * tn AS DOUBLE) / CAST(2 * tn + fn + fp AS DOUBLE) ELSE 0.0 END AS f0,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p1,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS r1,
         CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1,
         CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END AS acc
  FROM c)
SELECT 'Normal' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM m
UNION ALL SELECT 'Anomaly', p1, r1, f1, s1 FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
UNION ALL SELECT 'weighted avg',
    (CAST(s0 AS DOUBLE) * p0 + CAST(s1 AS DOUBLE) * p1) / CAST(n AS DOUBLE),
    (CAST(s0 AS DOUBLE) * r0 + CAST(s1 AS DOUBLE) * r1) / CAST(n AS DOUBLE),
    (CAST(s0 AS DOUBLE) * f0 + CAST(s1 AS DOUBLE) * f1) / CAST(n AS DOUBLE), n FROM m) q"""


def auc_sql() -> str:
    return f"""
SELECT CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
         CAST(SUM(2 * pos * neg_below + pos * neg) AS DOUBLE)
         / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE) * 2) END AS roc_auc
FROM (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS neg_below
      FROM (SELECT score, COUNT(*) FILTER (WHERE anomaly_label = 1) AS pos,
                   COUNT(*) FILTER (WHERE anomaly_label = 0) AS neg
            FROM ({test_sql()}) t GROUP BY score) h) c"""


def ap_sql() -> str:
    return f"""
SELECT CASE WHEN SUM(pos) > 0 THEN
         ROUND(SUM(CAST(pos AS DOUBLE) * CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE))
               / CAST(SUM(pos) AS DOUBLE), 12) END AS average_precision
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS cum_pos, SUM(neg) OVER (ORDER BY score DESC) AS cum_neg
      FROM (SELECT score, COUNT(*) FILTER (WHERE anomaly_label = 1) AS pos,
                   COUNT(*) FILTER (WHERE anomaly_label = 0) AS neg
            FROM ({test_sql()}) t GROUP BY score) h) c"""


@oracle("roc_auc", ["training"])
def _():
    return auc_sql()


@oracle("average_precision", ["training"])
def _():
    return ap_sql()


@oracle("evaluation", ["training"])
def _():
    return f"""
SELECT a.roc_auc, p.average_precision,
       (SELECT CAST(COUNT(*) FILTER (WHERE (score >= 0.75) = (anomaly_label = 1)) AS DOUBLE)
               / CAST(COUNT(*) AS DOUBLE) FROM ({test_sql()}) t) AS accuracy
FROM ({auc_sql()}) a, ({ap_sql()}) p"""


@oracle("route_risk_all", ["anomaly_events"])
def _():
    return """
SELECT route_id, event_id, event_time,
       AVG(anomaly_score) OVER (PARTITION BY route_id ORDER BY event_time, event_id
                                ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS anomaly_risk_score
FROM anomaly_events WHERE route_id IS NOT NULL"""


# ---------------------------------------------------------------- strict decode (DuckDB JSON)
MESSAGE_VIEWS = ["telemetry", "messages_flat"]
RFC3339_SQL = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?"
               r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$")
NUMBER_TYPES = "('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT')"
SENSORS = ["temperature", "humidity", "speed_kmh", "battery_pct"]


def text_of(value: str) -> str:
    return f"json_extract_string({value}, '$')"


def instant_sql(t: str) -> str:
    """UTC timestamp of RFC 3339 text: fraction cut to microseconds."""
    micros = f"CAST(rpad(substr(regexp_extract({t}, '[.](\\d+)', 1), 1, 6), 6, '0') AS BIGINT)"
    minutes = f"(CAST(substr({t}, -5, 2) AS BIGINT) * 60 + CAST(substr({t}, -2) AS BIGINT))"
    return f"""CASE WHEN regexp_matches({t}, '{RFC3339_SQL}') THEN
      TRY_CAST(replace(substr({t}, 1, 19), 'T', ' ') AS TIMESTAMP)
      + to_microseconds(CASE WHEN {t} LIKE '%.%' THEN {micros} ELSE 0 END)
      - to_minutes(CASE WHEN {t} LIKE '%Z' THEN 0 WHEN substr({t}, -6, 1) = '-' THEN -{minutes} ELSE {minutes} END)
    END"""


def parsed_ctes(cut: bool) -> str:
    """g: the body, cut to 1 MiB for the gateway, where it is one JSON value
    (DuckDB takes NaN and Infinity, which JSON does not have); kv: its entries."""
    body = "left(value, 1048576)" if cut else "value"
    return f"""
g AS (
  SELECT message_id, content_type,
         CASE WHEN json_valid({body}) AND NOT regexp_matches({body}, '[:,\\[]\\s*-?(NaN|Infinity)')
              THEN {body} END AS jv
  FROM messages_flat),
o AS (SELECT *, CASE WHEN json_type(jv) IN ('OBJECT', 'NULL') THEN jv END AS obj FROM g),
kv AS (
  SELECT o.message_id, e.key AS k, e.value AS v, e.type AS t, e.id AS n
  FROM o, json_each(o.obj) e WHERE json_type(o.obj) = 'OBJECT')"""


def decoded_sql(check_stale: bool) -> str:
    """The gateway's decode + rules written with DuckDB's JSON functions."""
    plain, optional = ["device_id", "shipment_id", "timestamp", "lat", "lon"], SENSORS
    ok = f"""CASE WHEN t = 'NULL' THEN true
      WHEN f IN ('device_id', 'shipment_id') THEN t = 'VARCHAR'
      WHEN f = 'timestamp' THEN t = 'VARCHAR' AND ({instant_sql(text_of('v'))}) IS NOT NULL
      ELSE t IN {NUMBER_TYPES} AND coalesce(isfinite(TRY_CAST(v::VARCHAR AS DOUBLE)), false) END"""
    last = ",\n         ".join(
        [f"arg_max(v, n) FILTER (f = '{f}' AND t <> 'NULL') AS {f}" for f in plain]
        + [f"arg_max(CASE WHEN t <> 'NULL' THEN v::VARCHAR ELSE '' END, n) FILTER (f = '{f}') AS {f}"
           for f in optional])
    stale = f"WHEN ts < {TS} - INTERVAL 24 HOURS THEN 'stale'" if check_stale else ""

    def known(expr, name):
        return f"CASE WHEN decode_reason IS NULL THEN {expr} END AS {name}"

    def num(f):
        return f"TRY_CAST({f}::VARCHAR AS DOUBLE)"

    return f"""
SELECT * FROM (
WITH {parsed_ctes(True).strip()},
fields AS (SELECT message_id, lower(k) AS f, v, t, n FROM kv
           WHERE lower(k) IN ({", ".join(f"'{f}'" for f in plain + optional)})),
d AS (
  SELECT message_id, bool_and({ok}) AS typed,
         {last}
  FROM fields GROUP BY message_id),
r AS (
  SELECT o.message_id, d.* EXCLUDE (message_id),
         CASE WHEN content_type IS DISTINCT FROM 'application/json' THEN 'content_type'
              WHEN obj IS NULL OR NOT coalesce(typed, true) THEN 'malformed' END AS decode_reason
  FROM o LEFT JOIN d ON d.message_id = o.message_id),
f AS (
  SELECT message_id, decode_reason, {known(text_of('device_id'), 'device_id')},
         {known(text_of('shipment_id'), 'shipment_id')},
         {known(instant_sql(text_of('"timestamp"')), 'ts')},
         {known(f"coalesce({num('lat')}, 0.0)", 'lat')}, {known(f"coalesce({num('lon')}, 0.0)", 'lon')},
         {", ".join(known(num(f), f) for f in SENSORS)}
  FROM r)
SELECT message_id, device_id, shipment_id, lat, lon, {", ".join(SENSORS)}, ts,
       CASE
         WHEN decode_reason IS NOT NULL THEN decode_reason
         WHEN device_id IS NULL OR device_id = '' THEN 'device_id'
         WHEN shipment_id IS NULL OR shipment_id = '' THEN 'shipment_id'
         WHEN ts IS NULL OR ts = TIMESTAMP '0001-01-01 00:00:00' THEN 'timestamp'
         {stale}
         WHEN lat < -90 OR lat > 90 THEN 'lat'
         WHEN lon < -180 OR lon > 180 THEN 'lon'
         WHEN temperature < -100 OR temperature > 200 THEN 'temperature'
         WHEN humidity < 0 OR humidity > 100 THEN 'humidity'
         WHEN battery_pct < 0 OR battery_pct > 100 THEN 'battery_pct'
       END AS reject_reason
FROM f) r"""


@oracle("ingest_messages", MESSAGE_VIEWS)
def _():
    return f"""
SELECT message_id, reject_reason,
       CASE WHEN reject_reason IS NULL THEN 202 WHEN reject_reason = 'content_type' THEN 415 ELSE 400 END
           AS status_code,
       device_id, lat, lon,
       CASE WHEN reject_reason IS NULL THEN epoch_us(ts) END AS ts_micros
FROM ({decoded_sql(False)}) x"""


@oracle("bounded_pull", MESSAGE_VIEWS)
def _():
    return "SELECT message_id, value FROM messages_flat ORDER BY message_id LIMIT 200"


@oracle("quarantine_rows", MESSAGE_VIEWS)
def _():
    return f"""
SELECT message_id, reject_reason, CAST(1 AS INTEGER) AS attempts,
       CASE WHEN length(value) <= 200 THEN value ELSE left(value, 200) || '...' END AS body_snippet
FROM ({decoded_sql(True)}) x JOIN messages_flat USING (message_id) WHERE reject_reason IS NOT NULL"""


@oracle("stream_ingest", MESSAGE_VIEWS)
def _():
    kept = "reject_reason IS NULL"
    return f"""
SELECT message_id, reject_reason,
       CASE WHEN {kept} THEN device_id END AS device_id, CASE WHEN {kept} THEN lat END AS lat,
       CASE WHEN {kept} THEN temperature END AS temperature,
       CASE WHEN {kept} THEN epoch_us(ts) END AS ts_micros,
       CASE WHEN {kept} THEN shipment_id END AS shipment_attribute,
       CASE WHEN {kept} THEN 'application/json' END AS content_type
FROM ({decoded_sql(True)}) x"""


def raw_score_sql() -> str:
    def orz(c, d):
        return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN CAST({d} AS DOUBLE) ELSE {c} END"
    raw = (f"((((CAST(0.5 AS DOUBLE) + CAST(0.0078125 AS DOUBLE) * ({orz('temperature', '0.0')})) "
           f"+ CAST(0.00390625 AS DOUBLE) * ({orz('humidity', '0.0')})) "
           f"+ CAST(0.001953125 AS DOUBLE) * ({orz('speed_kmh', '0.0')})) "
           f"+ CAST(-0.00390625 AS DOUBLE) * ({orz('battery_pct', '100.0')}))")
    return f"GREATEST(CAST(0.0 AS DOUBLE), LEAST(CAST(1.0 AS DOUBLE), COALESCE({raw}, 0.0)))"


@oracle("landed_summary", ["shipments", *MESSAGE_VIEWS])
def _():
    page = summary_sql(limit=500, telemetry="landed", events="raised")
    return f"""
SELECT * EXCLUDE (last_telemetry_at), epoch_us(last_telemetry_at) AS last_telemetry_micros FROM (
WITH landed AS (
  SELECT *, ts AS event_time, CAST('0x' || substr(md5(message_id), 1, 15) AS BIGINT) AS id
  FROM ({decoded_sql(True)}) x WHERE reject_reason IS NULL),
raised AS (SELECT shipment_id, false AS resolved FROM landed WHERE {raw_score_sql()} >= 0.75)
{page}) q"""


@oracle("stream_replay", MESSAGE_VIEWS)
def _():
    raised = f"reject_reason IS NULL AND {raw_score_sql()} >= 0.75"
    return f"""
SELECT message_id, (reject_reason IS NULL)::BIGINT AS n_landed,
       (reject_reason IS NOT NULL)::BIGINT AS n_quarantined, ({raised})::BIGINT AS n_events,
       CASE WHEN {raised} THEN epoch_us({TS}) END AS event_micros
FROM ({decoded_sql(True)}) x"""


@oracle("delivery_retries", MESSAGE_VIEWS)
def _():
    return f"""
SELECT message_id, CAST(CASE WHEN reject_reason = 'content_type' THEN 415
                             WHEN reject_reason IS NOT NULL THEN 400
                             WHEN message_id LIKE '%680' THEN 500 ELSE 202 END AS INTEGER) AS status_code
FROM ({decoded_sql(True)}) x"""


# ---------------------------------------------------------------- loose decode (scoring side)
FLOAT_TEXT_SQL = (r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?"
                  r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")


def features_sql() -> str:
    """The scoring service's decode: one JSON object, string ids, floats as
    numbers, numeric strings or booleans; of equal keys the last; lat/lon
    required (NaN tokens refused, as documented)."""
    ids = ["device_id", "shipment_id"]
    floats = ["lat", "lon", *SENSORS, "hours_since_last_checkpoint"]
    last = ",\n         ".join(f"arg_max(v, n) FILTER (k = '{f}') AS v_{f}, "
                               f"arg_max(t, n) FILTER (k = '{f}') AS t_{f}" for f in ids + floats)

    def as_float(f):
        text = text_of(f"v_{f}")
        return (f"CASE WHEN t_{f} IN {NUMBER_TYPES} THEN TRY_CAST(v_{f}::VARCHAR AS DOUBLE)"
                f" WHEN t_{f} = 'VARCHAR' AND regexp_matches({text}, '{FLOAT_TEXT_SQL}')"
                f" THEN TRY_CAST(trim({text}) AS DOUBLE)"
                f" WHEN t_{f} = 'BOOLEAN' THEN CASE WHEN v_{f}::VARCHAR = 'true' THEN 1.0 ELSE 0.0 END"
                f" END AS {f}")

    ok = " AND ".join([f"coalesce(t_{f} = 'VARCHAR', false)" for f in ids]
                      + [f"{f} IS NOT NULL" for f in ("lat", "lon")]
                      + [f"(t_{f} IS NULL OR t_{f} = 'NULL' OR {f} IS NOT NULL)" for f in floats[2:]])
    return f"""
SELECT * FROM (
WITH {parsed_ctes(False).strip()},
l AS (
  SELECT message_id,
         {last}
  FROM kv GROUP BY message_id),
x AS (
  SELECT *, {text_of('v_device_id')} AS device_id_raw, {text_of('v_shipment_id')} AS shipment_id_raw,
         {", ".join(as_float(f) for f in floats)}
  FROM l)
SELECT o.message_id, CASE WHEN x.message_id IS NOT NULL AND {ok} THEN NULL ELSE 'malformed' END
         AS decode_reason,
       device_id_raw, shipment_id_raw, lat, lon, temperature, humidity, speed_kmh, battery_pct
FROM o LEFT JOIN x ON x.message_id = o.message_id) d"""


@oracle("scoring_decode", MESSAGE_VIEWS)
def _():
    return f"""
SELECT message_id, decode_reason,
       CASE WHEN decode_reason IS NULL THEN device_id_raw END AS device_id,
       CASE WHEN decode_reason IS NULL THEN lat END AS lat,
       CASE WHEN decode_reason IS NULL THEN lon END AS lon,
       CASE WHEN decode_reason IS NULL THEN temperature END AS temperature,
       CASE WHEN decode_reason IS NULL THEN battery_pct END AS battery_pct
FROM ({features_sql()}) f"""


@oracle("stream_scoring", MESSAGE_VIEWS)
def _():
    return f"""
SELECT message_id, device_id_raw AS device_id, shipment_id_raw AS shipment_id, anomaly_score,
       anomaly_score >= 0.75 AS is_anomaly, CAST(0.75 AS DOUBLE) AS threshold
FROM (SELECT *, {raw_score_sql()} AS anomaly_score
      FROM ({features_sql()}) f WHERE decode_reason IS NULL) s"""


# The same results by other ways: kept from batches, or in buckets.
ORACLE["shipments_upsert_buckets"] = ORACLE["shipments_upsert"]
ORACLE["rate_violations_maintained"] = ORACLE["rate_violations"]
ORACLE["maintained_summary"] = with_views(SUMMARY_VIEWS, summary_sql(limit=200))
