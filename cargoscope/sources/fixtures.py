"""Operator input tables derived from the driver's parquet tables.

The SQL below (printed in FIXTURES.md) runs unchanged on
Spark and DuckDB: Spark binds the ``{table}`` placeholders to DataFrames,
the oracle side substitutes plain view names. It only shapes rows into the
schemas the operators expect; it does none of the operators' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

# "now" of every fixture-based query (events.ts covers January 2024).
AS_OF = "2024-01-31 00:00:00"

VIEW_SQL = {
    "carriers": """
SELECT 'C' || CAST(s_suppkey AS STRING) AS carrier_id, s_name AS carrier_name,
       n_name AS country_code, s_acctbal > 0 AS active
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "shipments": """
SELECT 'S' || CAST(o_orderkey AS STRING) AS shipment_id,
       'H' || CAST(o_orderkey % 5 AS STRING) AS origin_hub,
       'H' || CAST(o_custkey % 5 AS STRING) AS destination_hub,
       'C' || CAST(o_custkey % 10 AS STRING) AS carrier_id,
       CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'in_transit'
            WHEN o_orderpriority = '1-URGENT' THEN 'anomaly' ELSE 'delayed' END AS status,
       o_orderdate AS created_at, o_orderdate AS updated_at, CAST(NULL AS STRING) AS metadata
FROM {orders}""",
    "telemetry": """
SELECT event_id AS id, 'D' || CAST(user_id AS STRING) AS device_id,
       CASE WHEN event_id % 10 = 7 THEN 'T' ELSE 'S' END || CAST(user_id * 100 + event_id % 20 AS STRING)
         AS shipment_id, ts AS event_time,
       CAST(event_id % 727 AS DOUBLE) / 4 - 90 AS lat, CAST(event_id % 1455 AS DOUBLE) / 4 - 181 AS lon,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS temperature,
       CAST(event_id % 102 AS DOUBLE) AS humidity,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 120 AS DOUBLE) END AS speed_kmh,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 103 AS DOUBLE) END AS battery_pct
FROM {events}""",
    "anomaly_events": """
SELECT event_id, 'D' || CAST(user_id AS STRING) AS device_id,
       'S' || CAST(user_id * 100 + event_id % 20 AS STRING) AS shipment_id,
       'R' || CAST(event_id % 40 AS STRING) AS route_id,
       CAST((event_id * 7) % 65 AS DOUBLE) / 64 AS anomaly_score, ts AS event_time,
       event_id % 3 = 0 AS resolved
FROM {events} WHERE event_type = 'error'""",
    "routes_flat": """
SELECT 'R' || CAST(p_partkey AS STRING) AS route_id, 'H' || CAST(p_partkey % 5 AS STRING) AS origin_hub,
       'H' || CAST(CAST((p_partkey - p_partkey % 5) / 5 AS BIGINT) % 5 AS STRING) AS destination_hub,
       'C' || CAST(p_partkey % 10 AS STRING) AS carrier_id,
       CAST(p_size AS DOUBLE) / 2 AS estimated_transit_days, p_retailprice AS base_cost_usd,
       CAST(p_size % 8 AS DOUBLE) / 64 AS cost_per_kg_usd,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || ',' || p_type END AS waypoints_csv,
       CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 0 ELSE 1 END AS n_filter,
       p_size % 9 <> 0 AS active
FROM {part}""",
    # One scenario per order; a few of each kind leave the request model's bounds.
    "scenarios_flat": """
SELECT o_orderkey AS scenario_id,
       CASE WHEN o_orderkey % 97 = 1 THEN NULL ELSE 'H' || CAST(o_orderkey % 5 AS STRING) END AS origin_hub,
       CASE WHEN o_orderkey % 97 = 2 THEN NULL ELSE 'H' || CAST(o_custkey % 5 AS STRING) END AS destination_hub,
       CASE WHEN o_orderkey % 97 = 3 THEN CAST(0.0625 AS DOUBLE) WHEN o_orderkey % 97 = 4 THEN CAST(50000.5 AS DOUBLE)
            WHEN o_orderkey % 97 = 5 THEN NULL
            ELSE CAST(1 + o_custkey % 4000 AS DOUBLE) / 8 END AS cargo_weight_kg,
       o_orderkey % 3 = 0 AS any_carrier,
       CASE WHEN o_orderkey % 97 = 6 THEN 0 WHEN o_orderkey % 97 = 7 THEN 31
            ELSE 5 + o_custkey % 25 END AS max_transit_days,
       o_custkey % 2 = 0 AS avoid_anomaly_routes
FROM {orders}""",
    # Rows that break each declared constraint of a table, by key.
    "dirty_shipments": """
SELECT CASE WHEN o_orderkey % 31 = 1 THEN NULL ELSE 'S' || CAST(o_orderkey - o_orderkey % 2 AS STRING) END AS shipment_id,
       CASE WHEN o_orderkey % 31 = 2 THEN NULL ELSE 'H1' END AS origin_hub, 'H2' AS destination_hub, 'C1' AS carrier_id,
       CASE WHEN o_orderkey % 31 = 3 THEN NULL WHEN o_orderkey % 31 = 4 THEN 'lost' ELSE 'delayed' END AS status,
       o_orderdate AS created_at, CAST(NULL AS STRING) AS metadata
FROM {orders}""",
    "dirty_events": """
SELECT CAST(event_id - event_id % 3 AS STRING) AS event_id,
       CASE WHEN event_id % 17 = 1 THEN NULL ELSE 'D1' END AS device_id, 'S1' AS shipment_id,
       CAST(NULL AS STRING) AS route_id,
       CASE WHEN event_id % 17 = 2 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS anomaly_score,
       CASE WHEN event_id % 17 = 3 THEN NULL ELSE ts END AS event_time, event_id % 2 = 0 AS resolved
FROM {events}""",
    "training": """
SELECT 'D' || CAST(user_id AS STRING) AS device_id, ts AS event_time, event_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 161 AS DOUBLE) / 4 END AS temperature,
       CAST(event_id % 102 AS DOUBLE) AS humidity, CAST(event_id % 727 AS DOUBLE) / 4 - 90 AS lat,
       CAST(event_id % 1455 AS DOUBLE) / 4 - 181 AS lon,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 120 AS DOUBLE) END AS speed_kmh,
       CAST(event_id % 101 AS DOUBLE) AS battery_pct,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS anomaly_label,
       CAST((event_id * 7) % 65 AS DOUBLE) / 64 AS score
FROM {events}""",
    "shipment_updates": """
SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'N' ELSE 'S' END || CAST(o_orderkey AS STRING) AS shipment_id,
       'HX' AS origin_hub, 'HY' AS destination_hub,
       'C1' AS carrier_id, 'delayed' AS status, '{{"n":1}}' AS metadata, 1 AS seq
FROM {orders} WHERE o_orderkey % 10 IN (2, 3)
UNION ALL
SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'N' ELSE 'S' END || CAST(o_orderkey AS STRING),
       'HZ', 'HZ', 'C2', 'delivered', '{{"n":2}}', 2
FROM {orders} WHERE o_orderkey % 20 IN (2, 3)""",
    # Gateway message bodies built from telemetry rows by plain text
    # concatenation (identical bytes on both engines), with the decode defects
    # of the reference's tests injected by id % 50.
    "messages_flat": """
SELECT id, 'm' || CAST(id AS STRING) AS message_id,
       CASE WHEN id % 50 = 0 THEN 'text/plain' ELSE 'application/json' END AS content_type,
       device_id, shipment_id,
       CASE id % 50
         WHEN 1 THEN body || ' trailing'
         WHEN 8 THEN SUBSTRING(body, 1, 40)
         WHEN 9 THEN body || body
         WHEN 10 THEN ''
         WHEN 11 THEN 'null'
         WHEN 12 THEN '[' || body || ']'
         WHEN 13 THEN REPLACE(body, '"', CHR(39))
         WHEN 14 THEN '{{"device_id":"' || device_id || '",' || SUBSTRING(body, 2)
         WHEN 19 THEN body || '] xyz'
         WHEN 20 THEN body || '],{{"a":1}}'
         WHEN 25 THEN '{{"device_id":"first","lat":1,' || SUBSTRING(body, 2)
         WHEN 26 THEN CASE WHEN id % 5000 = 26 THEN body || REPEAT(' ', 1048576) || 'x' ELSE body END
         ELSE body END AS value
FROM (
  SELECT id, device_id, shipment_id,
         '{{' ||
         CASE WHEN id % 50 = 2 THEN '"device_id":' || SUBSTRING(device_id, 2)
              WHEN id % 50 = 24 THEN '"Device_ID":"' || device_id || '"'
              ELSE '"device_id":"' || device_id || '"' END ||
         ',"timestamp":"' ||
         CASE id % 50 WHEN 6 THEN ts_text
                      WHEN 7 THEN SUBSTRING(ts_text, 1, 10)
                      WHEN 15 THEN ts_text || '+05:30'
                      WHEN 16 THEN ts_text || '123Z'
                      WHEN 17 THEN '0001-01-01T00:00:00Z'
                      WHEN 22 THEN SUBSTRING(ts_text, 1, 19) || '.1234567891Z'
                      WHEN 23 THEN SUBSTRING(ts_text, 1, 19) || '+19:00'
                      WHEN 31 THEN SUBSTRING(ts_text, 1, 19) || '.5-00:30'
                      WHEN 32 THEN SUBSTRING(ts_text, 1, 19) || '+24:00'
                      ELSE ts_text || 'Z' END || '"' ||
         CASE id % 50 WHEN 3 THEN ',"lat":"' || CAST(lat AS STRING) || '"'
                      WHEN 4 THEN ''
                      WHEN 5 THEN ',"lat":null'
                      WHEN 18 THEN ',"lat":NaN'
                      WHEN 27 THEN ',"lat":"28d"'
                      WHEN 28 THEN ',"lat":"0x1p3"'
                      WHEN 29 THEN ',"lat":" 12.5 "'
                      WHEN 30 THEN ',"lat":5,"lat":null'
                      ELSE ',"lat":' || CAST(lat AS STRING) END ||
         ',"lon":' || CAST(lon AS STRING) ||
         CASE WHEN temperature IS NULL THEN '' ELSE ',"temperature":' || CAST(temperature AS STRING) END ||
         CASE WHEN humidity IS NULL THEN '' ELSE ',"humidity":' || CAST(humidity AS STRING) END ||
         CASE WHEN id % 50 = 21 THEN ',"speed_kmh":1e400' WHEN speed_kmh IS NULL THEN '' ELSE ',"speed_kmh":' || CAST(speed_kmh AS STRING) END ||
         CASE WHEN battery_pct IS NULL THEN '' ELSE ',"battery_pct":' || CAST(battery_pct AS STRING) END ||
         ',"shipment_id":"' || shipment_id || '"}}' AS body
  FROM (SELECT *, REPLACE(CAST(event_time AS STRING), ' ', 'T') AS ts_text FROM {telemetry}) t
) b""",
}

# Views other views are built from (placeholders that are not driver tables).
VIEW_DEPENDENCIES = {"messages_flat": ["telemetry"]}

# The Spark-side view names are "routes" and "scenarios" (with array columns);
# the flat forms are what SQL on both engines can express.
VIEWS = ["carriers", "shipments", "telemetry", "anomaly_events", "routes", "scenarios",
         "training", "shipment_updates"]


def view_sql_for_oracle(name: str) -> str:
    """Fixture SQL with plain driver-table and view names (DuckDB side)."""
    names = {t: t for t in DRIVER_TABLES}
    names.update({v: v for v in VIEW_DEPENDENCIES.get(name, [])})
    return VIEW_SQL[name].format(**names).strip()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _sql(self, name: str) -> DataFrame:
        sql = VIEW_SQL[name]
        needed = {t: self.table(t) for t in DRIVER_TABLES if "{" + t + "}" in sql}
        needed.update({v: self._sql(v) for v in VIEW_DEPENDENCIES.get(name, [])})
        return self.spark.sql(sql, **needed)

    def carriers(self) -> DataFrame:
        return self._sql("carriers")

    def shipments(self) -> DataFrame:
        return self._sql("shipments")

    def telemetry(self) -> DataFrame:
        return self._sql("telemetry")

    def anomaly_events(self) -> DataFrame:
        return self._sql("anomaly_events")

    def routes_flat(self) -> DataFrame:
        return self._sql("routes_flat")

    def routes(self) -> DataFrame:
        """Routes with the array columns built from their flat encodings."""
        flat = self.routes_flat()
        return flat.select(
            "route_id", "origin_hub", "destination_hub", "carrier_id", "estimated_transit_days",
            "base_cost_usd", "cost_per_kg_usd",
            F.split("waypoints_csv", ",").alias("waypoints"),
            F.when(F.col("n_filter").isNull(), F.lit(None).cast("array<string>"))
             .when(F.col("n_filter") == 0, F.array().cast("array<string>"))
             .otherwise(F.array("carrier_id")).alias("carrier_ids_filter"),
            "active",
        )

    def scenarios_flat(self) -> DataFrame:
        return self._sql("scenarios_flat")

    def scenarios(self) -> DataFrame:
        flat = self.scenarios_flat()
        return flat.select(
            F.col("scenario_id").cast("long").alias("scenario_id"), "origin_hub",
            "destination_hub", "cargo_weight_kg",
            F.when(F.col("any_carrier"), F.array().cast("array<string>"))
             .otherwise(F.array(F.lit("C3"))).alias("carrier_ids"),
            F.col("max_transit_days").cast("int").alias("max_transit_days"),
            "avoid_anomaly_routes",
        )

    def dirty_shipments(self) -> DataFrame:
        return self._sql("dirty_shipments")

    def dirty_events(self) -> DataFrame:
        return self._sql("dirty_events")

    def training(self) -> DataFrame:
        return self._sql("training")

    def shipment_updates(self) -> DataFrame:
        return self._sql("shipment_updates")

    def messages(self) -> DataFrame:
        """Gateway message envelopes (``messages_flat`` with an attribute map)."""
        # A topic arrives in many partitions; the driver tables are single files,
        # which would leave the decode to one task.
        flat = self._sql("messages_flat").repartition("id")
        return flat.select(
            "message_id", "value",
            F.create_map(F.lit("device_id"), F.col("device_id"), F.lit("shipment_id"),
                         F.col("shipment_id"), F.lit("content_type"), F.col("content_type"))
            .alias("attributes"),
            "id")
