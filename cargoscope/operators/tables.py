"""Table maintenance: upsert, defaults, constraint checks, orphans, retention,
time-partitioned writes (A7, A9, A10, A12, C7, G7, X4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import schemas
from cargoscope.functions.columns import as_of_col, as_of_for

DEFAULT_STATUS = "in_transit"
DEFAULT_METADATA = "{}"
DEFAULT_COST_PER_KG = 0.01


SHIPMENT_COLUMNS = ["shipment_id", "origin_hub", "destination_hub", "carrier_id", "status",
                    "created_at", "updated_at", "metadata"]


def _merge_columns(now: F.Column) -> list[F.Column]:
    """Row values after the upsert, over ``c.*`` (current, may be absent) and
    ``p.*`` (combined updates, may be absent)."""
    updated = F.col("p.shipment_id").isNotNull()
    existing = F.col("c.shipment_id").isNotNull()
    return [
        F.coalesce(F.col("c.shipment_id"), F.col("p.shipment_id")).alias("shipment_id"),
        F.when(existing, F.col("c.origin_hub")).otherwise(F.col("p._first.origin_hub")).alias("origin_hub"),
        F.when(existing, F.col("c.destination_hub")).otherwise(F.col("p._first.destination_hub"))
         .alias("destination_hub"),
        F.when(existing, F.col("c.carrier_id")).otherwise(F.col("p._first.carrier_id")).alias("carrier_id"),
        F.when(updated, F.col("p._last.status")).otherwise(F.col("c.status")).alias("status"),
        F.when(existing, F.col("c.created_at")).otherwise(now).alias("created_at"),
        F.when(updated, now).otherwise(F.col("c.updated_at")).alias("updated_at"),
        F.when(updated, F.col("p._last.metadata")).otherwise(F.col("c.metadata")).alias("metadata"),
    ]


def upsert_shipments(current: DataFrame, updates: DataFrame, as_of=None,
                     seq_col: str = "seq") -> DataFrame:
    """Insert-or-partial-update of shipments.

    New keys are inserted with created_at = updated_at = ``as_of``. On a
    conflict origin, destination, carrier and created_at are kept; status and
    metadata are overwritten and updated_at set to ``as_of``. An update without
    status means ``in_transit``, without metadata ``{}``. Several updates to one
    key apply in ``seq`` order: the first supplies the insert-only columns,
    the last the overwritten ones. Returns the whole new table.

    Updates are combined per key first (partial aggregation, so a key with a
    third of the updates never reaches one task whole), then meet the table
    in one full-outer join. Both sides have one row per key there, so no key
    is hot.
    """
    now = as_of_for(current, "updated_at", as_of)
    u = updates
    if seq_col not in u.columns:
        u = u.withColumn(seq_col, F.lit(0))
    u = (u.withColumn("status", F.coalesce(F.col("status"), F.lit(DEFAULT_STATUS)))
          .withColumn("metadata", F.coalesce(json_text("metadata"), F.lit(DEFAULT_METADATA))))
    seq = F.col(seq_col)
    per_key = u.groupBy("shipment_id").agg(
        F.min_by(F.struct("origin_hub", "destination_hub", "carrier_id"), seq).alias("_first"),
        F.max_by(F.struct("status", "metadata"), seq).alias("_last"))
    c = current.select(*SHIPMENT_COLUMNS).alias("c")
    return c.join(per_key.alias("p"), F.col("c.shipment_id") == F.col("p.shipment_id"),
                  "full_outer").select(*_merge_columns(now))


def shipments_table(spark, path: str, buckets: int = 256):
    """The shipments table in buckets by shipment, for :func:`upsert_buckets`."""
    from cargoscope.sources.buckets import BucketedTable, hashed
    return BucketedTable(spark, path, hashed("shipment_id", buckets=buckets))


def upsert_buckets(table, updates: DataFrame, as_of=None, seq_col: str = "seq") -> list[int]:
    """:func:`upsert_shipments` into a bucketed table: reads and rewrites the
    buckets that hold an update's shipment; the others' files stay. Returns
    the buckets rewritten."""
    def combine(current, changes):
        if current is None:
            current = changes.sparkSession.createDataFrame([], schemas.SHIPMENTS)
        return upsert_shipments(current, changes, as_of, seq_col)
    return table.merge(updates, combine)


def json_text(col: str) -> F.Column:
    """Text that a JSON column takes; anything else raises, as the cast does
    in the database (use :func:`bad_json` to find such rows first)."""
    c = F.col(col)
    return F.when(c.isNotNull() & F.try_parse_json(c).isNull(),
                  F.raise_error(F.concat(F.lit("invalid JSON: "), c))).otherwise(c)


def bad_json(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is not JSON text (null is allowed)."""
    return df.filter(F.col(col).isNotNull() & F.try_parse_json(F.col(col)).isNull())


def with_defaults(df: DataFrame, table: str, as_of=None, id_offset: int = 0) -> DataFrame:
    """Column defaults on insert (A12): missing or null values get the DDL default.

    Serial ids are unique but not dense (``monotonically_increasing_id``
    plus ``id_offset``); UUIDs come from ``uuid()``.
    """
    now = as_of_col(as_of)
    defaults = {
        "shipments": {"status": F.lit(DEFAULT_STATUS), "created_at": now, "updated_at": now},
        "telemetry": {"id": F.monotonically_increasing_id() + F.lit(id_offset), "event_time": now},
        "anomaly_events": {"event_id": F.expr("uuid()"), "event_time": now,
                           "resolved": F.lit(False)},
        "routes": {"cost_per_kg_usd": F.lit(DEFAULT_COST_PER_KG), "active": F.lit(True)},
        "carriers": {"active": F.lit(True)},
    }[table]
    out = df
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


def orphan_telemetry(telemetry: DataFrame, shipments: DataFrame) -> DataFrame:
    """Telemetry rows whose shipment does not exist (C7, the foreign key).

    A left-anti join; AQE splits a hot shipment's side when it is skewed.
    """
    return telemetry.join(shipments.select("shipment_id"), "shipment_id", "left_anti")


def check_table(df: DataFrame, table: str) -> DataFrame:
    """Constraint violations of a table (X4): NOT NULL counts, primary-key
    duplicates (keys seen more than once), status domain.

    Returns ``table_name, check_name, column_name, violations`` (one row per
    check, zero included). One aggregate pass for null/domain checks, one
    partially-aggregated groupBy for the key.
    """
    schema = schemas.TABLES[table]
    checks = []
    for field in schema.fields:
        if not field.nullable:
            # A required column that is absent is null in every row.
            broken = (F.count_if(F.col(field.name).isNull()) if field.name in df.columns
                      else F.count(F.lit(1)))
            checks.append(("not_null", field.name, broken))
    for (tname, cname), allowed in schemas.DOMAINS.items():
        if tname == table and cname in df.columns:
            checks.append(("domain", cname,
                           F.count_if(F.col(cname).isNotNull() & ~F.col(cname).isin(allowed))))
    agg = df.agg(*[expr.alias(f"c{i}") for i, (_, _, expr) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(kind).alias("check_name"), F.lit(col).alias("column_name"),
                              F.col(f"c{i}").alias("violations"))
                     for i, (kind, col, _) in enumerate(checks)])
    simple = agg.select(F.inline(rows))
    pk = schemas.PRIMARY_KEYS[table]
    dup = (df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
           .agg(F.count(F.lit(1)).alias("violations"))
           .select(F.lit("primary_key").alias("check_name"), F.lit(",".join(pk)).alias("column_name"),
                   "violations"))
    return simple.unionByName(dup).select(F.lit(table).alias("table_name"), "*")


def apply_retention(df: DataFrame, as_of=None, days: int = 7, time_col: str = "event_time") -> DataFrame:
    """Keep rows no older than ``days`` at ``as_of`` (G7: 7 days for topics, 1 day
    for the anomaly subscription). Where the table has ``event_month`` or
    ``event_date`` partitions, their bound is added, so older ones are never
    listed or opened (the time filter alone cannot prune them)."""
    since = as_of_for(df, time_col, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return since_partitions(df, since).filter(F.col(time_col) >= since)


def since_partitions(df: DataFrame, since: F.Column) -> DataFrame:
    """Adds the partition bound that ``time >= since`` implies."""
    if "event_month" in df.columns:
        df = df.filter(F.col("event_month") >= F.date_format(since, "yyyy_MM"))
    if "event_date" in df.columns:
        df = df.filter(F.col("event_date") >= F.to_date(since))
    return df


def with_time_partitions(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Adds ``event_month`` (yyyy_MM, the table's monthly partitions) and
    ``event_date`` (the warehouse's daily partitions)."""
    return (df.withColumn("event_month", F.date_format(F.col(time_col), "yyyy_MM"))
              .withColumn("event_date", F.to_date(F.col(time_col))))


def write_telemetry(df: DataFrame, path: str, grain: str = "month", time_col: str = "event_time",
                    cluster_by: str = "device_id", mode: str = "append") -> None:
    """Time-partitioned telemetry write.

    ``grain="month"``: ``partitionBy(event_month)``; ``grain="day"``:
    ``partitionBy(event_date)``. Rows are range-partitioned on (partition
    value, ``cluster_by``, time) and sorted the same way inside each file, so
    parquet min/max stats let a device filter skip row groups (the
    warehouse's clustering), and a device with a third of the rows is split
    across writer tasks by time instead of landing in one.
    """
    part_col = {"month": "event_month", "day": "event_date"}[grain]
    out = with_time_partitions(df, time_col)
    (out.repartitionByRange(part_col, cluster_by, time_col)
        .sortWithinPartitions(part_col, cluster_by, time_col)
        .write.mode(mode).partitionBy(part_col).parquet(path))


def partition_range_violations(df: DataFrame, as_of=None, months: int = 4,
                               time_col: str = "event_time") -> DataFrame:
    """Rows outside the monthly partitions that exist (current month and the
    next three); the database refuses such rows (S27)."""
    start = F.date_trunc("month", as_of_for(df, time_col, as_of))
    end = F.add_months(start, months)
    t = F.col(time_col)
    if "event_month" in df.columns:  # whole months inside the range hold no violation
        inside = F.col("event_month").between(F.date_format(start, "yyyy_MM"),
                                              F.date_format(F.add_months(start, months - 1), "yyyy_MM"))
        df = df.filter(~inside)
    return df.filter((t < start) | (t >= end))
