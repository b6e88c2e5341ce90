"""Message topics as files: JSON-lines envelopes ``{message_id, value, attributes}``.

A1 ``read_messages`` (batch or streaming file source; Kafka when its jar is
on the classpath), A2 ``write_messages`` / ``publish_frame`` (re-serialize
accepted telemetry, nulls omitted, with attributes), A4 quarantine rows,
A8 bounded pulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope import schemas
from cargoscope.functions.columns import snippet

MAX_PULL, DEFAULT_PULL = 200, 50
TELEMETRY_FIELDS = ["device_id", "timestamp", "lat", "lon", "temperature", "humidity",
                    "speed_kmh", "battery_pct", "shipment_id"]
RFC3339_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


#: The file source forgets files older than this against its newest one. Its
#: default of a week would skip late copies and replays without a trace.
MAX_FILE_AGE = "3650d"
FILES_PER_TRIGGER, OFFSETS_PER_TRIGGER = 1000, 10_000_000


def read_messages(spark: SparkSession, path: str | None, streaming: bool = False,
                  max_files_per_trigger: int | None = FILES_PER_TRIGGER, fmt: str = "json",
                  options: dict | None = None) -> DataFrame:
    """Message envelopes from JSON-lines files (or ``fmt="kafka"`` with options).

    Streams are bounded per trigger. ``arrival_time`` records the file's
    modification time or the broker's timestamp; nothing is dropped by it.
    """
    if fmt == "kafka":
        defaults = {"maxOffsetsPerTrigger": str(OFFSETS_PER_TRIGGER)} if streaming else {}
        reader = spark.readStream if streaming else spark.read
        raw = reader.format("kafka").options(**defaults, **{"includeHeaders": "true"},
                                             **(options or {})).load()
        return kafka_envelopes(raw)
    if streaming:
        reader = (spark.readStream.schema(schemas.MESSAGE).option("maxFileAge", MAX_FILE_AGE)
                  .options(**(options or {})))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        df = reader.json(path)
    else:
        df = spark.read.options(**(options or {})).schema(schemas.MESSAGE).json(path)
    return df.withColumn("arrival_time", F.col("_metadata.file_modification_time"))


def kafka_envelopes(raw: DataFrame) -> DataFrame:
    """The connector's columns as envelopes; a ``message_id`` header, which
    survives redelivery, before the record's position."""
    headers = F.map_from_entries(F.transform(
        F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")),
        lambda h: F.struct(h["key"], h["value"].cast("string"))))
    place = F.concat_ws("-", "topic", F.col("partition").cast("string"),
                        F.col("offset").cast("string"))
    return raw.withColumn("attributes", headers).select(
        F.coalesce(F.col("attributes")["message_id"], place).alias("message_id"),
        F.col("value").cast("string").alias("value"), "attributes",
        F.col("timestamp").alias("arrival_time"))


def kafka_records(messages: DataFrame) -> DataFrame:
    """Envelopes as the connector's key, value and headers columns."""
    headers = F.concat(
        F.array(F.struct(F.lit("message_id").alias("key"),
                         F.col("message_id").cast("binary").alias("value"))),
        F.coalesce(F.transform(F.map_entries("attributes"), lambda e: F.struct(
            e["key"].alias("key"), e["value"].cast("binary").alias("value"))),
            F.array().cast("array<struct<key:string,value:binary>>")))
    return messages.select(F.col("message_id").alias("key"), "value", headers.alias("headers"))


def pull(messages: DataFrame, max_messages: int = DEFAULT_PULL) -> DataFrame:
    """A bounded batch pull of 1..200 messages."""
    if not 1 <= int(max_messages) <= MAX_PULL:
        raise ValueError(f"max_messages must be in 1..{MAX_PULL}, got {max_messages}")
    return messages.limit(int(max_messages))


def telemetry_payload(df: DataFrame, time_col: str = "timestamp") -> F.Column:
    """JSON text of the telemetry struct in gateway field order; null
    optionals are omitted (``to_json`` drops null fields, B6)."""
    fields = [F.col(time_col).alias("timestamp") if f == "timestamp" else F.col(f)
              for f in TELEMETRY_FIELDS]
    return F.to_json(F.struct(*fields), {"timestampFormat": RFC3339_MICROS})


def publish_frame(accepted: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Accepted telemetry as outgoing messages with attributes (A2)."""
    attrs = F.create_map(F.lit("device_id"), F.col("device_id"),
                         F.lit("shipment_id"), F.col("shipment_id"),
                         F.lit("content_type"), F.lit("application/json"))
    msg_id = (F.col("message_id") if "message_id" in accepted.columns
              else F.sha2(telemetry_payload(accepted, time_col), 256))
    return accepted.select(msg_id.alias("message_id"), telemetry_payload(accepted, time_col).alias("value"),
                           attrs.alias("attributes"))


def quarantine_frame(rejected: DataFrame, body_col: str = "value", attempts: int = 1) -> DataFrame:
    """Rejected messages with reason and body snippet (A4 dead letter, B8)."""
    return rejected.select("message_id", "reject_reason", snippet(F.col(body_col), 200).alias("body_snippet"),
                           F.col(body_col).alias("body"), F.lit(attempts).alias("attempts"))


def write_messages(df: DataFrame, path: str | None, mode: str = "append", fmt: str = "json",
                   options: dict | None = None) -> None:
    """Writes envelopes as JSON lines, or to a broker (``fmt="kafka"``) with
    the id as key and header, so a consumer can drop what a retry repeats."""
    out = df.select("message_id", "value", "attributes")
    if fmt == "kafka":
        kafka_records(out).write.format("kafka").options(**(options or {})).save()
    else:
        out.write.mode(mode).json(path)
