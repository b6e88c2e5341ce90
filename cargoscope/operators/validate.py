"""Decode and validate raw telemetry messages.

Everything is a column expression over the message rows: no shuffle, no
Python per row. ``reject_reason`` is null for accepted rows.

Decode (``decode_telemetry``) reproduces the ingestion gateway:
* content type must equal ``application/json`` exactly -> ``content_type``,
  checked before the body is decoded (S17);
* only the first 1 MiB of a body is decoded (S16);
* the body must be one JSON object or ``null`` (all fields absent) with
  nothing after it, else ``malformed`` (S15);
* keys match without case; of several the last wins, where null leaves plain
  fields as they were and clears optional ones; every one must have the
  declared type: strings, finite numbers, an RFC 3339 timestamp with offset
  (S14), any number of fraction digits, offsets up to 23:59;
* absent or null lat/lon decode as 0.0 and are accepted (S11).
Known deviation: duplicate keys inside a nested, unknown object are refused.

Rules (``validate_telemetry``, S12/S13): first failing rule wins, in the
order device_id, shipment_id, timestamp, stale, lat, lon, temperature,
humidity, battery_pct. Speed is never range-checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.columns import as_of_col, col_of, snippet

MAX_BODY_BYTES = 1 << 20
CONTENT_TYPE = "application/json"
STALE_AFTER_HOURS = 24
# Groups: local time, fraction, offset, its sign, hours and minutes.
RFC3339 = (r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?"
           r"(Z|([+-])([01]\d|2[0-3]):([0-5]\d))$")
# Texts that the scoring service's float fields accept.
FLOAT_TEXT = (r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?"
              r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")
NUMERIC_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
OPTIONAL_SENSORS = ["temperature", "humidity", "speed_kmh", "battery_pct"]

# Rule order and bounds of the gateway's validation (fixed values).
RULE_ORDER = ["device_id", "shipment_id", "timestamp", "stale", "lat", "lon", "temperature",
              "humidity", "battery_pct"]
BOUNDS = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "temperature": (-100.0, 200.0),
          "humidity": (0.0, 100.0), "battery_pct": (0.0, 100.0)}

# Error texts of the gateway responses (fixed values).
ERROR_TEXT = {
    "content_type": "Content-Type must be application/json",
    "malformed": "invalid JSON",
    "device_id": "payload validation failed: missing required field: device_id",
    "shipment_id": "payload validation failed: missing required field: shipment_id",
    "timestamp": "payload validation failed: missing required field: timestamp",
    "stale": "payload validation failed: stale timestamp — possible replay attack (device_id=%s)",
    "lat": "payload validation failed: invalid latitude: %f (must be -90..90)",
    "lon": "payload validation failed: invalid longitude: %f (must be -180..180)",
    "temperature": "payload validation failed: temperature out of physical range: %f",
    "humidity": "payload validation failed: humidity out of range: %f",
    "battery_pct": "payload validation failed: battery_pct out of range: %f",
}
STATUS_ACCEPTED, STATUS_BAD_REQUEST, STATUS_UNSUPPORTED = 202, 400, 415
STATUS_SERVER_ERROR = 500  # a failed publish


# ------------------------------------------------------------------ decoding
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _entries(body: Column, any_case: bool = False) -> Column:
    """Key-value pairs (in text order, repeats kept) of a body that is exactly
    one JSON object; an empty array for ``null``; null for anything else.

    The body is parsed as the first of two array elements. The second is a
    sentinel that names the body's digest, so a body that closes the array
    itself, or is followed by more text, cannot pass.
    """
    digest = F.sha2(body.cast("binary"), 256)
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit(',{"'), digest, F.lit('":0}]')),
                          "array<map<string,variant>>", _STRICT_JSON)
    alone = (F.size(wrapped) == 2) & F.map_contains_key(F.get(wrapped, F.lit(1)), digest)
    first = F.get(wrapped, F.lit(0))
    pairs = F.map_entries(first)
    if any_case:
        pairs = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return (F.when(alone & first.isNotNull(), pairs)
            .when(alone & body.rlike("^[ \\t\\n\\r]*null[ \\t\\n\\r]*$"),
                  F.array().cast("array<struct<key:string,value:variant>>")))


# A flat body: one object whose values are texts, numbers of at most 15 digits on
# either side of the point (no negative zero), truth values or nulls.
_WS = r"[ \t\n\r]*+"
_TEXT = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
_NUMBER = r"(?!-0(?:\.0*+)?[^\d.])-?(?:0|[1-9]\d{0,14})(?:\.\d{1,15})?(?:[eE][+-]?\d{1,2})?"
_PAIR = rf'{_WS}"[A-Za-z0-9_]++"{_WS}:{_WS}(?:{_TEXT}|{_NUMBER}|null|true|false){_WS}'
FLAT_BODY = rf"^{_WS}\{{{_PAIR}(?:,{_PAIR})*+\}}{_WS}$"
FLAT_BODY_CHARS = 4096  # longer bodies take the general way, with the same result


def _typed(msgs: DataFrame, body: Column, texts: list[str], numbers: list[str],
           strict: bool) -> DataFrame:
    """Adds ``_plain``, ``_s``, the typed fields of a plain body, and ``_e``, the
    entries of any other. ``strict``: known keys match in any case (the entries'
    keys are lower-case), and a flat body with a known key of another type has no
    entries, as one that does not parse.

    A flat body is parsed straight into typed fields. That decodes it as the
    general way does if no text field has a value of another type, and every
    known key with a value gave a field of its own: a key that comes twice, in
    another case or with a value of another type makes the two numbers differ.
    In a flat body a quoted name before a colon is always a key.
    """
    schema = ", ".join([f"{c} string" for c in texts] + [f"{c} double" for c in numbers])
    case, colon = "(?i)" if strict else "", rf'"{_WS}:{_WS}'
    text, number = (rf'"(?:{"|".join(names)}){colon}' for names in (texts, numbers))
    given = rf'{case}{text}"|{number}[^n \t\n\r]'
    other = rf'{case}{text}[^"n \t\n\r]' + (rf'|{number}["tf]' if strict else "")
    fields = sum((F.col("_s")[c].isNotNull().cast("int") for c in texts + numbers), F.lit(0))
    flat = F.coalesce((F.length(body) <= FLAT_BODY_CHARS) & body.rlike(FLAT_BODY), F.lit(False))
    typed = msgs.withColumn("_s", F.when(flat, F.from_json(body, schema))).withColumn(
        "_other", F.col("_s").isNotNull() & body.rlike(other))
    plain = (F.col("_s").isNotNull() & ~F.col("_other")
             & (F.regexp_count(body, F.lit(given)) == fields))
    entries = F.when(~F.col("_plain") & ~(F.col("_other") & F.lit(strict)), _entries(body, strict))
    return typed.withColumn("_plain", plain).withColumn("_e", entries)


def _values(name: str) -> Column:
    """The values of a key, in text order."""
    return F.transform(F.filter("_e", lambda e: e["key"] == name), lambda e: e["value"])


def _every(values: Column, check, check_one=None) -> Column:
    """``check`` of every value; a single one (or none) is checked outside the
    array, where the check compiles (by ``check_one``, if given)."""
    one = F.get(values, F.lit(0))
    return (F.when(F.size(values) <= 1, one.isNull() | (check_one or check)(one))
            .otherwise(F.forall(values, check)))


def _last(values: Column, skip_null: bool = False) -> Column:
    if skip_null:
        values = F.filter(values, lambda v: ~F.is_variant_null(v))
    return F.get(values, F.size(values) - 1)


def _is_number(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return (F.schema_of_variant(value).rlike(NUMERIC_TYPES) & number.isNotNull()
            & (F.abs(number) < float("inf")))


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _instant(text: Column) -> Column:
    """RFC 3339 text as a timestamp: fraction cut to microseconds, offset by
    arithmetic; null if it is no such text or no such date."""
    # One pattern match; the parts then stand at fixed places from either end.
    zulu = F.endswith(text, F.lit("Z"))
    fraction = F.substr(text, F.lit(20), F.length(text) - F.when(zulu, 20).otherwise(25))
    micros = F.rpad(F.substring(F.when(fraction == "", ".").otherwise(fraction), 1, 7), 7, "0")
    local = F.try_to_timestamp(F.concat(F.substring(text, 1, 19), micros, F.lit("Z")))
    minutes = (F.substring(text, -5, 2).try_cast("int") * 60
               + F.substring(text, -2, 2).try_cast("int"))
    signed = F.when(F.substring(text, -6, 1) == "-", -minutes).otherwise(minutes)
    offset = F.make_dt_interval(mins=F.when(zulu, 0).otherwise(signed))
    return F.when(text.rlike(RFC3339), local - offset)


def _is_instant(value: Column) -> Column:
    return _is_string(value) & _instant(F.try_variant_get(value, "$", "string")).isNotNull()


def _fixed(staged: DataFrame, keep: list[str], fields: list[Column]) -> DataFrame:
    """The kept columns and the decoded fields. Fields pass through a generator
    of one row, which a later filter on them is not pushed below: it would
    repeat the whole decode once for each reference."""
    return staged.select(*keep, F.inline(F.array(F.struct(*fields))))


def decode_telemetry(msgs: DataFrame, body_col: str = "value",
                     attributes_col: str | None = "attributes") -> DataFrame:
    """Strict decode of gateway messages (B1, B2). Adds the telemetry fields
    and ``decode_reason`` (``content_type`` / ``malformed`` / null).

    A plain body is parsed once into typed fields (:func:`_typed`); any other
    into its entries, and then the values of each field, in separate
    projections, which Catalyst keeps apart.
    """
    body = F.col(body_col)
    cut = F.when(F.octet_length(body) > MAX_BODY_BYTES,
                 F.substring(body.cast("binary"), 1, MAX_BODY_BYTES).cast("string")).otherwise(body)
    if attributes_col is None:
        content_ok = F.lit(True)
    else:
        content_ok = F.coalesce(F.element_at(F.col(attributes_col), F.lit("content_type"))
                                == CONTENT_TYPE, F.lit(False))
    kinds = {"device_id": _is_string, "shipment_id": _is_string, "timestamp": _is_instant,
             **{f: _is_number for f in ("lat", "lon", *OPTIONAL_SENSORS)}}
    texts = ["device_id", "shipment_id", "timestamp"]
    staged = _typed(msgs, cut, texts, ["lat", "lon", *OPTIONAL_SENSORS], strict=True)
    staged = staged.select("*", *[_values(f).alias(f"_a_{f}") for f in kinds])

    def null_or(kind):
        return lambda v: F.is_variant_null(v) | kind(v)

    # The time's text and the time are used several times: projections of their own.
    at = _last(F.col("_a_timestamp"), skip_null=True)
    staged = staged.withColumn("_text", F.when(F.col("_plain"), F.col("_s")["timestamp"]).otherwise(
        F.try_variant_get(at, "$", "string"))).withColumn("_time", _instant(F.col("_text")))

    def known_time(value):
        return F.is_variant_null(value) | (_is_string(value) & F.col("_time").isNotNull())

    typed = F.lit(True)
    for f, kind in kinds.items():
        typed = typed & _every(F.col(f"_a_{f}"), null_or(kind), known_time if f == "timestamp" else None)
    # The gateway checks the content type first, so 415 wins over any body defect.
    reason = (F.when(~content_ok, "content_type")
              .when(F.when(F.col("_plain"), F.col("_text").isNotNull() & F.col("_time").isNull())
                    .otherwise(F.col("_e").isNull() | ~F.coalesce(typed, F.lit(False))), "malformed"))
    staged = staged.withColumn("decode_reason", reason)
    decoded = F.col("decode_reason").isNull()

    def field(name, as_type, skip_null=True):
        # A message that does not decode has no fields (the gateway stops there).
        value = _last(F.col(f"_a_{name}"), skip_null)
        return F.when(decoded & F.col("_plain"), F.col("_s")[name]).when(
            decoded, F.try_variant_get(value, "$", as_type))

    return _fixed(staged, msgs.columns, [
        field("device_id", "string").alias("device_id"),
        field("shipment_id", "string").alias("shipment_id"),
        F.when(decoded, F.col("_time")).alias("timestamp"),
        *[F.when(decoded, F.coalesce(field(f, "double"), F.lit(0.0))).alias(f)
          for f in ("lat", "lon")],
        *[field(f, "double", skip_null=False).alias(f) for f in OPTIONAL_SENSORS],
        F.col("decode_reason")])


def decode_features(msgs: DataFrame, body_col: str = "value") -> DataFrame:
    """Looser decode of the scoring service (B25): unknown fields ignored, no
    timestamp needed, numbers, numeric strings (:data:`FLOAT_TEXT`) or booleans
    for floats, only strings for ids; missing ids or lat/lon reject. Of
    several equal keys the last wins. ``decode_reason`` is ``malformed`` for
    skipped messages (they are still acknowledged, S18).

    Plain bodies by a typed parse, the others by entries and last values.
    """
    ids = ["device_id", "shipment_id"]
    required = ["lat", "lon"]
    optional = [*OPTIONAL_SENSORS, "hours_since_last_checkpoint"]
    staged = _typed(msgs, F.col(body_col), ids, required + optional, strict=False)
    staged = staged.select("*", *[_last(_values(f)).alias(f"_l_{f}")
                                  for f in ids + required + optional])
    staged = staged.select("*", *[F.schema_of_variant(f"_l_{f}").alias(f"_t_{f}")
                                  for f in ids + required + optional])

    def value(f):
        v, t = F.col(f"_l_{f}"), F.col(f"_t_{f}")
        text = F.try_variant_get(v, "$", "string")
        return F.coalesce(
            F.when(t.rlike(NUMERIC_TYPES), F.try_variant_get(v, "$", "double")),
            F.when((t == "STRING") & text.rlike(FLOAT_TEXT), F.trim(text).try_cast("double")),
            F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")))

    def missing(f):
        return F.col(f"_t_{f}").isNull() | (F.col(f"_t_{f}") == "VOID")

    # An empty entry list is JSON null or {}: either lacks the required fields.
    plain, incomplete = F.col("_plain"), F.lit(False)
    bad = F.col("_e").isNull()
    fields = {}
    for f in ids:
        bad = bad | missing(f) | (F.col(f"_t_{f}") != "STRING")
        fields[f] = F.try_variant_get(F.col(f"_l_{f}"), "$", "string")
    for f in required + optional:
        fields[f] = value(f)
        bad = bad | (fields[f].isNull() if f in required else ~missing(f) & fields[f].isNull())
    for f in ids + required:
        incomplete = incomplete | F.col("_s")[f].isNull()
    fields = {f: F.when(plain, F.col("_s")[f]).otherwise(c) for f, c in fields.items()}
    staged = staged.withColumn("decode_reason", F.when(F.when(plain, incomplete).otherwise(bad), "malformed"))
    decoded = F.col("decode_reason").isNull()
    # A skipped message has no fields.
    return _fixed(staged, msgs.columns,
                  [*[F.when(decoded, c).alias(n) for n, c in fields.items()], F.col("decode_reason")])


# ---------------------------------------------------------------- validation
def _out_of(c: Column, lo: float, hi: float) -> Column:
    """Outside [lo, hi] by ordered comparisons (NaN compares false, as in Go)."""
    return ~F.isnan(c) & ((c < lo) | (c > hi))


def rejection_reason(as_of=None, time_col: str = "event_time", strict_gps: bool = False,
                     check_stale: bool = True, zoned: bool = False) -> Column:
    """The ordered rule chain as one CASE expression.

    ``zoned`` says whether ``time_col`` is a zoned ``timestamp``; literals
    are then UTC instants, else naive UTC wall-clock times.
    """
    dev, ship, ts = F.col("device_id"), F.col("shipment_id"), F.col(time_col)
    lat, lon = F.col("lat"), F.col("lon")
    zero_time = as_of_col("0001-01-01 00:00:00", zoned=zoned)
    chain = (F.when(dev.isNull() | (dev == ""), "device_id")
             .when(ship.isNull() | (ship == ""), "shipment_id")
             .when(ts.isNull() | (ts == zero_time), "timestamp"))
    if check_stale:
        limit = as_of_col(as_of, zoned=zoned) - F.expr(f"INTERVAL {STALE_AFTER_HOURS} HOURS")
        chain = chain.when(ts < limit, "stale")
    if strict_gps:
        chain = chain.when(lat.isNull(), "lat").when(lon.isNull(), "lon")
    lat, lon = F.coalesce(lat, F.lit(0.0)), F.coalesce(lon, F.lit(0.0))
    chain = chain.when(_out_of(lat, *BOUNDS["lat"]), "lat").when(_out_of(lon, *BOUNDS["lon"]), "lon")
    for f in ("temperature", "humidity", "battery_pct"):
        c = F.col(f)
        chain = chain.when(c.isNotNull() & _out_of(c, *BOUNDS[f]), f)
    return chain


def validate_telemetry(df: DataFrame, as_of=None, time_col: str = "event_time",
                       strict_gps: bool = False, check_stale: bool = True) -> DataFrame:
    """Adds ``reject_reason``; rows already refused by the decoder keep the
    decoder's reason. ``as_of`` defaults to the query start time."""
    zoned = dict(df.dtypes).get(time_col) == "timestamp"
    reason = rejection_reason(as_of, time_col, strict_gps, check_stale, zoned=zoned)
    if "decode_reason" in df.columns:
        decoded = F.col("decode_reason")
        reason = F.when(decoded.isNotNull(), decoded).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def ingest_result(df: DataFrame, body_col: str | None = "value") -> DataFrame:
    """Per-message response (B7): status code, error text, body snippet."""
    r = F.col("reject_reason")
    status = (F.when(r.isNull(), STATUS_ACCEPTED).when(r == "content_type", STATUS_UNSUPPORTED)
              .otherwise(STATUS_BAD_REQUEST))
    text = F.lit(None).cast("string")
    for key, msg in ERROR_TEXT.items():
        if key == "stale":
            value = F.format_string(msg, F.col("device_id"))
        elif "%f" in msg:
            value = F.format_string(msg, F.col(key).cast("double"))
        else:
            value = F.lit(msg)
        text = F.when(r == key, value).otherwise(text)
    out = df.withColumn("status_code", status).withColumn("error", text)
    if body_col is not None and body_col in df.columns:
        out = out.withColumn("body_snippet", F.when(r == "malformed", snippet(col_of(body_col), 200)))
    return out


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by ``reject_reason`` (A4: rejects go to quarantine)."""
    return df.filter(F.col("reject_reason").isNull()), df.filter(F.col("reject_reason").isNotNull())


def ingest_request(spark, body: str, content_type: str = CONTENT_TYPE, as_of=None,
                   message_id: str = "request") -> tuple[int, dict]:
    """One gateway request, as the handler answers it: ``(status, response)``.

    202 with ``{"status": "accepted", "message_id", "device_id"}``, or 400/415
    with ``{"error": text}``. Runs the same decode/validate/result plan as the
    batch and the stream on a one-row frame.
    """
    msgs = spark.createDataFrame([(message_id, body, {"content_type": content_type})],
                                 "message_id string, value string, attributes map<string,string>")
    checked = validate_telemetry(decode_telemetry(msgs), as_of=as_of, time_col="timestamp")
    [r] = ingest_result(checked).select("status_code", "error", "device_id").collect()
    if r.status_code == STATUS_ACCEPTED:
        return r.status_code, {"status": "accepted", "message_id": message_id, "device_id": r.device_id}
    return r.status_code, {"error": r.error}
