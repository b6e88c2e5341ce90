"""Anomaly scoring.

The scorer is pluggable (M4): a fitted Spark ML model whose output has a
``probability`` vector (scored on the executors, no per-row remote call), or
a function ``Column(features array) -> Column(score)``, which keeps scoring
inside whole-stage codegen and gives exact oracles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.columns import as_of_col, clamp_unit, python_or
from cargoscope.schemas import ANOMALY_THRESHOLD, FEATURE_COLS

# Per-feature default when the value is missing (``x or default``, S1).
FEATURE_DEFAULTS = {"temperature": 0.0, "humidity": 0.0, "lat": None, "lon": None,
                    "speed_kmh": 0.0, "battery_pct": 100.0, "hours_since_last_checkpoint": 0.0}

Scorer = Callable[[Column], Column]

# Columns a fitted pipeline reads (training fills them with imputed values,
# scoring with the defaults above) and the assembled vector it builds.
MODEL_INPUTS = [f"feat_{n}" for n in FEATURE_COLS]
ASSEMBLED = "feature_vec"


def feature_columns(df: DataFrame) -> list[Column]:
    """The seven features in model order with the scoring defaults.

    ``hours_since_last_checkpoint`` is optional: absent means 0.0 (S24).
    """
    cols = []
    for name in FEATURE_COLS:
        default = FEATURE_DEFAULTS[name]
        c = F.col(name) if name in df.columns else F.lit(None).cast("double")
        c = c.cast("double")
        cols.append((c if default is None else python_or(c, default)).alias(name))
    return cols


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """Adds the feature array."""
    return df.withColumn(name, F.array(*feature_columns(df)))


def linear_scorer(weights: Sequence[float], bias: float = 0.0) -> Scorer:
    """A column scorer ``bias + sum(w_i * x_i)`` (clamped later)."""
    def scorer(features: Column) -> Column:
        expr = F.lit(float(bias))
        for i, w in enumerate(weights):
            if w:
                expr = expr + F.lit(float(w)) * features[i]
        return expr
    return scorer


def score(df: DataFrame, scorer, mode: str = "batch", out: str = "anomaly_score") -> DataFrame:
    """Scores each row (M2, M3).

    ``mode="batch"``: a failed (null) prediction scores 0.0 (S3), then the
    score is clamped to [0, 1] (NaN -> 1.0). ``mode="direct"``: a null
    prediction stays null and ``score_error`` is true; callers raise on it.
    """
    if mode not in ("batch", "direct"):
        raise ValueError(f"mode must be batch or direct, got {mode!r}")
    with_f = feature_vector(df)
    if callable(scorer) and not hasattr(scorer, "transform"):
        raw = with_f.withColumn("_raw_score", scorer(F.col("features")).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array
        staged = with_f.select("*", *[c.alias(f) for c, f in zip(feature_columns(df), MODEL_INPUTS)])
        scored = scorer.transform(staged)
        raw = (scored.withColumn("_raw_score", vector_to_array("probability")[1])
               .drop(*MODEL_INPUTS, ASSEMBLED, "rawPrediction", "probability", "prediction"))
    if mode == "batch":
        result = raw.withColumn(out, clamp_unit("_raw_score", null_as=0.0))
    else:
        result = (raw.withColumn("score_error", F.col("_raw_score").isNull())
                     .withColumn(out, clamp_unit("_raw_score", null_as=None)))
    return result.drop("_raw_score")


def flag_anomalies(df: DataFrame, threshold: float = ANOMALY_THRESHOLD,
                   score_col: str = "anomaly_score") -> DataFrame:
    """``is_anomaly = score >= threshold`` (inclusive, B19/S2) and the threshold."""
    return (df.withColumn("is_anomaly", F.col(score_col) >= F.lit(float(threshold)))
              .withColumn("threshold", F.lit(float(threshold))))


def anomaly_results(flagged: DataFrame) -> DataFrame:
    """The per-message result record."""
    msg = F.col("message_id") if "message_id" in flagged.columns else F.lit(None).cast("string")
    return flagged.select("device_id", "shipment_id", "anomaly_score", "is_anomaly", "threshold",
                          msg.alias("message_id"))


def emit_anomalies(results: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Anomalies as (topic messages, ``anomaly_events`` rows) (A3).

    Messages carry the JSON result and attributes device_id, shipment_id and
    the score as text; table rows get event time ``as_of`` and the result JSON
    as details. A row's id is a digest of its message id in UUID form, the same
    for every replay (a random one where there is no message id).
    """
    hits = results.filter(F.col("is_anomaly"))
    payload = F.to_json(F.struct("device_id", "shipment_id", "anomaly_score", "is_anomaly",
                                 "threshold", "message_id"))
    attrs = F.create_map(F.lit("device_id"), F.col("device_id"), F.lit("shipment_id"),
                         F.col("shipment_id"), F.lit("anomaly_score"),
                         F.col("anomaly_score").cast("string"))
    messages = hits.select(F.coalesce(F.col("message_id"), F.expr("uuid()")).alias("message_id"),
                           payload.alias("value"), attrs.alias("attributes"))
    digest = F.regexp_replace(F.md5("message_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
                              "$1-$2-$3-$4-$5")
    events = hits.select(F.coalesce(digest, F.expr("uuid()")).alias("event_id"), "device_id", "shipment_id",
                         F.lit(None).cast("string").alias("route_id"), "anomaly_score",
                         as_of_col(as_of).alias("event_time"), F.lit(False).alias("resolved"),
                         F.lit(None).cast("timestamp").alias("resolved_at"), payload.alias("details"))
    return messages, events


def checkpoint_gap(df: DataFrame, key: str = "shipment_id", time_col: str = "event_time",
                   tie: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Derived feature (X1): hours since the previous telemetry row of the
    same shipment (order: time, then ``tie``); null for a shipment's first row
    (scored as 0.0). The previous row comes from ``plans.ranking.with_previous``,
    which splits a hot shipment across tasks instead of one window partition."""
    from cargoscope.plans.ranking import with_previous
    out = with_previous(df, key, [time_col, tie], name="_prev", num_partitions=num_partitions)
    hours = F.timestamp_diff("MICROSECOND", F.col(f"_prev.{time_col}"), F.col(time_col)) \
        .cast("double") / 3.6e9
    return out.withColumn("hours_since_last_checkpoint", hours).drop("_prev")


REQUIRED_FEATURES = ("device_id", "shipment_id", "lat", "lon")
OPTIONAL_FEATURES = ("temperature", "humidity", "speed_kmh", "battery_pct",
                     "hours_since_last_checkpoint")


class IncompleteFeatures(ValueError):
    """A required feature is missing (the direct endpoint's 422)."""


class ScoringFailed(RuntimeError):
    """The scorer produced no score (the direct endpoint's 502)."""


def score_direct(spark, features: dict, scorer, threshold: float = ANOMALY_THRESHOLD) -> dict:
    """Single-row scoring (M3): one feature record in, one result record out.

    Missing device_id, shipment_id, lat or lon raise ``IncompleteFeatures``;
    a failed prediction raises ``ScoringFailed`` instead of scoring 0.0 (S3).
    The row goes through the same ``score``/``flag_anomalies`` plan as batches.
    """
    missing = [f for f in REQUIRED_FEATURES if features.get(f) is None]
    if missing:
        raise IncompleteFeatures(f"missing required features: {', '.join(missing)}")
    schema = ("device_id string, shipment_id string, lat double, lon double, "
              + ", ".join(f"{f} double" for f in OPTIONAL_FEATURES))
    row = tuple(features.get(f) for f in (*REQUIRED_FEATURES, *OPTIONAL_FEATURES))
    row = row[:2] + tuple(None if v is None else float(v) for v in row[2:])
    df = spark.createDataFrame([row], schema)
    [result] = flag_anomalies(score(df, scorer, mode="direct"), threshold).select(
        "device_id", "shipment_id", "anomaly_score", "is_anomaly", "threshold", "score_error").collect()
    if result.score_error:
        raise ScoringFailed("the scorer returned no prediction")
    return {k: result[k] for k in ("device_id", "shipment_id", "anomaly_score", "is_anomaly", "threshold")}
