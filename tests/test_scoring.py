"""Scoring: constant-score cases, S1 (falsiness), S2, S3 (clamp)."""

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import scoring

FEATURES = [("unit-7", "box-42", -3.5, 12.0, -12.25, 130.75, 51.0, 64.0, 1.25)]
SCHEMA = ("device_id string, shipment_id string, temperature double, humidity double, lat double, "
          "lon double, speed_kmh double, battery_pct double, hours_since_last_checkpoint double")


def const_scorer(value):
    return lambda features: F.lit(value).cast("double")


@pytest.mark.parametrize("mock,flag", [(0.875, True), (0.125, False), (0.75, True)])
def test_mock_scores(spark, mock, flag):
    df = spark.createDataFrame(FEATURES, SCHEMA)
    r = scoring.flag_anomalies(scoring.score(df, const_scorer(mock))).first()
    assert r.anomaly_score == mock and r.is_anomaly is flag and r.threshold == 0.75


def test_feature_vector_order_and_defaults(spark):
    df = spark.createDataFrame(FEATURES, SCHEMA)
    assert scoring.feature_vector(df).first().features == [-3.5, 12.0, -12.25, 130.75, 51.0, 64.0, 1.25]


def test_battery_zero_becomes_hundred(spark):
    rows = [("d", "s", None, None, 1.0, 2.0, None, 0.0, None),
            ("d", "s", 0.0, -0.0, 1.0, 2.0, 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.features for r in scoring.feature_vector(df).collect()]
    assert got[0] == [0.0, 0.0, 1.0, 2.0, 0.0, 100.0, 0.0]
    assert got[1] == [0.0, 0.0, 1.0, 2.0, 0.0, 100.0, 0.0]


def test_missing_checkpoint_column_is_zero(spark):
    df = spark.createDataFrame(FEATURES, SCHEMA).drop("hours_since_last_checkpoint")
    assert scoring.feature_vector(df).first().features[6] == 0.0


@pytest.mark.parametrize("raw,expected", [(None, 0.0), (float("nan"), 1.0), (-1.0, 0.0), (2.0, 1.0),
                                          (0.5, 0.5)])
def test_batch_clamp(spark, raw, expected):
    df = spark.createDataFrame(FEATURES, SCHEMA)
    r = scoring.score(df, const_scorer(raw)).first()
    assert r.anomaly_score == expected


def test_direct_mode_surfaces_errors(spark):
    df = spark.createDataFrame(FEATURES, SCHEMA)
    r = scoring.score(df, const_scorer(None), mode="direct").first()
    assert r.score_error is True and r.anomaly_score is None
    r = scoring.score(df, const_scorer(0.8), mode="direct").first()
    assert r.score_error is False and r.anomaly_score == 0.8


def test_clamp_range_property(spark):
    rows = [(float(x) / 7 - 3,) for x in range(-50, 50)] + [(None,), (float("inf"),), (float("-inf"),)]
    df = spark.createDataFrame(rows, "raw double")
    from cargoscope.functions.columns import clamp_unit
    for r in df.select(clamp_unit("raw").alias("c")).collect():
        assert 0.0 <= r.c <= 1.0


def test_emit_anomalies(spark):
    df = spark.createDataFrame(FEATURES * 2, SCHEMA).withColumn(
        "message_id", F.monotonically_increasing_id().cast("string"))
    results = scoring.anomaly_results(scoring.flag_anomalies(scoring.score(df, const_scorer(0.9))))
    messages, events = scoring.emit_anomalies(results, as_of="2024-01-31 00:00:00")
    m = messages.collect()
    assert len(m) == 2 and m[0].attributes["anomaly_score"] == "0.9"
    e = events.collect()
    assert all(not x.resolved and x.route_id is None and len(x.event_id) == 36 for x in e)


def test_checkpoint_gap(spark):
    import datetime as dt
    rows = [(1, "s1", dt.datetime(2024, 1, 1, 0)), (2, "s1", dt.datetime(2024, 1, 1, 6, 30)),
            (3, "s2", dt.datetime(2024, 1, 1, 1))]
    df = spark.createDataFrame(rows, "id long, shipment_id string, event_time timestamp_ntz")
    got = {r.id: r.hours_since_last_checkpoint for r in scoring.checkpoint_gap(df).collect()}
    assert got == {1: None, 2: 6.5, 3: None}


PAYLOAD = {"device_id": "unit-7", "shipment_id": "box-42", "temperature": -3.5,
           "humidity": 12.0, "lat": -12.25, "lon": 130.75, "speed_kmh": 51.0, "battery_pct": 64.0,
           "hours_since_last_checkpoint": 6.5}


@pytest.mark.parametrize("mock,flag", [(0.875, True), (0.125, False), (0.75, True)])
def test_direct_scoring(spark, mock, flag):
    out = scoring.score_direct(spark, PAYLOAD, const_scorer(mock))
    assert out == {"device_id": "unit-7", "shipment_id": "box-42", "anomaly_score": mock,
                   "is_anomaly": flag, "threshold": 0.75}


def test_direct_scoring_refuses_incomplete_features(spark):
    with pytest.raises(scoring.IncompleteFeatures):
        scoring.score_direct(spark, {"device_id": "unit-7"}, const_scorer(0.9))


def test_direct_scoring_surfaces_failed_prediction(spark):
    with pytest.raises(scoring.ScoringFailed):
        scoring.score_direct(spark, PAYLOAD, const_scorer(None))
