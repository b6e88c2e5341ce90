"""Registered queries: one Spark plan per operator of the inventory.

Each builder takes ``(spark, sf_dir)``, derives the operator inputs from the
driver tables (``sources.fixtures``) and returns the operator's DataFrame.
The matching DuckDB SQL lives in ``plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.operators import dashboard as dash
from cargoscope.operators import evaluation, rates, routing, scoring, tables, training, validate
from cargoscope.session import shared_path
from cargoscope.sources.fixtures import AS_OF, Fixtures
from cargoscope.sources.messages import pull, quarantine_frame
from cargoscope.streaming import ingest as ingest_stream
from cargoscope.streaming import scoring as scoring_stream
from cargoscope.streaming.commits import CommitLog
from cargoscope.streaming.delivery import RetryPolicy, retry_pass
from cargoscope.streaming.maintained import MaintainedSummary
from cargoscope.streaming.refresh import load_landed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def _summary(fx: Fixtures, status=None, limit=dash.DEFAULT_LIMIT) -> DataFrame:
    return dash.shipments_summary(fx.shipments(), fx.telemetry(), fx.anomaly_events(),
                                  status=status, limit=limit)


# ---------------------------------------------------------------- dashboard
@register("shipments_summary")
def q_shipments_summary(spark, sf_dir):
    """C1+C2+C5+F1: summary page of 100 (updated_at desc, shipment_id)."""
    return _summary(_fx(spark, sf_dir))


@register("shipments_summary_delayed")
def q_shipments_summary_delayed(spark, sf_dir):
    """Summary filtered to status delayed, limit clamped at 500."""
    return _summary(_fx(spark, sf_dir), status="delayed", limit=500)


@register("latest_telemetry")
def q_latest_telemetry(spark, sf_dir):
    """Newest telemetry row of every shipment (whole table)."""
    return dash.latest_telemetry(_fx(spark, sf_dir).telemetry())


@register("open_anomaly_counts")
def q_open_anomaly_counts(spark, sf_dir):
    """Unresolved anomaly events per shipment (whole table)."""
    return dash.open_anomaly_counts(_fx(spark, sf_dir).anomaly_events())


@register("fleet_metrics")
def q_fleet_metrics(spark, sf_dir):
    """Fleet counters over the dashboard's page of 200."""
    return dash.fleet_metrics(_summary(_fx(spark, sf_dir), limit=200))


@register("feed_counts")
def q_feed_counts(spark, sf_dir):
    """Feed tab counts over the page of 200."""
    return dash.feed_counts(_summary(_fx(spark, sf_dir), limit=200))


def _feed(spark, sf_dir, mode):
    return dash.anomaly_feed(_summary(_fx(spark, sf_dir), limit=200), mode=mode, as_of=AS_OF)


@register("anomaly_feed_all")
def q_anomaly_feed_all(spark, sf_dir):
    """Feed mode all (not delivered), top 50 by status priority."""
    return _feed(spark, sf_dir, "all")


@register("anomaly_feed_anomaly")
def q_anomaly_feed_anomaly(spark, sf_dir):
    """Feed mode anomaly (status anomaly or open anomalies)."""
    return _feed(spark, sf_dir, "anomaly")


@register("anomaly_feed_delayed")
def q_anomaly_feed_delayed(spark, sf_dir):
    """Feed mode delayed."""
    return _feed(spark, sf_dir, "delayed")


@register("anomaly_feed_display")
def q_anomaly_feed_display(spark, sf_dir):
    """§2.7 toFixed: temperature to one digit and speed to none, as the feed shows them."""
    return dash.feed_display(_feed(spark, sf_dir, "all")).select(
        "shipment_id", "temperature_shown", "speed_shown")


@register("map_points")
def q_map_points(spark, sf_dir):
    """Plottable page rows with status color and alert flag."""
    return dash.map_points(_summary(_fx(spark, sf_dir), limit=200))


@register("recent_telemetry")
def q_recent_telemetry(spark, sf_dir):
    """Five newest telemetry rows per device (whole table)."""
    return dash.recent_telemetry(_fx(spark, sf_dir).telemetry(), key="device_id", n=5)


@register("top_open_anomalies")
def q_top_open_anomalies(spark, sf_dir):
    """Twenty highest-scoring unresolved anomaly events."""
    return dash.top_open_anomalies(_fx(spark, sf_dir).anomaly_events(), n=20)


# ---------------------------------------------------------------- what-if routing


def _flat_options(df: DataFrame) -> DataFrame:
    """Array column as comma-joined text, so SQL engines can compare it."""
    return df.withColumn("waypoints_text", F.array_join("waypoints", ",")).drop("waypoints")


def _whatif(spark, sf_dir, grain):
    fx = _fx(spark, sf_dir)
    return routing.score_routes(fx.scenarios(), fx.routes(), fx.carriers(), fx.anomaly_events(),
                                grain=grain)


@register("whatif_routes")
def q_whatif_routes(spark, sf_dir):
    """A scenario per order, route x event grain."""
    return _flat_options(_whatif(spark, sf_dir, "event"))


@register("whatif_routes_pruned")
def q_whatif_routes_pruned(spark, sf_dir):
    """The cheapest ten candidate routes of every scenario, before events."""
    fx = _fx(spark, sf_dir)
    out = routing.cheapest_routes(fx.scenarios(), fx.routes(), fx.carriers())
    return out.select("scenario_id", "route_id", "estimated_cost_usd")


@register("whatif_routes_by_route")
def q_whatif_routes_by_route(spark, sf_dir):
    """The what-if with grain='route' (newest row per route before the top-10)."""
    return _flat_options(_whatif(spark, sf_dir, "route"))


@register("whatif_route_display")
def q_whatif_route_display(spark, sf_dir):
    """B23/B24, §2.7 toFixed: risk band, percent, cost in whole dollars and
    route label of the what-if options."""
    out = routing.route_options_display(_whatif(spark, sf_dir, "event"))
    return _flat_options(out).select("scenario_id", "route_id", "event_id", "risk_band", "risk_pct",
                                     "cost_shown", "route_label")


@register("route_risk_latest")
def q_route_risk_latest(spark, sf_dir):
    """Newest event's 31-row rolling risk per route."""
    return routing.rolling_risk(_fx(spark, sf_dir).anomaly_events(), newest=1).drop("recency")


@register("scenario_validation")
def q_scenario_validation(spark, sf_dir):
    """Request-model bounds of every scenario."""
    out = routing.validate_scenarios(_fx(spark, sf_dir).scenarios())
    return out.select("scenario_id", "reject_reason")


# ---------------------------------------------------------------- ingest validation


@register("telemetry_validation")
def q_telemetry_validation(spark, sf_dir):
    """Ordered rules, reason, status code and error text per row."""
    checked = validate.validate_telemetry(_fx(spark, sf_dir).telemetry(), as_of=AS_OF)
    out = validate.ingest_result(checked, body_col=None)
    return out.select("id", "reject_reason", "status_code", "error")


def _rejection_counts(spark, sf_dir, check_stale):
    checked = validate.validate_telemetry(_fx(spark, sf_dir).telemetry(), as_of=AS_OF,
                                          check_stale=check_stale)
    return checked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@register("rejection_counts")
def q_rejection_counts(spark, sf_dir):
    """Rows per rejection reason (stale rule on)."""
    return _rejection_counts(spark, sf_dir, True)


@register("rejection_counts_no_stale")
def q_rejection_counts_no_stale(spark, sf_dir):
    """Rows per rejection reason without the stale rule."""
    return _rejection_counts(spark, sf_dir, False)


@register("ingest_messages")
def q_ingest_messages(spark, sf_dir):
    """Strict decode + rules over table-derived message bodies."""
    msgs = _fx(spark, sf_dir).messages()
    decoded = validate.decode_telemetry(msgs)
    checked = validate.validate_telemetry(decoded, as_of=AS_OF, time_col="timestamp",
                                          check_stale=False)
    # Accepted times as epoch microseconds: no time zone enters the comparison.
    accepted_time = F.when(F.col("reject_reason").isNull(), F.unix_micros("timestamp")).alias("ts_micros")
    return validate.ingest_result(checked).select("message_id", "reject_reason", "status_code",
                                                  "device_id", "lat", "lon", accepted_time)


@register("bounded_pull")
def q_bounded_pull(spark, sf_dir):
    """One pull of at most 200 messages, in id order."""
    return pull(_fx(spark, sf_dir).messages().orderBy("message_id"), 200).select("message_id", "value")


@register("quarantine_rows")
def q_quarantine_rows(spark, sf_dir):
    """Every refused message with its reason and body snippet."""
    decoded = validate.decode_telemetry(_fx(spark, sf_dir).messages())
    checked = validate.validate_telemetry(decoded, as_of=AS_OF, time_col="timestamp")
    return quarantine_frame(validate.split_valid(checked)[1]).select(
        "message_id", "reject_reason", "body_snippet", "attempts")


@register("scoring_decode")
def q_scoring_decode(spark, sf_dir):
    """The scoring service's loose decode over the same bodies."""
    decoded = validate.decode_features(_fx(spark, sf_dir).messages())
    return decoded.select("message_id", "decode_reason", "device_id", "lat", "lon", "temperature",
                          "battery_pct")


# ---------------------------------------------------------------- tables


@register("shipments_upsert")
def q_shipments_upsert(spark, sf_dir):
    """Insert-or-partial-update with repeated keys."""
    fx = _fx(spark, sf_dir)
    return tables.upsert_shipments(fx.shipments(), fx.shipment_updates(), as_of=AS_OF)


@register("shipments_upsert_buckets")
def q_shipments_upsert_buckets(spark, sf_dir):
    """The same upsert into a bucketed table, in two merges (the load,
    then the updates); only the updates' buckets are rewritten."""
    fx = _fx(spark, sf_dir)
    table = tables.shipments_table(spark, shared_path(spark, "cargoscope-buckets", uuid.uuid4().hex))
    table.merge(fx.shipments(), lambda _, rows: rows.select(*tables.SHIPMENT_COLUMNS))
    tables.upsert_buckets(table, fx.shipment_updates(), as_of=AS_OF)
    return table.read()


@register("orphan_telemetry")
def q_orphan_telemetry(spark, sf_dir):
    """Telemetry rows whose shipment does not exist."""
    fx = _fx(spark, sf_dir)
    return tables.orphan_telemetry(fx.telemetry(), fx.shipments())


@register("table_checks")
def q_table_checks(spark, sf_dir):
    """NOT NULL, primary-key and status-domain violations of the five
    tables; shipments (without updated_at) and events come with broken rows."""
    fx = _fx(spark, sf_dir)
    out = tables.check_table(fx.dirty_shipments(), "shipments")
    for name, df in [("telemetry", fx.telemetry()), ("anomaly_events", fx.dirty_events()),
                     ("routes", fx.routes()), ("carriers", fx.carriers())]:
        out = out.unionByName(tables.check_table(df, name))
    return out


@register("telemetry_retention")
def q_telemetry_retention(spark, sf_dir):
    """Telemetry within the 7-day retention at as_of."""
    return tables.apply_retention(_fx(spark, sf_dir).telemetry(), as_of=AS_OF, days=7)


@register("retention_drop")
def q_retention_drop(spark, sf_dir):
    """Telemetry landed by day in two committed batches; the days past
    the 7-day retention are dropped as files, the rest filtered."""
    log = CommitLog(spark, shared_path(spark, "cargoscope-retention", uuid.uuid4().hex))
    telemetry = _fx(spark, sf_dir).telemetry()
    rows = tables.with_time_partitions(telemetry).drop("event_month")
    odd = F.crc32(F.col("id").cast("string")) % 2 == 1
    for batch_id, part in enumerate((rows.filter(odd), rows.filter(~F.coalesce(odd, F.lit(False))))):
        with log.batch("retention", batch_id) as batch:
            batch.write("telemetry", part, by=["event_date"])
    ingest_stream.drop_expired(log, "telemetry", AS_OF, days=7, by="event_date")
    return tables.apply_retention(log.read("telemetry"), as_of=AS_OF, days=7).select(*telemetry.columns)


@register("anomaly_retention")
def q_anomaly_retention(spark, sf_dir):
    """Anomaly events within the 1-day subscription retention."""
    return tables.apply_retention(_fx(spark, sf_dir).anomaly_events(), as_of=AS_OF, days=1)


# A "now" for which early telemetry lies before the existing partitions.
LATER = "2024-02-10 00:00:00"


@register("partition_range_violations")
def q_partition_range_violations(spark, sf_dir):
    """Rows outside the current and next three monthly partitions, with
    the partition (yyyy_MM) they would need."""
    out = tables.partition_range_violations(_fx(spark, sf_dir).telemetry(), as_of=LATER)
    return tables.with_time_partitions(out).select("id", "event_time", "event_month")


# ---------------------------------------------------------------- scoring

# A fixed column scorer (M4) with power-of-two weights, so every engine gets
# the same doubles: 0.5 + t/128 + h/256 + speed/512 - battery/256.
TEST_SCORER_WEIGHTS = [1 / 128, 1 / 256, 0.0, 0.0, 1 / 512, -1 / 256, 0.0]
TEST_SCORER_BIAS = 0.5


def _scored(spark, sf_dir):
    tel = _fx(spark, sf_dir).telemetry()
    scorer = scoring.linear_scorer(TEST_SCORER_WEIGHTS, TEST_SCORER_BIAS)
    return scoring.flag_anomalies(scoring.score(tel, scorer))


@register("feature_vectors")
def q_feature_vectors(spark, sf_dir):
    """The seven-feature vector with the `x or default` rules."""
    tel = _fx(spark, sf_dir).telemetry()
    f = scoring.feature_vector(tel)
    return f.select("id", *[F.col("features")[i].alias(f"f_{n}") for i, n in
                            enumerate(scoring.FEATURE_COLS)])


@register("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    """Column-scorer scores, clamp (S3) and the >= 0.75 flag."""
    return _scored(spark, sf_dir).select("id", "device_id", "shipment_id", "anomaly_score",
                                         "is_anomaly", "threshold")


@register("anomaly_emissions")
def q_anomaly_emissions(spark, sf_dir):
    """A3: anomaly messages with the score attribute as text."""
    results = scoring.anomaly_results(
        _scored(spark, sf_dir).withColumn("message_id", F.format_string("m%d", "id")))
    messages, _ = scoring.emit_anomalies(results, as_of=AS_OF)
    return messages.select("message_id", F.col("attributes")["device_id"].alias("device_id"),
                           F.col("attributes")["anomaly_score"].alias("score_text"))


@register("checkpoint_gaps")
def q_checkpoint_gaps(spark, sf_dir):
    """Hours since the previous telemetry row of the same shipment."""
    tel = _fx(spark, sf_dir).telemetry()
    return scoring.checkpoint_gap(tel).select("id", "shipment_id", "hours_since_last_checkpoint")


@register("rate_violations")
def q_rate_violations(spark, sf_dir):
    """Users over 3 events per one-day window (sparse fixture parameters)."""
    # The fixture data is sparse: one-day windows and threshold 3 (FIXTURES.md).
    ev = _fx(spark, sf_dir).table("events")
    return rates.rate_violations(ev, "user_id", threshold=3, seconds=86400, time_col="ts")


@register("rate_violations_maintained")
def q_rate_violations_maintained(spark, sf_dir):
    """The same counts kept in a table from batches in mixed order of time,
    one of them applied twice; late rows correct their windows."""
    events = _fx(spark, sf_dir).table("events")
    table = rates.counts_table(spark, shared_path(spark, "cargoscope-rates", uuid.uuid4().hex))
    for batch, part in enumerate((2, 0, 1, 1)):
        rows = events.filter(F.pmod("event_id", F.lit(3)) == part)
        table.merge(rates.rate_counts(rows, "user_id", 86400, "ts"), rates.add_counts,
                    {"events": min(batch, 2)})
    return rates.over_limit(table.read(), threshold=3, seconds=86400)


# ---------------------------------------------------------------- training & evaluation
TRAIN_KEEP = ["event_id", "device_id", "event_time", "score"]
SPLIT_ORDER = ["event_time", "device_id", "event_id"]


def _training_set(spark, sf_dir):
    raw = _fx(spark, sf_dir).training()
    loaded = training.load_training(raw, as_of=AS_OF, time_col="event_time")
    return training.select_features(loaded, keep=TRAIN_KEEP)


def _split(spark, sf_dir):
    return training.temporal_split(training.impute(_training_set(spark, sf_dir)), SPLIT_ORDER)


def _test_part(spark, sf_dir):
    return _split(spark, sf_dir).filter(F.col("split") == "test")


@register("training_set")
def q_training_set(spark, sf_dir):
    """Labelled rows of the last 90 days, seven features."""
    return _training_set(spark, sf_dir)


@register("imputed_training")
def q_imputed_training(spark, sf_dir):
    """Mean imputation fitted on all rows."""
    return training.impute(_training_set(spark, sf_dir))


@register("temporal_split")
def q_temporal_split(spark, sf_dir):
    """exact 80/20 split in (time, device, id) order (S23), with the row
    positions of the opt-in global numbering beside it."""
    numbered = training.with_row_positions(_split(spark, sf_dir), SPLIT_ORDER)
    return numbered.select("event_id", "row_pos", "split")


@register("temporal_split_narrow")
def q_temporal_split_narrow(spark, sf_dir):
    """the split alone, a narrow map."""
    return _split(spark, sf_dir).select("event_id", "split")


@register("split_stats")
def q_split_stats(spark, sf_dir):
    """Rows and anomaly rate per split."""
    return training.split_stats(_split(spark, sf_dir))


@register("classification_report")
def q_classification_report(spark, sf_dir):
    """Report on the test part at score >= 0.75."""
    pred = evaluation.with_prediction(_test_part(spark, sf_dir), "score")
    return evaluation.classification_report(pred, "anomaly_label")


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    """Tie-correct ROC AUC on the test part."""
    return evaluation.roc_auc(_test_part(spark, sf_dir), "anomaly_label", "score")


@register("average_precision")
def q_average_precision(spark, sf_dir):
    """Average precision on the test part."""
    out = evaluation.average_precision(_test_part(spark, sf_dir), "anomaly_label", "score")
    return out.withColumn("average_precision", F.round("average_precision", 12))


@register("evaluation")
def q_evaluation(spark, sf_dir):
    """M5: AUC, average precision and accuracy in one row."""
    out = evaluation.evaluate(_test_part(spark, sf_dir), "anomaly_label", "score")
    return out.withColumn("average_precision", F.round("average_precision", 12))


@register("gbt_train_evaluate")
def q_gbt_train_evaluate(spark, sf_dir):
    """Fit the classifier with the declared rounds and a
    patience of 20 rounds, keep the rounds up to the best, save and load it,
    score the test part with the loaded pipeline. Checked by what SQL can know:
    rows, score range, loaded scores equal to the fitted model's, metrics within
    their range, rounds kept within the limit, and the loaded model's held-out
    loss the least of all rounds before the stop. The fixtures' labels are noise
    to the features; ``gbt_learns_rule`` has labels that can be learned."""
    split = _split(spark, sf_dir)
    model, best, losses = training.train_best(split)
    path = shared_path(spark, "cargoscope-models", uuid.uuid4().hex)
    training.save_model(model, path)
    test = split.filter(F.col("split") == "test")
    scored = scoring.score(test, training.load_model(path), out="model_score")
    fitted = scoring.score(test, model, out="fitted_score").select("event_id", "fitted_score")
    rows = scored.join(fitted, "event_id").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.bool_and(F.col("model_score").between(0, 1)).alias("in_range"),
        F.bool_and(F.col("model_score") == F.col("fitted_score")).alias("same_after_load"))
    metrics = evaluation.evaluate(scored, "anomaly_label", "model_score").select(
        (F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1)
         & F.col("accuracy").between(0, 1)).alias("metrics_in_range"))
    loaded = training.load_model(path)
    kept = training.rounds_used(loaded) == best and 1 <= best <= training.GBT_PARAMS["maxIter"]
    least = min(losses[:best + training.PATIENCE], default=0.0)
    held_out = training.test_losses(loaded, split).select(
        (F.abs(F.col("loss") - least) < 1e-9).alias("best_round_kept"))
    return rows.crossJoin(metrics).crossJoin(held_out).withColumn("rounds_within_limit", F.lit(kept))


@register("gbt_learns_rule")
def q_gbt_learns_rule(spark, sf_dir):
    """The same training on labels that follow from two features, so
    that a model no better than the base rate fails: held-out loss less than half
    a constant's, average precision above twice the share of positives, AUC above
    0.9."""
    x, y = (F.col(c) for c in training.FEATURE_COLS[:2])
    split = _split(spark, sf_dir)
    means = split.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    split = split.withColumn("anomaly_label", ((x > means["x"] + 0.001) & (y > means["y"] + 0.001)).cast("int"))
    model, _, _ = training.train_best(split, patience=3, max_iter=12, stepSize=0.3)
    test = split.filter(F.col("split") == "test")
    scored = model.transform(training.training_frame(test)).withColumn(
        "model_score", vector_to_array("probability")[1])
    base = test.agg(F.avg("anomaly_label").alias("base"), F.count(F.lit(1)).alias("n_test"),
                    F.sum("anomaly_label").cast("long").alias("n_positive"))
    return (base.crossJoin(evaluation.evaluate(scored, "anomaly_label", "model_score"))
            .crossJoin(training.test_losses(model, split))  # one row each
            .select("n_test", "n_positive",
                    (F.col("loss") < F.col("constant_loss") / 2).alias("beats_constant"),
                    (F.col("average_precision") > 2 * F.col("base")).alias("beats_base_rate"),
                    (F.col("roc_auc") > 0.9).alias("ranks_well")))


# ---------------------------------------------------------------- streams


def _stream_source(spark, sf_dir) -> str:
    """Table-derived messages written as JSON-lines files in a fresh folder
    under the shared checkpoint location: every message once, every tenth once
    more in a later file. On a local disk the files' ages spread over days in
    mixed order, as after a copy or a replay."""
    base = shared_path(spark, "cargoscope-streams", uuid.uuid4().hex)
    messages = _fx(spark, sf_dir).messages()
    messages.drop("id").repartition(4).write.json(f"{base}/src")
    messages.filter(F.pmod(F.hash("id"), 10) == 0).drop("id").repartition(2).write.mode(
        "append").json(f"{base}/src")
    folder = f"{base}/src".removeprefix("file:")
    if os.path.isdir(folder):
        for i, name in enumerate(sorted(n for n in os.listdir(folder) if n.endswith(".json"))):
            age = ((i * 5) % 7) * 86400
            stat = os.stat(f"{folder}/{name}")
            os.utime(f"{folder}/{name}", (stat.st_atime, stat.st_mtime - age))
    return base


def _ingested(spark, sf_dir) -> str:
    base = _stream_source(spark, sf_dir)
    ingest_stream.run_ingest(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", as_of=AS_OF,
                             max_files_per_trigger=2).awaitTermination()
    return base


@register("maintained_summary")
def q_maintained_summary(spark, sf_dir):
    """The page of 200 kept up to date over three batches of telemetry,
    events and changed shipments; anomalies resolved later are taken off."""
    fx = _fx(spark, sf_dir)
    kept = MaintainedSummary(spark, shared_path(spark, "cargoscope-page", uuid.uuid4().hex))
    events, telemetry, shipments = fx.anomaly_events(), fx.telemetry(), fx.shipments()
    for part in range(3):
        mine = F.pmod(F.xxhash64("shipment_id"), F.lit(3)) == part
        arrived = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        rows = telemetry.filter(F.pmod("id", F.lit(3)) == part)
        for _ in range(2):  # the second try of a batch changes nothing
            kept.apply(rows, arrived.withColumn("resolved", F.lit(False)), shipments.filter(mine),
                       arrived.filter("resolved"), progress={"batch": part})
    return kept.page()


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """The ingest stream (availableNow, several
    micro-batches) over message files of many ages with redelivered ids; one
    row per message: published (reason null, with the published payload's
    fields and attributes) or quarantined."""
    base = _ingested(spark, sf_dir)
    body = F.from_json("value", "device_id string, shipment_id string, lat double, "
                                "temperature double, timestamp string")
    published = ingest_stream.read_landed(spark, f"{base}/out", "published").select(
        "message_id", F.lit(None).cast("string").alias("reject_reason"),
        body["device_id"].alias("device_id"), body["lat"].alias("lat"),
        body["temperature"].alias("temperature"),
        F.unix_micros(F.to_timestamp(body["timestamp"])).alias("ts_micros"),
        F.col("attributes")["shipment_id"].alias("shipment_attribute"),
        F.col("attributes")["content_type"].alias("content_type"))
    quarantined = ingest_stream.read_landed(spark, f"{base}/out", "quarantine").select(
        "message_id", "reject_reason")
    return published.unionByName(quarantined, allowMissingColumns=True)


@register("landed_summary")
def q_landed_summary(spark, sf_dir):
    """Messages through both streams into the typed
    tables, and the summary over what they landed."""
    base = _ingested(spark, sf_dir)
    scorer = scoring.linear_scorer(TEST_SCORER_WEIGHTS, TEST_SCORER_BIAS)
    scoring_stream.run_scoring(spark, f"{base}/out/published", f"{base}/scored", f"{base}/ckpt2",
                               scorer, as_of=AS_OF).awaitTermination()
    tables_ = load_landed(spark, _fx(spark, sf_dir).shipments(), f"{base}/out", f"{base}/scored")
    page = dash.shipments_summary(*tables_, limit=500)
    return page.withColumn("last_telemetry_micros", F.unix_micros("last_telemetry_at")).drop(
        "last_telemetry_at")


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """The scoring stream (availableNow) with the fixed column scorer;
    returns the per-message results."""
    base = _stream_source(spark, sf_dir)
    scorer = scoring.linear_scorer(TEST_SCORER_WEIGHTS, TEST_SCORER_BIAS)
    scoring_stream.run_scoring(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", scorer,
                               as_of=AS_OF).awaitTermination()
    return spark.read.parquet(f"{base}/out/results").select(
        "message_id", "device_id", "shipment_id", "anomaly_score", "is_anomaly", "threshold")


REPLAYED_LATER = "2024-03-15 00:00:00"  # past a month end, when every message is stale


@register("stream_replay")
def q_stream_replay(spark, sf_dir):
    """One ingest and one scoring batch, each tried three times: an attempt
    that dies before its commit, one that commits, and a replay at a later date.
    One row per message: how often it landed, was quarantined and raised an
    event, and that event's time."""
    base = shared_path(spark, "cargoscope-replay", uuid.uuid4().hex)
    messages = _fx(spark, sf_dir).messages().drop("id")
    scorer = scoring.linear_scorer(TEST_SCORER_WEIGHTS, TEST_SCORER_BIAS)

    def attempts(process, out):
        def dies(batch, _):
            raise KeyboardInterrupt("the driver is gone")

        try:
            process(out, REPLAYED_LATER, sink=dies)
        except KeyboardInterrupt:
            pass
        process(out, AS_OF)
        process(out, REPLAYED_LATER)

    attempts(lambda out, as_of, **more: ingest_stream.process_ingest_batch(
        messages, 0, out, as_of=as_of, **more), f"{base}/out")
    published = ingest_stream.read_landed(spark, f"{base}/out", "published").drop("batch")
    attempts(lambda out, as_of, **more: scoring_stream.process_scoring_batch(
        published, 0, out, scorer, as_of=as_of, **more), f"{base}/scored")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    landed = ingest_stream.read_landed(spark, f"{base}/out", "telemetry").select(
        "message_id", one.alias("landed"), none.alias("quarantined"), none.alias("events"),
        F.lit(None).cast("long").alias("event_micros"))
    quarantined = ingest_stream.read_landed(spark, f"{base}/out", "quarantine").select(
        "message_id", none, one, none, F.lit(None).cast("long")).toDF(*landed.columns)
    raised = ingest_stream.read_landed(spark, f"{base}/scored", "anomaly_events").select(
        F.get_json_object("details", "$.message_id"), none, none, one,
        F.unix_micros(F.col("event_time").cast("timestamp"))).toDF(*landed.columns)
    return landed.unionByName(quarantined).unionByName(raised).groupBy("message_id").agg(
        F.sum("landed").alias("n_landed"), F.sum("quarantined").alias("n_quarantined"),
        F.sum("events").alias("n_events"), F.max("event_micros").alias("event_micros"))


BAD_MESSAGES = "680"  # the stand-in broker refuses frames with an id that ends so


@register("delivery_retries")
def q_delivery_retries(spark, sf_dir):
    """A batch whose publish fails, then passes over the retry queue: the
    broker is away for the first, later it refuses some messages. Response
    status of every message."""
    policy = RetryPolicy(groups=4, deliveries=2)
    out = shared_path(spark, "cargoscope-delivery", uuid.uuid4().hex)
    start = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
    away = {"now": True}

    def broker(frame, _name):
        if away["now"] or not frame.filter(F.endswith("message_id", F.lit(BAD_MESSAGES))).isEmpty():
            raise OSError("refused")

    ingest_stream.process_ingest_batch(_fx(spark, sf_dir).messages().drop("id"), 0, out, as_of=AS_OF,
                                       sink=broker, retry=policy, now=start)
    for seconds in (600, 1300):
        away["now"] = seconds == 600
        retry_pass(spark, out, broker, policy, now=start + dt.timedelta(seconds=seconds))
    return ingest_stream.read_landed(spark, out, "results").select("message_id", "status_code")


@register("route_risk_all")
def q_route_risk_all(spark, sf_dir):
    """E1 over every anomaly event (no newest-n cut)."""
    return routing.rolling_risk(_fx(spark, sf_dir).anomaly_events())
