"""Distributed ranking against brute force; table operators' properties."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargoscope.operators import evaluation, tables
from cargoscope.plans.ranking import with_global_position, with_running_sums
from cargoscope.session import plan_text


def test_global_position_matches_sort(spark):
    rng = random.Random(3)
    # A hot key: a third of the rows share one timestamp; device breaks the tie.
    rows = [(i, dt.datetime(2024, 1, 1) if i % 3 == 0 else dt.datetime(2024, 1, 1) +
             dt.timedelta(seconds=rng.randint(0, 10 ** 6)), f"d{rng.randint(0, 10 ** 6):07d}")
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, dev string")
    got = {r.id: (r.row_pos, r.row_count) for r in
           with_global_position(df, [F.col("ts"), F.col("dev"), F.col("id")], num_partitions=7).collect()}
    expected = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert {r[0]: (i, 3000) for i, r in enumerate(expected)} == got


def test_running_sums_match_cumsum(spark):
    rows = [(float(i % 17) / 4, i % 3, i % 5) for i in range(500)]
    hist = spark.createDataFrame(rows, "score double, a long, b long").groupBy("score") \
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    got = {r.score: (r.cum_a, r.total_a) for r in
           with_running_sums(hist, [F.col("score")], ["a", "b"], num_partitions=4).collect()}
    acc, expected = 0, {}
    by_score = {}
    for s, a, _ in rows:
        by_score[s] = by_score.get(s, 0) + a
    total = sum(by_score.values())
    for s in sorted(by_score):
        acc += by_score[s]
        expected[s] = (acc, total)
    assert got == expected


def brute_auc(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(labels, scores):
    order = sorted(set(scores), reverse=True)
    P = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=60))
def test_auc_and_ap_against_brute_force(spark, data):
    labels = [y for y, _ in data]
    scores = [s / 8 for _, s in data]
    df = spark.createDataFrame(list(zip(labels, scores)), "y int, score double")
    auc = evaluation.roc_auc(df, "y", num_partitions=3).first().roc_auc
    ap = evaluation.average_precision(df, "y", num_partitions=3).first().average_precision
    if 0 < sum(labels) < len(labels):
        assert abs(auc - brute_auc(labels, scores)) < 1e-12
    else:
        assert auc is None
    if sum(labels) > 0:
        assert abs(ap - brute_ap(labels, scores)) < 1e-9


SHIP_SCHEMA = ("shipment_id string, origin_hub string, destination_hub string, carrier_id string, "
               "status string, created_at timestamp_ntz, updated_at timestamp_ntz, metadata string")
UPD_SCHEMA = ("shipment_id string, origin_hub string, destination_hub string, carrier_id string, "
              "status string, metadata string, seq int")
T0 = dt.datetime(2024, 1, 1)


def test_upsert_partial_update_and_insert(spark):
    cur = spark.createDataFrame([("S1", "A", "B", "C1", "in_transit", T0, T0, None)], SHIP_SCHEMA)
    upd = spark.createDataFrame([
        ("S1", "X", "Y", "C9", "delayed", '{"a":1}', 1),
        ("S2", "P", "Q", "C2", None, None, 1),
        ("S2", "Z", "Z", "C3", "delivered", '{"b":2}', 2)], UPD_SCHEMA)
    out = {r.shipment_id: r for r in tables.upsert_shipments(cur, upd, as_of="2024-01-31").collect()}
    s1, s2 = out["S1"], out["S2"]
    assert (s1.origin_hub, s1.carrier_id, s1.status, s1.metadata) == ("A", "C1", "delayed", '{"a":1}')
    assert s1.created_at == T0 and s1.updated_at == dt.datetime(2024, 1, 31)
    assert (s2.origin_hub, s2.status, s2.metadata) == ("P", "delivered", '{"b":2}')
    assert s2.created_at == dt.datetime(2024, 1, 31)


def test_upsert_defaults_status_and_metadata(spark):
    cur = spark.createDataFrame([], SHIP_SCHEMA)
    upd = spark.createDataFrame([("S3", "P", "Q", "C2", None, None, 1)], UPD_SCHEMA)
    [r] = tables.upsert_shipments(cur, upd, as_of="2024-01-31").collect()
    assert (r.status, r.metadata) == ("in_transit", "{}")


def test_upsert_is_idempotent(spark):
    from cargoscope.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    once = tables.upsert_shipments(fx.shipments(), fx.shipment_updates(), as_of="2024-01-31")
    twice = tables.upsert_shipments(once, fx.shipment_updates(), as_of="2024-01-31")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_with_defaults(spark):
    df = spark.createDataFrame([("R1", None, None)], "route_id string, cost_per_kg_usd double, active boolean")
    r = tables.with_defaults(df, "routes").first()
    assert (r.cost_per_kg_usd, r.active) == (0.01, True)
    ev = spark.createDataFrame([("d", "s", 0.9)], "device_id string, shipment_id string, anomaly_score double")
    r = tables.with_defaults(ev, "anomaly_events", as_of="2024-01-31").first()
    assert r.resolved is False and len(r.event_id) == 36


def test_check_table_finds_violations(spark):
    df = spark.createDataFrame([("S1", "A", "B", "C", "lost", T0, T0, None),
                                ("S1", None, "B", "C", "delayed", T0, T0, None)], SHIP_SCHEMA)
    got = {(r.check_name, r.column_name): r.violations for r in tables.check_table(df, "shipments").collect()}
    assert got[("not_null", "origin_hub")] == 1
    assert got[("domain", "status")] == 1
    assert got[("primary_key", "shipment_id")] == 1


def test_write_telemetry_partitions(spark, scratch):
    from cargoscope.sources.fixtures import Fixtures
    tel = Fixtures(spark, "/root/testdata/sf0.001").telemetry()
    tables.write_telemetry(tel, f"{scratch}/tel", grain="day")
    back = spark.read.parquet(f"{scratch}/tel")
    assert back.count() == tel.count()
    one_day = back.filter(F.col("event_date") == "2024-01-05")
    plan = plan_text(one_day)
    assert "PartitionFilters" in plan and one_day.count() > 0


def test_load_tables_and_training_scan(spark, scratch):
    from cargoscope.sources import tables as src
    from cargoscope.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    src.write_table(fx.shipments(), scratch, "shipments")
    src.write_table(fx.carriers(), scratch, "carriers")
    ships = src.read_table(spark, f"{scratch}/shipments", "shipments")
    assert [f.name for f in ships.schema.fields] == [f.name for f in src.schemas.SHIPMENTS.fields]
    assert ships.count() == fx.shipments().count()
    # Day-partitioned warehouse table: the scan prunes days outside the window.
    raw = fx.training().withColumnRenamed("event_time", "timestamp")
    raw.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date") \
        .parquet(f"{scratch}/raw")
    got = src.read_training(spark, f"{scratch}/raw", as_of="2024-01-31 00:00:00", days=10)
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert got.count() == raw.filter("anomaly_label IS NOT NULL AND timestamp >= '2024-01-21'").count()


def test_previous_row_with_hot_key_matches_lag(spark):
    from pyspark.sql import Window
    from cargoscope.plans.ranking import with_previous
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 50)}",
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 500))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    got = {r.id: (r.prev.id if r.prev else None) for r in
           with_previous(df, "key", ["ts", "id"], num_partitions=9).collect()}
    w = Window.partitionBy("key").orderBy("ts", "id")
    expected = {r.id: r.p for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}
    assert got == expected


@pytest.mark.parametrize("partitions,n_rows", [(3, 1500), (13, 1500), (64, 400), (150, 300)])
def test_rolling_mean_with_hot_key_matches_window(spark, partitions, n_rows):
    """Tiny and empty range partitions make halos span many partitions."""
    from pyspark.sql import Window
    from cargoscope.plans.ranking import with_rolling_mean
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 30)}",
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 300)), rng.randint(0, 64) / 64)
            for i in range(n_rows)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, v double")
    got = {r.id: r.m for r in with_rolling_mean(df, "key", ["ts", "id"], "v", "m", 30,
                                                num_partitions=partitions).collect()}
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(-30, 0)
    expected = {r.id: r.m for r in df.select("id", F.avg("v").over(w).alias("m")).collect()}
    assert got == expected


@pytest.mark.parametrize("partitions", [2, 9, 64])
def test_previous_row_across_partition_layouts(spark, partitions):
    from pyspark.sql import Window
    from cargoscope.plans.ranking import with_previous
    rng = random.Random(partitions)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}",
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 200))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    got = {r.id: (r.prev.id if r.prev else None) for r in
           with_previous(df, "key", ["ts", "id"], num_partitions=partitions).collect()}
    w = Window.partitionBy("key").orderBy("ts", "id")
    assert got == {r.id: r.p for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}


def test_whole_rows_move_once_and_ranges_are_even(spark):
    """One exchange of whole rows, nothing written in between, and a hot
    key's ranges hold at most twice their share."""
    from cargoscope.plans.ranking import with_previous
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        (F.col("id") * 7919 % 20_000).alias("ts"), "id", F.lit("payload").alias("payload"))
    out = with_previous(df, "key", ["ts", "id"], num_partitions=64)
    plan = plan_text(out).split("== Physical Plan ==")[1]
    assert "ExistingRDD" not in plan and plan.count("shufflepartitionidpassthrough") == 1
    assert sum("Exchange" in line for line in plan.splitlines()) == 2  # the halo's cut rows, the rows
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 60 and max(sizes) <= 2 * 20_000 / 64


@pytest.mark.parametrize("n", [1, 2, 9, 200])
def test_previous_with_null_keys_equal_times_and_many_ranges(spark, n):
    from cargoscope.plans.ranking import with_previous
    rng = random.Random(n)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, ts int, id long")
    got = {r.id: (None if r.prev is None else r.prev.id) for r in
           with_previous(df, "key", ["ts", "id"], num_partitions=n).collect()}
    want = {}
    for k in (None, "a", "b"):
        ids = [i for _, _, _, i in sorted((t is not None, t or 0, i, i) for key, t, i in rows if key == k)]
        want.update(dict(zip(ids, [None, *ids])))
    assert got == want
