"""Tables rewritten by bucket: upserts, the maintained dashboard, kept counts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import dashboard, rates, tables
from cargoscope.sources import storage
from cargoscope.sources.buckets import BucketedTable, hashed
from cargoscope.sources.fixtures import AS_OF, Fixtures
from cargoscope.sources.messages import read_messages
from cargoscope.streaming import ingest
from cargoscope.streaming import refresh as refresh_mod
from cargoscope.streaming import scoring as stream_scoring
from cargoscope.streaming.commits import CommitLog
from cargoscope.streaming.maintained import MaintainedSummary
from cargoscope.operators import scoring
from tests.conftest import SMOKE_DIR


def counts(spark, rows):
    return spark.createDataFrame(rows, "k long, n long")


def add(current, rows):
    return rows if current is None else current.unionByName(rows).groupBy("k").agg(F.sum("n").alias("n"))


def test_merge_rewrites_touched_buckets_only(spark, scratch):
    table = BucketedTable(spark, f"{scratch}/t", F.pmod("k", F.lit(4)))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.merge(counts(spark, [(i, 1) for i in range(8)]), add) == [0, 1, 2, 3]
    before = table.files()
    assert table.merge(counts(spark, [(1, 5), (9, 7)]), add) == [1]
    after = table.files()
    assert all(before[b] == after[b] for b in (0, 2, 3)) and before[1] != after[1]
    assert {r.k: r.n for r in table.read().collect()} == {**{i: 1 for i in range(8)}, 1: 6, 9: 7}
    assert {r.k for r in table.read(buckets=[1]).collect()} == {1, 5, 9}
    opened = table.read(buckets=[1]).inputFiles()
    assert opened and all("bucket=1/" in f for f in opened)


def test_progress_makes_a_merge_count_once(spark, scratch):
    table = BucketedTable(spark, f"{scratch}/t", F.pmod("k", F.lit(4)))
    for batch in (0, 0, 1, 1, 0):
        table.merge(counts(spark, [(3, 1)]), add, {"s": batch})
    assert [r.n for r in table.read().collect()] == [2]
    table.merge(counts(spark, [(3, 1)]), add, {"other": 0})
    assert [r.n for r in table.read().collect()] == [3] and table.progress() == {"s": 1, "other": 0}


def test_a_merge_without_manifest_is_not_read(spark, scratch, monkeypatch):
    table = BucketedTable(spark, f"{scratch}/t", F.pmod("k", F.lit(4)))
    table.merge(counts(spark, [(0, 1), (1, 1)]), add, {"s": 0})
    with monkeypatch.context() as m:
        m.setattr(storage, "publish_version", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.merge(counts(spark, [(0, 10)]), add, {"s": 1})
    assert {r.k: r.n for r in table.read().collect()} == {0: 1, 1: 1}
    table.merge(counts(spark, [(0, 10)]), add, {"s": 1})
    assert {r.k: r.n for r in table.read().collect()} == {0: 11, 1: 1}


def test_dropping_buckets_and_old_files(spark, scratch):
    table = BucketedTable(spark, f"{scratch}/t", F.pmod("k", F.lit(4)))
    table.merge(counts(spark, [(i, 1) for i in range(4)]), add)
    for _ in range(3):
        table.merge(counts(spark, [(0, 1)]), add)
    assert table.drop_buckets(lambda b: b < 2) == [0, 1] and table.drop_buckets(lambda b: b < 2) == []
    assert {r.k for r in table.read().collect()} == {2, 3}
    kept = [n for n in os.listdir(f"{scratch}/t") if n.startswith("manifest-")]
    assert len(kept) == 2
    files = [f for _, _, names in os.walk(f"{scratch}/t/data") for f in names if f.endswith(".parquet")]
    assert len(files) <= 4 + 2


def test_empty_updates_change_nothing(spark, scratch):
    table = BucketedTable(spark, f"{scratch}/t", F.pmod("k", F.lit(4)))
    table.merge(counts(spark, [(1, 1)]), add)
    assert table.merge(counts(spark, []), add) == []
    assert table.read().count() == 1


def test_upsert_equals_the_whole_table_upsert(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    table = tables.shipments_table(spark, f"{scratch}/s", buckets=64)
    table.merge(fx.shipments(), lambda _, rows: rows.select(*tables.SHIPMENT_COLUMNS))
    before = table.files()
    few = fx.shipment_updates().filter("seq < 12")
    touched = tables.upsert_buckets(table, few, as_of=AS_OF)
    want = tables.upsert_shipments(fx.shipments(), few, as_of=AS_OF)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    after = table.files()
    assert 0 < len(touched) < 64 and all(after[b] == before[b] for b in before if b not in touched)


def summary(fx, limit):
    return dashboard.shipments_summary(fx.shipments(), fx.telemetry(), fx.anomaly_events(), limit=limit)


def test_maintained_page_equals_recomputed_page(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    kept = MaintainedSummary(spark, f"{scratch}/m", buckets=16, page_size=50)
    for part in range(2):
        events = fx.anomaly_events().filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
        kept.apply(fx.telemetry().filter(F.pmod("id", F.lit(2)) == part), events,
                   fx.shipments().filter(F.pmod(F.xxhash64("shipment_id"), F.lit(2)) == part),
                   progress={"b": part})
    assert kept.page().collect() == summary(fx, 50).collect()
    # A resolved event is taken off; only its shipment's bucket is rewritten.
    hit = kept.page().filter("open_anomalies > 0").first()
    none = fx.telemetry().limit(0)
    opened = spark.createDataFrame([(hit.shipment_id, False)], "shipment_id string, resolved boolean")
    assert len(kept.apply(none, opened.limit(0), resolved=opened, progress={"b": 2})) == 1
    again = {r.shipment_id: r.open_anomalies for r in kept.page().collect()}
    assert again[hit.shipment_id] == hit.open_anomalies - 1


def test_refresh_reads_new_commits_only(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    messages = fx.messages().drop("id").cache()
    out, scored = f"{scratch}/out", f"{scratch}/scored"
    scorer = scoring.linear_scorer([1 / 8, 0, 0, 0, 0, 0, 0], 0.0)
    kept = MaintainedSummary(spark, f"{scratch}/m", buckets=16, page_size=100)
    ingested, raised = CommitLog(spark, out), CommitLog(spark, scored)
    for k in range(2):
        part = messages.filter(F.pmod(F.xxhash64("message_id"), F.lit(2)) == k)
        ingest.process_ingest_batch(part, k, out, as_of=AS_OF)
        stream_scoring.process_scoring_batch(
            ingested.read("published", after=k).drop("batch"), k, scored, scorer, as_of=AS_OF)
        assert kept.refresh(ingested, raised, fx.shipments() if k == 0 else None)
        assert kept.refresh(ingested, raised) == []
    want = dashboard.shipments_summary(*refresh_mod.load_landed(spark, fx.shipments(), out, scored), limit=100)
    assert kept.page().collect() == want.collect()
    new = ingested.read("telemetry", after=1)
    assert 0 < new.count() < ingested.read("telemetry").count()


def test_refresh_versions_rise_over_restarts_and_manual_refreshes(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    load = lambda n: (lambda: (fx.shipments().limit(n), fx.telemetry(), fx.anomaly_events()))
    out = f"{scratch}/page"
    for n, version in ((3, None), (4, 0), (5, 10 ** 15), (6, 1), (7, None)):  # 0: a new checkpoint's first batch
        refresh_mod.refresh_summary(load(n), out, version=version)
        assert refresh_mod.read_page(spark, out).count() == n
    assert len(os.listdir(f"{out}/pages")) == refresh_mod.KEEP_PAGES


def test_kept_rates_equal_batch_rates_with_old_files(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    src = f"{scratch}/src"
    fx.messages().drop("id").repartition(4).write.json(src)
    now = dt.datetime.now().timestamp()
    for i, name in enumerate(sorted(n for n in os.listdir(src) if n.endswith(".json"))):
        at = now - [0, 20, 3, 11][i % 4] * 86400
        os.utime(f"{src}/{name}", (at, at))
    for _ in range(2):  # a restart adds nothing
        refresh_mod.run_rate_counts(read_messages(spark, src, streaming=True, max_files_per_trigger=1),
                                    f"{scratch}/rates", f"{scratch}/ckpt", seconds=3600).awaitTermination()
    got = rates.over_limit(rates.counts_table(spark, f"{scratch}/rates").read(), threshold=2, seconds=3600)
    whole = read_messages(spark, src).withColumn("device_id", F.col("attributes")["device_id"])
    want = rates.rate_violations(whole, "device_id", 2, 3600, "arrival_time")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 0
    table = rates.counts_table(spark, f"{scratch}/rates")
    days = sorted(table.files())
    assert len(days) >= 4 and table.drop_buckets(lambda day: day < days[-1]) == days[:-1]


def test_hashed_bucket_is_in_range(spark):
    got = {r.b for r in spark.range(500).select(hashed("id", buckets=7).alias("b")).collect()}
    assert got == set(range(7))
