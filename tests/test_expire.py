"""Retention by dropping partitions of a committed sink."""

import os

import pytest
from pyspark.sql import functions as F

from cargoscope.sources import storage
from cargoscope.streaming import ingest
from cargoscope.streaming.commits import CommitLog


@pytest.fixture
def log(spark, scratch):
    """Two batches over days 1 to 6 of January, some rows without a day; a second sink."""
    log = CommitLog(spark, f"{scratch}/log")
    for batch_id in (0, 1):
        rows = spark.range(12).select(
            (F.col("id") + 100 * batch_id).alias("id"),
            F.when(F.col("id") < 11, F.expr("date_add(DATE'2024-01-01', CAST(id % 6 AS INT))")).alias("day"))
        with log.batch("s", batch_id) as batch:
            batch.write("kept", rows, by=["day"])
            batch.write("other", rows, by=["day"])
    return log


def days(log, sink="kept"):
    return {str(r["day"]) for r in log.read(sink).select("day").distinct().collect()}


def files(log, sink="kept"):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{log.root}/{sink}")
            for f in names if f.endswith(".parquet")}


def test_drops_whole_partitions_and_touches_no_other_file(spark, log):
    before, other = files(log), files(log, "other")
    stamps = {f: os.stat(f).st_mtime_ns for f in before}
    n = ingest.drop_expired(log, "kept", "2024-01-11 12:00:00", days=7, by="day")
    left = files(log)
    gone = {f for f in before if any(f"day=2024-01-0{d}/" in f for d in (1, 2, 3))}
    assert gone and n == len(gone) and left == before - gone
    assert all(os.stat(f).st_mtime_ns == stamps[f] for f in left)
    assert days(log) == {"2024-01-04", "2024-01-05", "2024-01-06", "None"}
    assert files(log, "other") == other and len(days(log, "other")) == 7
    fresh = CommitLog(spark, log.root)
    assert fresh.committed("s", 0) and fresh.committed("s", 1)
    assert ingest.drop_expired(fresh, "kept", "2024-01-11 12:00:00", days=7, by="day") == 0


def test_a_run_that_dies_before_removal_loses_and_shows_nothing(spark, log, monkeypatch):
    before = files(log)
    monkeypatch.setattr(storage, "remove", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        log.expire("kept", "2024-01-04", "day")
    monkeypatch.undo()
    assert files(log) == before  # still there, but no reader sees them
    assert days(CommitLog(spark, log.root)) == {"2024-01-04", "2024-01-05", "2024-01-06", "None"}
    assert CommitLog(spark, log.root).expire("kept", "2024-01-04", "day") == 0
    assert files(log) < before


def test_compact_keeps_drops_and_rows(spark, log):
    log.expire("kept", "2024-01-03", "day")
    want = sorted(r["id"] for r in log.read("kept").collect())
    log.compact()
    assert not storage.exists(spark, f"{log.root}/commits/drops")
    again = CommitLog(spark, log.root)
    assert sorted(r["id"] for r in again.read("kept").collect()) == want
    assert again.committed("s", 1)
    with again.batch("s", 2) as batch:
        batch.write("kept", spark.sql("SELECT 7L AS id, DATE'2024-01-01' AS day"), by=["day"])
    assert "2024-01-01" in days(again)  # later rows of a dropped day are new files
    again.expire("kept", "2024-01-03", "day")
    assert sorted(r["id"] for r in again.read("kept").collect()) == want


def test_everything_expired_reads_as_empty(spark, log):
    assert log.expire("other", "2030", "day") > 0
    assert log.expire("none", "2030", "day") == 0
    assert days(log, "other") == {"None"}
