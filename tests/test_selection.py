"""Exact selection of the k-th key, and the temporal split that rests on it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import training
from cargoscope.plans import ranking
from cargoscope.session import plan_text

SCHEMA = "t timestamp, device string, id long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(5)


def sort_key(row):
    return [(v is not None, v) if v is not None else (False,) for v in row]


def kth(df, order, k):
    found = ranking.kth_key(df, order, k)
    key = F.struct(*order)
    return df.filter(key == found).select(*order).collect()


@pytest.mark.parametrize("few,pivots", [(1, 3), (4096, 63)])
@pytest.mark.parametrize("kind", ["spread", "one_time", "one_device", "nulls", "repeats"])
def test_equals_sorting(spark, monkeypatch, few, pivots, kind):
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "PIVOTS", pivots)
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(120):
        t = base + dt.timedelta(microseconds=rnd.randrange(10 ** 9))
        rows.append({"spread": (t, f"d{rnd.randrange(5)}", i), "one_time": (base, f"d{rnd.randrange(3)}", i),
                     "one_device": (base, "d", i),
                     "nulls": (rnd.choice([None, base, t]), rnd.choice([None, "d"]), i),
                     "repeats": (base, "d", rnd.randrange(3))}[kind])
    df = frame(spark, rows).cache()
    ordered = sorted(rows, key=sort_key)
    for k in (1, 96, 120):
        found = {tuple(r) for r in df.filter(F.struct("t", "device", "id").eqNullSafe(
            ranking.kth_key(df, ["t", "device", "id"], k))).collect()}
        assert found == {ordered[k - 1]}, (kind, k)
    assert ranking.kth_key(df, ["t", "device", "id"], 0) is None
    assert ranking.kth_key(df, ["t", "device", "id"], 121) is None


def test_other_types(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    df = spark.range(200).select(
        F.expr("timestampadd(MICROSECOND, id * 7 % 50, timestamp_ntz '2024-03-31 02:30:00.000001')").alias("a"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).alias("b"),
        (F.col("id") / 3).alias("c"), F.col("id").cast("decimal(20,3)").alias("d"))
    rows = sorted(tuple(r) for r in df.collect())
    for k in (1, 77, 200):
        assert [tuple(r) for r in kth(df, ["a", "b", "c", "d"], k)] == [rows[k - 1]]


def test_split_of_equal_times_moves_no_rows(spark):
    df = spark.range(300_000).select(F.lit("2024-01-01").cast("timestamp").alias("t"),
                                     F.lit("d").alias("device"), F.col("id"))
    split = training.temporal_split(df, ["t", "device", "id"])
    plan = plan_text(split)
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.split: (r.n, r.low, r.high) for r in split.groupBy("split").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    assert got == {"train": (240_000, 0, 239_999), "test": (60_000, 240_000, 299_999)}


def test_split_edges(spark):
    none = frame(spark, [])
    assert training.temporal_split(none, ["t", "device", "id"]).collect() == []
    one = frame(spark, [(None, None, 1)])
    assert [r.split for r in training.temporal_split(one, ["t", "device", "id"]).collect()] == ["test"]
    full = training.temporal_split(one, ["t", "device", "id"], fraction=1.0)
    assert [r.split for r in full.collect()] == ["train"]


def test_rounds_shuffle_counts_only(spark):
    """Rows stay where they are: the aggregation hands on a count per interval."""
    df = spark.range(50_000).select(F.lit(0).alias("t"), F.col("id"))
    pivots = [F.struct(F.lit(0).alias("t"), F.lit(i).cast("long").alias("id")) for i in (10, 20_000)]
    at = ranking._interval_of(F.struct("t", "id"), pivots)
    counted = df.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    assert "partial_count" in plan_text(counted)
    assert {r["at"]: r["n"] for r in counted.collect()} == {0: 10, 1: 1, 2: 19_989, 3: 1, 4: 29_999}
