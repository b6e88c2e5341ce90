"""Keys over a request-rate threshold (X2, re-aimed from the gateway throttle).

Tumbling event-time windows per key, counted with partial aggregation; only
(window, key) pairs above the threshold are returned. The same function
serves a stream when the input is a streaming DataFrame with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Throttle of the reference: 1000 requests per 60 seconds per client (fixed values).
RATE_LIMIT_COUNT = 1000
RATE_LIMIT_SECONDS = 60


def rate_violations(df: DataFrame, key: str, threshold: int = RATE_LIMIT_COUNT,
                    seconds: int = RATE_LIMIT_SECONDS, time_col: str = "event_time") -> DataFrame:
    """``key`` values with more than ``threshold`` rows in a tumbling window
    of ``seconds`` (windows aligned to the epoch). Returns
    ``window_start, window_end, <key>, n``."""
    counted = (df.groupBy(F.window(F.col(time_col), f"{int(seconds)} seconds").alias("w"), F.col(key))
               .agg(F.count(F.lit(1)).alias("n")))
    return (counted.filter(F.col("n") > threshold)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    key, "n"))


def rate_counts(df: DataFrame, key: str, seconds: int = RATE_LIMIT_SECONDS,
                time_col: str = "event_time") -> DataFrame:
    """window_start, ``key``, n of every tumbling window."""
    return (df.groupBy(F.window(F.col(time_col), f"{int(seconds)} seconds")["start"].alias("window_start"),
                       F.col(key)).agg(F.count(F.lit(1)).alias("n")))


def add_counts(current: DataFrame | None, counts: DataFrame) -> DataFrame:
    """Counts with a batch's counts added, window by window."""
    rows = counts if current is None else current.unionByName(counts)
    key = [c for c in counts.columns if c != "n"]
    return rows.groupBy(*key).agg(F.sum("n").alias("n"))


def over_limit(counts: DataFrame, threshold: int = RATE_LIMIT_COUNT,
               seconds: int = RATE_LIMIT_SECONDS) -> DataFrame:
    """The windows above ``threshold``, as :func:`rate_violations` returns them."""
    key = next(c for c in counts.columns if c not in ("window_start", "n"))
    end = F.col("window_start") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return counts.filter(F.col("n") > threshold).select("window_start", end.alias("window_end"), key, "n")


def counts_table(spark, path: str):
    """Counts kept per window, in buckets of one day of windows: a late row
    corrects its window and rewrites its day only; days past retention are
    dropped without reading them (``drop_buckets``)."""
    from cargoscope.sources.buckets import BucketedTable
    return BucketedTable(spark, path, F.unix_date(F.to_date("window_start")).cast("long"))
