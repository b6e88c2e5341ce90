"""Session construction and shared-folder helpers.

Library functions never create a session; they use the one their input
DataFrames belong to. ``build_session`` is for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cargoscope", extra: dict | None = None) -> SparkSession:
    """Local/test session with AQE on, UI off and UTC session time."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Stream state outside the heap, written as change logs (the id dedup of the streams).
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder: executors
    do not see each other's disks, so an unset folder raises. Only a local
    master gets a fresh scratch folder. The context's own checkpoint folder is
    set once.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="cargoscope-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for lineage-cutting tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def plan_text(df) -> str:
    """The physical plan as ``df.explain()`` prints it (for checks and reports)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="extended")
    return buf.getvalue()
