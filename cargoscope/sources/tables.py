"""Table scans with the fixed schemas (A5) and the training scan.

Parquet is the storage format; the five tables of the data model are read
with their declared schema (no inference), so column pruning and filter
pushdown reach the files. A JDBC source with the same schema is available
for a relational store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope import schemas

TABLE_NAMES = list(schemas.TABLES)


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """One table of the data model at ``path`` (a folder, partitioned or not).

    ``fmt="jdbc"`` reads ``options['dbtable']`` (default: the table name)
    through the JDBC source and casts to the declared schema.
    """
    schema = schemas.TABLES[table]
    if fmt == "jdbc":
        opts = {"dbtable": table, **(options or {})}
        raw = spark.read.format("jdbc").options(**opts).load()
        return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    reader = spark.read.schema(schema).options(**(options or {}))
    return reader.format(fmt).load(path)


def load_tables(spark: SparkSession, base_dir: str, fmt: str = "parquet",
                options: dict | None = None) -> dict[str, DataFrame]:
    """All five tables under ``base_dir/<table>`` (A5)."""
    return {t: read_table(spark, f"{base_dir.rstrip('/')}/{t}", t, fmt, options) for t in TABLE_NAMES}


def write_table(df: DataFrame, base_dir: str, table: str, mode: str = "overwrite") -> None:
    """Write a table with exactly its declared columns, in order."""
    schema = schemas.TABLES[table]
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    df.select(*cols).write.mode(mode).parquet(f"{base_dir.rstrip('/')}/{table}")


def read_training(spark: SparkSession, path: str, as_of=None, days: int = 90,
                  partition_col: str = "event_date") -> DataFrame:
    """The warehouse training scan (A6): label not null, last ``days`` days.

    When the data is day-partitioned, the implied bound on the partition
    column is added too, so whole days outside the window are never listed
    or opened (a filter on ``timestamp`` alone cannot prune partitions).
    """
    from cargoscope.functions.columns import as_of_col
    from cargoscope.operators.training import load_training
    raw = spark.read.parquet(path)
    if partition_col in raw.columns:
        since = F.to_date(as_of_col(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
        raw = raw.filter(F.col(partition_col) >= since)
    return load_training(raw, as_of=as_of, days=days, time_col="timestamp")
