"""Exact global positions, running totals, previous rows and rolling means
without a single-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task. Here the
rows are range-partitioned on the (total) order instead, which splits even a
hot key range by sampled quantiles, then:

1. each range partition is sorted and numbered locally
   (``monotonically_increasing_id`` keeps the in-partition record number in
   its low 33 bits);
2. the numbered partitions are checkpointed to the shared checkpoint folder,
   so a recomputation after an executor loss cannot re-draw the range bounds;
3. per-partition totals (one row per partition, so bounded by the partition
   count) become exclusive offsets with a window over that small table, and
   are broadcast back.

The order must be total (unique keys); callers add tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _staged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    n = _partitions(df, num_partitions)
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mono", F.monotonically_increasing_id())
            .checkpoint(eager=True))


def _offsets(staged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Exclusive prefix of each per-partition total, plus the grand totals."""
    totals = staged.groupBy("_pid").agg(*[expr.alias(name) for name, expr in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))  # over at most one row per partition
    cols = [F.col("_pid")]
    for name in sums:
        cols.append(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_off_{name}"))
        cols.append(F.sum(name).over(whole).alias(f"_total_{name}"))
    return F.broadcast(totals.select(*cols))


def with_global_position(df: DataFrame, order: list[Column], name: str = "row_pos",
                         total_name: str | None = "row_count",
                         num_partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in ``order`` (and the row count)."""
    staged = _staged(df, order, num_partitions)
    offsets = _offsets(staged, {"n": F.count(F.lit(1))})
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    out = staged.join(offsets, "_pid").withColumn(name, F.col("_off_n") + local)
    if total_name:
        out = out.withColumn(total_name, F.col("_total_n"))
    return out.drop("_pid", "_mono", "_off_n", "_total_n")


def with_running_sums(df: DataFrame, order: list[Column], columns: list[str],
                      prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Adds inclusive running sums ``cum_<c>`` and totals ``total_<c>`` of the
    given numeric columns along ``order``.

    Within a range partition the running sum is a window partitioned by the
    partition id, after a range shuffle on that id (one id per task); the
    offsets come from step 3.
    """
    n = _partitions(df, num_partitions)
    staged = _staged(df, order, n)
    offsets = _offsets(staged, {c: F.sum(c) for c in columns})
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Range on the partition id keeps one id per task (a hash could pair two).
    out = staged.repartitionByRange(n, "_pid").join(offsets, "_pid")
    for c in columns:
        out = (out.withColumn(f"{prefix}{c}", F.col(f"_off_{c}") + F.sum(c).over(within))
                  .withColumn(f"total_{c}", F.col(f"_total_{c}")))
    return out.drop("_pid", "_mono", *[f"_off_{c}" for c in columns],
                    *[f"_total_{c}" for c in columns])


DRAWN = 64  # keys drawn per range: ranges are then within about an eighth of equal


def _bounds(df: DataFrame, order: list[str], ranges: int) -> list[Column]:
    """Lower bounds (key structs, ascending, all of them rows of ``df``) of the
    second and later of ``ranges`` ranges with about equally many rows.

    The quantiles of a sketch: the ``DRAWN * ranges`` keys of least hash, which
    combines over partitions. Being literals, they are the same in every task
    and in every recomputation.
    """
    drawn = df.select(*[F.col(f"`{c}`") for c in order]).orderBy(F.xxhash64(*order)).limit(DRAWN * ranges)
    place = F.row_number().over(Window.orderBy(*order))  # over the sketch
    every = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / ranges, F.lit(1.0))
    types = [dict(df.dtypes)[c] for c in order]
    rows = (drawn.select("*", place.alias("_place"), every.alias("_every"))
            .filter((F.col("_place") > 1) & (F.floor((F.col("_place") - 1) / F.col("_every"))
                                             > F.floor((F.col("_place") - 2) / F.col("_every"))))
            .select(*[_taken(c, t) for c, t in zip(order, types)]).distinct().orderBy(*order).collect())
    return [F.struct(*[_given(v, t).alias(c) for v, t, c in zip(r, types, order)]) for r in rows]


def _range_of(key: Column, bounds: list[Column], first: int = 0) -> Column:
    """How many bounds are not above the key, by binary search."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _range_of(key, bounds[:mid], first)).otherwise(
        _range_of(key, bounds[mid + 1:], first + mid + 1))


def _halo_partitions(df: DataFrame, key: str, order: list[str], carry: list[str], preceding: int,
                     num_partitions: int | None) -> tuple[DataFrame, list]:
    """Rows in ranges of (key, order), one range a task, each with the
    ``preceding`` rows of its first key that lie in earlier ranges (the halo).

    The ranges' bounds are literals (``_bounds``), so a row's range is an
    expression over the row: whole rows move once, straight to their range, and
    nothing is written in between. Only a range's last key can continue, so the
    halo comes from the last ``preceding`` rows of each range of the next
    bound's key; it is found over ``key``, ``order`` and ``carry`` alone, cut
    before it is shuffled, and sent to the next ranges that start in the same
    key (a bound is a row, so no range is empty, and ``preceding`` of them
    suffice), each of which keeps the nearest ``preceding``. A window over
    (``_target``, key) then needs no further shuffle and no task holds more
    than a range and its halo.
    """
    cols = [F.col(c) for c in order]
    total = [key, *order]
    bounds = _bounds(df, total, _partitions(df, num_partitions))
    target = _range_of(F.struct(*[F.col(f"`{c}`") for c in total]), bounds)
    own = df.withColumn("_target", target).withColumn("_halo", F.lit(False))
    if not bounds:
        return own.repartitionById(1, F.col("_target")), cols
    first_keys = F.array(*[b[key] for b in bounds])  # of ranges 1, 2, ...
    part = df.select(key, *order, *carry).withColumn("_range", target)
    from_end = Window.partitionBy("_range").orderBy(*[c.desc() for c in cols])
    halo = (part.filter(F.get(first_keys, F.col("_range")).eqNullSafe(F.col(key))
                        & (F.col("_range") < len(bounds)))
            .withColumn("_from_end", F.row_number().over(from_end))
            .filter(F.col("_from_end") <= preceding)
            .withColumn("_target", F.explode(F.sequence(
                F.col("_range") + 1, F.least(F.col("_range") + preceding, F.lit(len(bounds))))))
            .filter(F.get(first_keys, F.col("_target") - 1).eqNullSafe(F.col(key)))
            .select("_target", key, *order, *carry, F.lit(True).alias("_halo")))
    if preceding > 1:  # several earlier ranges may have sent theirs
        nearest = Window.partitionBy("_target").orderBy(*[c.desc() for c in cols])
        halo = halo.withColumn("_near", F.row_number().over(nearest)).filter(
            F.col("_near") <= preceding).drop("_near")
    combined = own.unionByName(halo, allowMissingColumns=True)
    return combined.repartitionById(len(bounds) + 1, F.col("_target")), cols


def _own_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_target", "_halo")


def with_previous(df: DataFrame, key: str, order: list[str], name: str = "prev",
                  num_partitions: int | None = None) -> DataFrame:
    """Adds ``name`` = struct of the ``order`` columns of the previous row of
    the same ``key`` (``lag`` over key ordered by ``order``), without putting
    a hot key into one task: the lag runs per range partition with a one-row
    halo (``_halo_partitions``)."""
    combined, cols = _halo_partitions(df, key, order, [], 1, num_partitions)
    piece = Window.partitionBy("_target", key).orderBy(*cols)
    return _own_rows(combined.withColumn(name, F.lag(F.struct(*cols)).over(piece)))


def with_rolling_mean(df: DataFrame, key: str, order: list[str], value: str, name: str,
                      preceding: int, num_partitions: int | None = None) -> DataFrame:
    """Adds ``name`` = mean of ``value`` over the ``preceding`` rows before each
    row and the row itself, per ``key`` in ``order`` (a ROWS frame), without
    putting a hot key into one task: the window runs per range partition with
    a ``preceding``-row halo (``_halo_partitions``)."""
    combined, cols = _halo_partitions(df, key, order, [value], preceding, num_partitions)
    frame = Window.partitionBy("_target", key).orderBy(*cols).rowsBetween(-preceding, 0)
    return _own_rows(combined.withColumn(name, F.avg(value).over(frame)))


PIVOTS = 63  # keys that one round of the selection compares with
FEW = 4096  # rows that are sorted outright


def _taken(column: str, dtype: str) -> Column:
    """A key column in a form that a driver value carries exactly."""
    if dtype == "timestamp":
        return F.unix_micros(column).alias(column)
    return F.col(column).cast("string").alias(column) if dtype in ("timestamp_ntz", "date") else F.col(column)


def _given(value, dtype: str) -> Column:
    """The literal of a value that ``_taken`` brought to the driver."""
    if dtype == "timestamp" and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(dtype)


def _interval_of(key: Column, pivots: list[Column], first: int = 0) -> Column:
    """2i for a key between pivots i-1 and i, 2i+1 for one equal to pivot i,
    by binary search over the sorted pivots."""
    if not pivots:
        return F.lit(2 * first)
    mid = len(pivots) // 2
    return (F.when(key < pivots[mid], _interval_of(key, pivots[:mid], first))
            .when(key == pivots[mid], F.lit(2 * (first + mid) + 1))
            .otherwise(_interval_of(key, pivots[mid + 1:], first + mid + 1)))


def kth_key(df: DataFrame, order: list[str], k: int) -> Column | None:
    """The key (a struct literal of the ``order`` columns, nulls first) of the
    ``k``-th row of ``df`` in ``order``, counting from 1; None if there is none.

    Selection, not sorting: each round draws ``PIVOTS`` keys (those of least
    hash), counts the rows between them in one partial aggregation, and goes on
    with the one interval that holds the row, so rows shrink by about the
    number of pivots a round. Its bounds on the first column are plain
    comparisons, which reach the scan. No round moves rows: what is shuffled is
    at most a count per interval and task. Equal keys, even of all rows, are
    one pivot and end the search.
    """
    types = [dict(df.dtypes)[c] for c in order]
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    parts = df.select(*[F.col(f"`{c}`") for c in order])

    def literal(row) -> Column:
        return F.struct(*[_given(v, t).alias(c) for v, t, c in zip(row, types, order)])

    rows = parts.count()
    if not 1 <= k <= rows:
        return None
    while rows > FEW:
        drawn = (parts.orderBy(F.xxhash64(*order)).limit(PIVOTS).distinct().orderBy(*order)
                 .select(*[_taken(c, t) for c, t in zip(order, types)]).collect())
        pivots = [literal(r) for r in drawn]
        counts = {r["at"]: r["n"] for r in parts.groupBy(_interval_of(key, pivots).alias("at")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        for at in range(2 * len(pivots) + 1):
            rows = counts.get(at, 0)
            if k <= rows:
                break
            k -= rows
        if at % 2:
            return pivots[at // 2]
        low, high = at // 2 - 1, at // 2
        if low >= 0:
            parts = parts.filter(key > pivots[low])
            if drawn[low][0] is not None:
                parts = parts.filter(F.col(f"`{order[0]}`") >= _given(drawn[low][0], types[0]))
        if high < len(pivots):
            parts = parts.filter(key < pivots[high])
            if drawn[high][0] is not None:
                first = F.col(f"`{order[0]}`")
                parts = parts.filter(first.isNull() | (first <= _given(drawn[high][0], types[0])))
    last = (parts.orderBy(*order).limit(k).orderBy(*[F.col(f"`{c}`").desc() for c in order]).limit(1)
            .select(*[_taken(c, t) for c, t in zip(order, types)]).collect())
    return literal(last[0])
