"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cargoscope.session import shared_path

#: White space between words of the contracts: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recompute of
    what came before. Each call writes a fresh folder.
    """
    path = shared_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters outside SPACE_CLASS."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the value's text, modulo ``mod`` (null for a null value)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = "_" + name
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Renames the columns that clash with ``names`` (without case); returns
    the table and the map from each original name to its present one."""
    taken = {n.lower() for n in names}
    place = {c: free_name(df, f"__own{i}") if c.lower() in taken else c
             for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(place[c]) for c in df.columns]), place


def _slices(batch: pa.RecordBatch, index: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice holds much more than ``max_bytes`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def annotate(df: DataFrame, make: Callable[[], Callable[..., list[list]]],
             out: str, text_col: str = "text", keep: Sequence[str] | None = None,
             given: Sequence[str] = (), slice_bytes: int = 1 << 20) -> DataFrame:
    """Adds the columns ``out`` (a DDL list), computed from each row's text.

    ``make`` runs once per task and returns the function from a list of texts
    (and of the values of each column in ``given``) to the list of new
    columns. ``keep`` names the columns passed through (all
    by default); a kept column whose name clashes with a new one gives way to
    it. A narrow map: no shuffle, and at most ``slice_bytes`` of text (or one
    text) are held as Python objects at a time.
    """
    new = _parse_datatype_string(out)
    taken = {f.name.lower() for f in new.fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = StructType([df.schema[c] for c in names] + new.fields)
    source = df.select(*[F.col(f"`{c}`") for c in names],
                       F.col(f"`{text_col}`").alias("__text"),
                       *[F.col(f"`{c}`").alias(f"__given{i}") for i, c in enumerate(given)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in _slices(batch, len(names), slice_bytes):
                columns = fn(*[part.column(len(names) + i).to_pylist()
                               for i in range(1 + len(given))])
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                added = [pa.array(col, type=arrow.field(len(names) + i).type)
                         for i, col in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(kept + added, schema=arrow)
            del batch, part, kept, added
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
