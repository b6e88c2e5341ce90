"""Merkle manifest of a table, with proofs that are folded from hash midstates.

A node is a lower-case SHA-256 hex digest. The leaves of a group (a source),
in order, are cut into runs of three; each run's digest of its joined hex
digests is a node one level up, until one node remains, the group's subroot.
The subroots, in order of their groups, make the root the same way.

A parent keeps a copy of its hash state before each child slot. To see what a
changed child does to the parent, the state before its slot is resumed with
the replacement and the siblings to its right; the ones to its left are never
hashed again. Folding a leaf to the root repeats that once per level.

How it runs. Leaves are hashed in one scan, and only digests go on. Their
places in their group come from a range shuffle. Trees are built and folded
in blocks of ``3**LEVELS`` consecutive nodes, which one task reads one at a
time, so no task ever holds a group, however many rows one source has:

1. upward, each block gives the node ``LEVELS`` levels above it, and the
   blocks' nodes are the next pass's leaves, until each group has one node;
2. downward from the root, each block gets the states and siblings above it
   as one row (its path), rebuilds its own levels and passes on the paths of
   its nodes; over the leaves it folds instead.

Edge cases: a null field is ``-``; null sources come first, null ids first in
their source; rows of equal id rank by digest, so repeated rows get equal
leaves and each its own proof; a text is hashed whole whatever its length; an
empty table has no rows and no root; extra columns are not part of a leaf and
pass through only if asked for with ``keep``; a column that bears the name of
a new one gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cargoscope.llm.common import staged
from cargoscope.plans.ranking import with_global_position

FANOUT = 3
LEVELS = 6  # levels of a tree that one block covers
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NEW = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def node(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Run:
    """One parent: the hash state before each child slot, and the children."""

    def __init__(self, children: Sequence[str]):
        self.children = children
        self.before = []
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def replaced(self, slot: int, digest: str) -> str:
        state = self.before[slot].copy()
        state.update((digest + "".join(self.children[slot + 1:])).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(c for i, c in enumerate(self.children) if i != slot)


class Block:
    """The runs of each level above up to ``FANOUT**levels`` consecutive nodes."""

    def __init__(self, nodes: Sequence[str], levels: int):
        self.runs: list[list[Run]] = []
        row = list(nodes)
        for _ in range(levels):
            runs = [Run(row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)]
            self.runs.append(runs)
            row = [run.digest for run in runs]
        [self.top] = row

    def steps(self, place: int) -> Iterator[tuple[Run, int]]:
        """(parent, slot in it) on the way up from the node at ``place``."""
        for runs in self.runs:
            place, slot = divmod(place, FANOUT)
            yield runs[place], slot


def encode_steps(steps) -> str:
    """slot and children of each parent, as text: what a state is rebuilt from."""
    return ";".join(f"{slot}:{''.join(run.children)}" for run, slot in steps)


def decode_steps(path: str) -> list[tuple[Run, int]]:
    out = []
    for step in filter(None, path.split(";")):
        slot, children = step.split(":")
        out.append((Run([children[i:i + 64] for i in range(0, len(children), 64)]), int(slot)))
    return out


def fold(digest: str, steps) -> str:
    """The root that ``digest`` leads to: one resumed state per level."""
    for run, slot in steps:
        digest = run.replaced(slot, digest)
    return digest


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 over each field as ``byte count:value``, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    """([path row or nothing], rows) of each (group, block) of a sorted stream
    whose rows start with (group, block, place)."""
    held, key = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:2] != key and held:
                yield [r for r in held if r[2] < 0], [r for r in held if r[2] >= 0]
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield [r for r in held if r[2] < 0], [r for r in held if r[2] >= 0]


def _by_block(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Nodes (grp, place, n, ...) dealt out by block, each block's path first."""
    rows = nodes.withColumn("block", F.expr(f"place div {FANOUT ** LEVELS}"))
    if paths is not None:
        rows = rows.unionByName(paths.withColumnRenamed("place", "block").withColumn(
            "place", F.lit(-1).cast("long")), allowMissingColumns=True)
    first = ["grp", "block", "place", "n"]
    rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")


NODES = "grp long, place long, n long, digest string"
PATHS = "grp long, place long, path string, top string, root string"


def _pass_up(nodes: DataFrame) -> DataFrame:
    """One node per block; a group's size becomes its number of blocks."""
    schema = _parse_datatype_string(NODES)
    arrow = to_arrow_schema(schema)

    def run(batches):
        out = []
        for _, rows in _blocks(batches):
            grp, block, _, n = rows[0][:4]
            top = Block([r[4] for r in rows], min(LEVELS, depth(n))).top
            out.append((grp, block, -(-n // FANOUT ** LEVELS), top))
            if len(out) == 4096:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return _by_block(nodes).select("grp", "block", "place", "n", "digest").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


def _pass_down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The path of every node, from its block's path."""
    schema = _parse_datatype_string(PATHS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for above, rows in _blocks(batches):
            [(*_, path, top, root)] = above
            block = Block([r[4] for r in rows], min(LEVELS, depth(rows[0][3])))
            yield _batch([(grp, place, ";".join(filter(None, (
                encode_steps(block.steps(place % FANOUT ** LEVELS)), path))), top, root)
                for grp, _, place, *_ in rows], arrow)

    return _by_block(nodes, paths).select(
        "grp", "block", "place", "n", "digest", "path", "top", "root").mapInArrow(run, schema)


def _levels_of(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The staged nodes of every pass, the last with one node per group. The
    number of passes is the logarithm of the largest group."""
    passes = [nodes]
    while (passes[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        passes.append(staged(_pass_up(passes[-1]), name))
    return passes


def _ranked(leaves: DataFrame) -> DataFrame:
    """Leaves with ``grp`` (a number that rises with the source), ``place`` in
    the source and ``n``, the source's rows."""
    at = staged(with_global_position(leaves, [
        F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")],
        name="at", total_name=None), "merkle-order")
    groups = at.groupBy("source").agg(F.min("at").alias("grp"), F.count(F.lit(1)).alias("n"))
    return at.alias("a").join(groups.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select(
        "a.*", "grp", "n", (F.col("at") - F.col("grp")).alias("place")).drop("source", "at")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source",
             id_col: str = "doc_id", changes: dict[str, Column] | None = None,
             keep: Sequence[str] | None = None) -> DataFrame:
    """Adds to ``keep`` (the id by default) each row's ``leaf``, its group's
    ``subroot``, the ``root``, ``proof_sha256`` (the digest of all siblings on
    the way up), ``folded_root`` and ``verified``.

    ``changes`` replaces fields of a row by expressions over its columns
    before its leaf is folded; without it every row verifies.
    """
    kept = [c for c in (keep if keep is not None else [id_col]) if c.lower() not in NEW]
    now = {f: F.col(f"`{f}`") for f in fields}
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
                   or [F.lit(None).cast("string").alias("c0")])
    leaves = staged(docs.select(
        row.alias("row"), F.col(f"`{group}`").alias("source"), F.col(f"`{id_col}`").alias("id"),
        leaf_digest(now.values()).alias("leaf"),
        leaf_digest({**now, **(changes or {})}.values()).alias("found")), "merkle-leaves")
    ranked = staged(_ranked(leaves), "merkle-ranked")
    nodes = ranked.select("grp", "place", "n", F.col("leaf").alias("digest"))
    groups = _levels_of(nodes, "merkle-up")
    subroots = staged(with_global_position(
        groups[-1].select(F.col("grp").alias("of"), "digest"), [F.col("of")], name="place",
        total_name="n").withColumn("grp", F.lit(0).cast("long")), "merkle-subroots")
    tops = _levels_of(subroots.select("grp", "place", "n", "digest"), "merkle-top")
    paths = tops[-1].select("grp", "place", F.lit("").alias("path"), F.col("digest").alias("top"),
                            F.col("digest").alias("root"))
    for level in reversed(tops[:-1]):
        paths = staged(_pass_down(level, paths), "merkle-down")
    paths = subroots.join(paths.drop("grp"), "place").select(
        F.col("of").alias("grp"), F.lit(0).cast("long").alias("place"), "path",
        F.col("digest").alias("top"), "root")
    for level in reversed(groups[1:-1]):
        paths = staged(_pass_down(level, paths), "merkle-down")
    return _folded(ranked, paths, kept)


def _folded(ranked: DataFrame, paths: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Folds every leaf's ``found`` digest to the root along its path."""
    new = _parse_datatype_string("leaf string, subroot string, root string, proof_sha256 string, "
                                 "folded_root string, verified boolean")
    out = StructType([ranked.schema["row"], *new.fields])
    arrow = to_arrow_schema(out)
    stream = _by_block(ranked.select("grp", "place", "n", F.col("leaf").alias("digest"), "found", "row"),
                       paths).select("grp", "block", "place", "n", "digest", "found", "path", "top",
                                     "root", "row")

    def run(batches):
        rows, carried = [], []
        for above, block_rows, given in _blocks_with_rows(batches):
            path, top, root = above
            upper = decode_steps(path)  # states of the parents above, rebuilt once per block
            upper_siblings = "".join(r.siblings(slot) for r, slot in upper).encode()
            block = Block([r[4] for r in block_rows], min(LEVELS, depth(block_rows[0][3])))
            for _, _, place, _, leaf, found in block_rows:
                steps = list(block.steps(place % FANOUT ** LEVELS))
                proof = hashlib.sha256("".join(r.siblings(s) for r, s in steps).encode())
                proof.update(upper_siblings)
                folded = fold(fold(found, steps), upper)
                rows.append((leaf, top, root, proof.hexdigest(), folded, folded == root))
            carried.extend(given)
            if len(rows) >= 4096:
                yield _joined(carried, rows, arrow)
                rows, carried = [], []
        yield _joined(carried, rows, arrow)

    folded = stream.mapInArrow(run, out)
    return folded.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], *NEW)


def _joined(carried: list[pa.Array], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    own = schema.field(0).type
    first = pa.concat_arrays([c.cast(own) for c in carried]) if carried else pa.array([], own)
    rest = _batch(rows, pa.schema(list(schema)[1:]))
    return pa.RecordBatch.from_arrays([first, *rest.columns], schema=schema)


def _blocks_with_rows(batches: Iterator[pa.RecordBatch]):
    """(path row, leaves, their ``row`` columns) of each block of the stream;
    the passed-through columns stay Arrow arrays."""
    path, rows, given, key = None, [], [], None
    for batch in batches:
        plain = list(zip(*[c.to_pylist() for c in batch.columns[:9]]))
        start = 0

        def take(end):
            if end > start:
                given.append(batch.column(9).slice(start, end - start))

        for i, (grp, block, place, n, digest, found, way, top, root) in enumerate(plain):
            if (grp, block) != key or place < 0:
                take(i)
                if rows:
                    yield path, rows, given
                key, start, rows, given = (grp, block), i, [], []
            if place < 0:
                path, start = (way, top, root), i + 1
            else:
                rows.append((grp, block, place, n, digest, found))
        take(len(plain))
    if rows:
        yield path, rows, given
