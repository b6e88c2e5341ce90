"""Prefix trie of conversations that share openings, by composable fingerprints.

A conversation ``c`` may begin with the head of a base conversation: its
rebuilt form is the base's first ``head`` turns and then its own turns after
as many. The trie has a node for every distinct sequence of first ``d`` turns.

Fingerprints. A sequence of turns x_0, x_1, ... has the fingerprint
``sum x_i * B**i`` modulo a prime, with its length. These form a monoid: the
fingerprint of ``u`` followed by ``v`` is ``f(u) + B**len(u) * f(v)``, so

* prefixes of one conversation that lies in several tasks compose from the
  tasks' own prefixes, and no task needs a whole conversation;
* a rebuilt conversation's prefix is the base head's product combined with
  the own suffix's, ``f(own[h:j]) = (f(own[:j]) - f(own[:h])) / B**h``, and
  its turns are never put together: a rebuilt turn is a reference (the
  conversation and place where the turn is stored).

Two bases make 122 bits. Equal fingerprints are not taken on trust: the rows
of a node must agree on their parent node, and where they refer to different
stored turns, on role and text. If any differ, all is done anew with other
bases.

Figures of a subtree need no ancestors' lists. A node belongs to its smallest
member, so each conversation owns a downward chain of nodes, and a subtree is
the chains that its members own, less what its own chain has above it:
``sum over members of the chain's total - what the chain has above the node``.

Edge cases: null role or text is empty; turns order by turn (null first), and
equal turns by role, then text; rows without conv_id belong to no
conversation and are left out; repeated rows are turns each; a conversation
whose base is missing has no head; texts are read whole; an empty table has
no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cargoscope.llm.common import staged, words_of
from cargoscope.plans.ranking import with_running_sums

MODULUS = (1 << 61) - 1
ATTEMPTS = 4
GROUP = 20  # conversations that share a base
MAX_HEAD = 3
CHUNK_BITS = 12  # a piece of a list of ends holds at most 2**12 conversation ids
KEY = ["depth", "f1", "f2"]


class FingerprintCollision(RuntimeError):
    """Different turn sequences kept equal fingerprints under every pair of bases."""


def bases(attempt: int, modulus: int = MODULUS) -> tuple[int, int]:
    rnd = random.Random(attempt)
    return rnd.randrange(2, modulus), rnd.randrange(2, modulus)


def base_of(conv: Column) -> Column:
    return conv - conv % GROUP


def head_of(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (MAX_HEAD + 1)).cast("int")


def _times(a: Column, b: Column | int, modulus: int) -> Column:
    """a * b modulo a modulus below 2**61; the product needs 37 digits."""
    wide = "decimal(19,0)"
    b = F.lit(b) if isinstance(b, int) else b
    return (a.cast(wide) * b.cast(wide) % F.lit(modulus).cast(wide)).cast("long")


def _stored_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text in turn order within range partitions (``pid``)."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                    .cast("binary"), 256)
    return (turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("sha", digest)
            .select("conv_id", F.spark_partition_id().alias("pid"), "role", "text",
                    F.size(words_of(F.col("text"))).cast("long").alias("words"),
                    F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("x1"),
                    F.conv(F.substring("sha", 16, 15), 16, 10).cast("long").alias("x2")))


SCANNED = ("conv_id long, pid int, place long, b1 long, b2 long, a1 long, a2 long, words long, "
           "role string, text string")


def _scan(turns: DataFrame, bases_: tuple[int, int], modulus: int) -> DataFrame:
    """Running fingerprints of each conversation's part in a partition, before
    (b) and after (a) each turn; ``place`` counts within the part."""
    schema = _parse_datatype_string(SCANNED)
    arrow = to_arrow_schema(schema)
    base1, base2 = bases_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place = h1 = h2 = p1 = p2 = None
        for batch in batches:
            rows = []
            for conv, x1, x2 in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "x1", "x2")]):
                if conv != key:
                    key, place, h1, h2, p1, p2 = conv, 0, 0, 0, 1, 1
                n1, n2 = (h1 + x1 * p1) % modulus, (h2 + x2 * p2) % modulus
                rows.append((place, h1, h2, n1, n2))
                place, h1, h2 = place + 1, n1, n2
                p1, p2 = p1 * base1 % modulus, p2 * base2 % modulus
            made = dict(zip(("place", "b1", "b2", "a1", "a2"),
                            [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5))
            yield pa.RecordBatch.from_arrays(
                [made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return turns.mapInArrow(run, schema)


def _continued(parts: DataFrame, bases_: tuple[int, int], modulus: int) -> DataFrame:
    """For each part that continues a conversation: the places and the
    fingerprints before it, and the factors its own fingerprints take. Only a
    partition's first conversation can continue, so these are at most as many
    rows as partitions."""
    schema = _parse_datatype_string(
        "conv_id long, pid int, n0 long, o1 long, o2 long, s1 long, s2 long")
    arrow = to_arrow_schema(schema)
    base1, base2 = bases_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n = h1 = h2 = 0
                for part in row["parts"]:
                    s1, s2 = pow(base1, n, modulus), pow(base2, n, modulus)
                    if n:
                        rows.append((row["conv_id"], part["pid"], n, h1, h2, s1, s2))
                    h1, h2 = (h1 + s1 * part["a1"]) % modulus, (h2 + s2 * part["a2"]) % modulus
                    n += part["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, arrow)], schema=arrow)

    return parts.filter(F.size("parts") > 1).mapInArrow(run, schema)


def _rebuilt(conversations: DataFrame, bases_: tuple[int, int], modulus: int) -> tuple[DataFrame, DataFrame]:
    """(stored turns with their places, rebuilt rows): a rebuilt row is a
    conversation's prefix of ``depth`` turns, its fingerprint and its parent's,
    the words of its last turn and the reference to it."""
    turns = staged(_scan(_stored_turns(conversations), bases_, modulus), "trie-turns")
    parts = turns.groupBy("conv_id", "pid").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("a1", "place").alias("a1"), F.max_by("a2", "place").alias("a2"))
    convs = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_own"),
        F.sort_array(F.collect_list(F.struct("pid", "n", "a1", "a2"))).alias("parts"))  # one per partition
    convs = staged(convs, "trie-conversations")
    offsets = F.broadcast(_continued(convs, bases_, modulus))

    def moved(col: str, k: int) -> Column:
        return F.when(F.col("n0").isNull(), F.col(col)).otherwise(
            (F.col(f"o{k}") + _times(F.col(col), F.col(f"s{k}"), modulus)) % modulus).alias(col)

    placed = turns.join(offsets, ["conv_id", "pid"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("n0", F.lit(0))).alias("place"),
        moved("b1", 1), moved("b2", 2), moved("a1", 1), moved("a2", 2), "words", "role", "text")

    first = placed.filter(F.col("place") < MAX_HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("place", "b1", "b2", "a1", "a2", "words"))).alias("first"))  # at most MAX_HEAD
    heads = first.filter(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    none = F.array().cast(first.schema["first"].dataType)
    info = (convs.drop("parts").join(first, "conv_id")
            .withColumn("base", base_of(F.col("conv_id"))).withColumn("h", head_of(F.col("conv_id")))
            .join(heads, "base", "left")
            .withColumn("head", F.slice(F.coalesce("base_first", none), 1, F.col("h"))))

    def at_end(turns_: Column, n: Column, field: str) -> Column:
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.get(turns_, n - 1)[field])

    info = staged(info.withColumn("n_head", F.size("head")).select(
        "conv_id", "base", "h", "head", "n_head",
        (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"),
        *[at_end(F.col("head"), F.col("n_head"), f"a{k}").alias(f"head{k}") for k in (1, 2)],
        # a conversation of fewer own turns has none left; its value is not used
        *[at_end(F.col("first"), F.col("h"), f"a{k}").alias(f"own{k}") for k in (1, 2)]), "trie-heads")

    def combined(col: str, k: int) -> Column:
        """Head product * own suffix product; a short head moves the suffix."""
        suffix = F.pmod(F.col(col) - F.col(f"own{k}"), F.lit(modulus))
        short = F.col("h") - F.col("n_head")
        for gap in range(1, MAX_HEAD + 1):
            back = pow(pow(bases_[k - 1], gap, modulus), -1, modulus)
            suffix = F.when(short == gap, _times(F.pmod(F.col(col) - F.col(f"own{k}"), F.lit(modulus)),
                                                 back, modulus)).otherwise(suffix)
        return (F.col(f"head{k}") + suffix) % modulus

    info_of_own = info.drop("head", "base")
    own = placed.drop("role", "text").join(info_of_own, "conv_id").filter(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("n_head") + F.col("place") - F.col("h") + 1).alias("depth"),
        combined("a1", 1).alias("f1"), combined("a2", 2).alias("f2"),
        combined("b1", 1).alias("p1"), combined("b2", 2).alias("p2"), "words",
        F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), "n_turns")
    opening = info.select("conv_id", "base", "n_turns", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.a1", "t.a2", "t.b1", "t.b2", "t.words",
        F.col("base").alias("ref_conv"), F.col("t.place").alias("ref_place"), "n_turns").toDF(
        *own.columns)
    nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = info.select("conv_id", zero, zero, zero, nothing, nothing, zero, nothing, nothing,
                        "n_turns").toDF(*own.columns)
    rows = own.unionByName(opening).unionByName(roots).withColumn(
        "is_end", F.col("depth") == F.col("n_turns")).drop("n_turns")
    return placed, staged(rows, "trie-rows")


def _collides(nodes: DataFrame, rows: DataFrame, stored: DataFrame) -> bool:
    """True if a node's rows differ in parent or last turn."""
    if not nodes.filter("p1_low <> p1_high OR p2_low <> p2_high").isEmpty():
        return True
    unsure = nodes.filter(F.col("ref_low") != F.col("ref_high")).select(*KEY)
    claims = rows.join(unsure, KEY).select(*KEY, "ref_conv", "ref_place").distinct()
    found = claims.join(stored.select(F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"),
                                      "role", "text"), ["ref_conv", "ref_place"])
    said = found.groupBy(*KEY).agg(F.min("role").alias("r0"), F.max("role").alias("r1"),
                                   F.min("text").alias("t0"), F.max("text").alias("t1"))
    return not said.filter("r0 <> r1 OR t0 <> t1").isEmpty()


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``conv_id``s, ascending, comma-joined.

    Ids are joined per stretch of ``2**CHUNK_BITS`` numbers first, which combines
    before the shuffle; then each node's pieces stream through one hash state,
    so a node of any size is hashed in bounded memory."""
    pieces = (ends.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("piece"))
              .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # all different
              .withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")))
    schema = _parse_datatype_string("depth long, f1 long, f2 long, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for *now, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            yield _rows(done, arrow)
        yield _rows([(*key, state.hexdigest())] if state else [], arrow)

    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
            .mapInArrow(run, schema))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)],
        schema=schema)


def prefix_rows(conversations: DataFrame, modulus: int = MODULUS,
                attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rebuilt rows, nodes, stored turns), all verified."""
    for attempt in range(attempts):
        stored, rows = _rebuilt(conversations, bases(attempt, modulus), modulus)
        ref = F.struct("ref_conv", "ref_place")
        nodes = staged(rows.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.max("words").alias("words"), F.sum(F.col("is_end").cast("long")).alias("n_ends"),
            F.min("p1").alias("p1_low"), F.max("p1").alias("p1_high"),
            F.min("p2").alias("p2_low"), F.max("p2").alias("p2_high"),
            F.min(ref).alias("ref_low"), F.max(ref).alias("ref_high")), "trie-nodes")
        if not _collides(nodes, rows, stored):
            nodes = nodes.select(*KEY, F.col("p1_low").alias("p1"), F.col("p2_low").alias("p2"), "conv_id",
                                 "n_convs", "words", "n_ends",
                                 F.col("ref_low").alias("last_turn"))
            return rows, nodes, stored
    raise FingerprintCollision(f"fingerprints modulo {modulus} collided {attempts} times")


def build(conversations: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """One row per node: its smallest member and depth, its parent's, the
    counts, the tokens that sharing saves in its subtree, the digest of the
    conversations that end there, and the reference to its last turn."""
    rows, nodes, _ = prefix_rows(conversations, modulus)
    own = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    # Along each chain (the nodes of one smallest member, by depth), from one running sum over all.
    own = staged(with_running_sums(own, [F.col("conv_id"), F.col("depth")], ["saved"])
                 .drop("total_saved"), "trie-chains")
    above = F.col("cum_saved") - F.col("saved")
    chains = own.groupBy("conv_id").agg(
        F.min(above).alias("start"), F.max("cum_saved").alias("upto"),
        F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaf"))
    chains = staged(chains.select("conv_id", "start", (F.col("upto") - F.col("start")).alias("chain_saved"),
                                  "leaf"), "trie-totals")
    members = rows.select("conv_id", *KEY).join(chains.drop("start"), "conv_id").groupBy(*KEY).agg(
        F.sum("chain_saved").alias("members_saved"), F.sum("leaf").alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"),
                           F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = reduce(lambda left, right: left.join(right, KEY, "left"),
                  [own.join(chains.select("conv_id", "start"), "conv_id"), members, children,
                   ends_digest(rows.filter("is_end").select("conv_id", *KEY))])
    return full.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("members_saved") - (above - F.col("start"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "last_turn")
