"""The prefix trie against one built from rebuilt lists of turns."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cargoscope.llm import conversation_trie as trie
from tests.conftest import SMOKE_DIR

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # SQL's remainder
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append((c, len(full)))
    nodes = {}
    for path in sorted(members, key=len, reverse=True):
        ids = sorted(c for c, _ in members[path])
        ends = sorted(c for c, n in members[path] if n == len(path))
        kids = [n for n in nodes if len(n) == len(path) + 1 and n[:-1] == path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        nodes[path] = {
            "conv_id": ids[0], "depth": len(path), "n_convs": len(ids), "n_children": len(kids),
            "n_leaves": sum(nodes[k]["n_leaves"] for k in kids) or 1,
            "saved_tokens": (len(ids) - 1) * words + sum(nodes[k]["saved_tokens"] for k in kids),
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()}
    return [dict(v, parent_conv_id=nodes[p[:-1]]["conv_id"] if p else None) for p, v in nodes.items()]


def built(frame, **more):
    return trie.build(frame, **more).drop("last_turn")


def same(frame, rows):
    got = [r.asDict() for r in built(frame).collect()]
    return sorted(got, key=repr) == sorted(
        [{k: w[k] for k in got[0]} if got else w for w in plain_trie(rows)], key=repr)


def made(seed, convs, turns, texts):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 3 * convs), convs):
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "assistant", None]),
                         rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_trie(spark, seed):
    rows = made(seed, 60, 6, ["a b c", "a", "", None, "x\ty  z\n"])
    assert same(spark.createDataFrame(rows, SCHEMA), rows)


def test_smoke_table(spark):
    frame = spark.read.parquet(f"{SMOKE_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert same(frame, [tuple(r) for r in frame.collect()])


def test_one_long_conversation_spans_partitions(spark):
    """Half of all turns are one conversation's and a copy's: prefixes compose
    over tasks, and chains over the tasks of the running sum."""
    rows = [(c, t, "user", f"turn {t % 7} of many") for c in (40, 41, 47) for t in range(400)]
    rows += made(9, 30, 5, ["a", "b c"])
    assert same(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"t{t} w") for c in range(0, 300) for t in range(5)]
    assert same(spark.createDataFrame(rows, SCHEMA), rows)


def test_ends_of_a_large_node_go_through_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-50, 150)]
    assert same(spark.createDataFrame(rows, SCHEMA), rows)


@pytest.mark.parametrize("rows", [
    [(3, None, None, None)],
    [(1, 0, "u", "own only")],  # crc32("1") % 4 is 3: a turnless rebuilt conversation
    [(1, 0, "u", "a"), (1, 1, "u", "b"), (1, 2, "u", "c"), (1, 3, "u", "d")],  # no base
    [(0, 0, "u", "base"), (1, 0, "u", "a"), (1, 1, "u", "b"), (1, 2, "u", "c"), (1, 3, "u", "d")],
    [(5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "w"), (5, None, "z", "z"), (5, 1, "a", "w")],
    [(None, 0, "u", "nobody's"), (2, 0, "u", "x " * 100_000)],
    [(-20, 0, "u", "a"), (-21, 0, "u", "b"), (-3, 0, "u", "c"), (0, 0, "u", "d")] * 3,
    [(7, 0, "ab", "c"), (7, 1, "x", "y"), (7, 2, "x", "y"), (7, 3, "ab", "c"), (8, 0, "a", "bc"),
     (8, 1, "x", "y"), (8, 2, "x", "y"), (8, 3, "a", "bc")],
])
def test_edge_rows(spark, rows):
    assert same(spark.createDataFrame(rows, SCHEMA), rows)


def test_empty_table(spark):
    assert built(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_and_clashing_columns(spark):
    rows = made(4, 10, 4, ["a", "b"])
    frame = (spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(9)).withColumn("pid", F.lit(1))
             .withColumn("place", F.lit("x")).withColumn("words", F.lit(2)))
    assert same(frame, rows)


def test_last_turn_refers_to_a_stored_turn(spark):
    rows = made(6, 40, 5, ["a", "b c", "d"])
    frame = spark.createDataFrame(rows, SCHEMA)
    _, nodes, stored = trie.prefix_rows(frame)
    texts = {(r.conv_id, r.place): r.text for r in stored.collect()}
    for r in nodes.collect():
        if r.depth:
            assert len(texts[tuple(r.last_turn)].split()) == r.words


def test_collisions_are_found(spark):
    """Modulo 5 fingerprints collide under any bases: nothing wrong is returned."""
    frame = spark.createDataFrame([(c, 0, "u", f"text {c}") for c in range(0, 2000, 20)], SCHEMA)
    with pytest.raises(trie.FingerprintCollision):
        trie.build(frame, modulus=5)


def test_a_collision_draws_new_bases(spark, monkeypatch):
    rows = made(2, 25, 5, ["a", "b c", ""])
    frame = spark.createDataFrame(rows, SCHEMA)
    good = trie.bases
    # With base 0 every prefix looks like its first turn, so parents differ within a node.
    monkeypatch.setattr(trie, "bases", lambda k, m=trie.MODULUS: (m - 1, m - 1) if k == 0 else good(k, m))
    assert same(frame, rows)
