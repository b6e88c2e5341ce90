"""Merkle proofs against a plain tree over Python lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cargoscope.llm import merkle
from cargoscope.llm.common import crc_mod
from tests.conftest import SMOKE_DIR

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h("".join(row[i:i + 3])) for i in range(0, len(row), 3)])
    return levels


def climb(levels, place, digest):
    proof = ""
    for row in levels[:-1]:
        run, slot = row[place // 3 * 3:place // 3 * 3 + 3], place % 3
        proof += "".join(run[:slot] + run[slot + 1:])
        digest = h("".join(run[:slot] + [digest] + run[slot + 1:]))
        place //= 3
    return digest, proof


def changed(row):
    if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
        return (*row[:4], row[4].replace("\n", ""))
    return row


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(groups[s]):
            digest, low = climb(trees[s], i, plain_leaf(changed(row)))
            digest, high = climb(top, k, digest)
            out.append((row[0], plain_leaf(row), trees[s][-1][0], top[-1][0], h(low + high), digest,
                        digest == top[-1][0]))
    return out


def manifest(frame, **more):
    text = F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(frame, changes={"text": text}, **more)


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def made_rows(sizes, seed=3):
    rnd = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((rnd.randrange(10 ** 6), s, rnd.choice(["en", None]), rnd.choice([None, 5]),
                         rnd.choice([None, "", "a\nb", "é\n" * rnd.randrange(4), "plain"])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = made_rows({"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "Z": 10, None: 28, "": 5, "big": 130})
    got = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert key(got) == key(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_large_source_spans_blocks(spark):
    rows = made_rows({"hot": 2300, "b": 3})
    assert key(manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == key(plain_manifest(rows))


def test_many_sources_span_blocks(spark):
    rows = made_rows({f"s{i}": 1 for i in range(800)})
    assert key(manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == key(plain_manifest(rows))


def test_smoke_table(spark):
    frame = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select(*merkle.FIELDS)
    assert key(manifest(frame).collect()) == key(plain_manifest([tuple(r) for r in frame.collect()]))


@pytest.mark.parametrize("rows", [
    [(1, "a", "en", 1, "x\n")],
    [(0, None, None, None, None)],
    [(None, "a", "en", 1, "x\n"), (None, None, None, None, "\n")],
    [(4, "a", "en", 1, "x\ny")] * 5,
    [(7, "a", "en", 1, "x"), (7, "a", "en", 1, "y\n"), (-3, "a", None, 1, "z\n" * 200_000)],
])
def test_edge_rows(spark, rows):
    assert key(manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == key(plain_manifest(rows))


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_and_clashing_columns(spark):
    rows = made_rows({"a": 5})
    frame = (spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("mine"))
             .withColumn("place", F.col("n_chars")).withColumn("grp", F.lit("g")))
    got = manifest(frame, keep=["doc_id", "place", "grp", "root"])
    assert got.columns == ["doc_id", "place", "grp", *merkle.NEW]
    assert key(got.drop("place", "grp").collect()) == key(plain_manifest(rows))


def test_untouched_rows_verify(spark):
    got = merkle.manifest(spark.createDataFrame(made_rows({"a": 40, "b": 7}), SCHEMA)).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1


def test_resumed_state_hashes_only_what_is_right_of_the_slot(monkeypatch):
    run = merkle.Run([h("a"), h("b"), h("c")])
    assert run.replaced(1, h("x")) == h(h("a") + h("x") + h("c"))
    run.children = ["?" * 64, *run.children[1:]]  # left siblings are no longer read
    assert run.replaced(1, h("x")) == h(h("a") + h("x") + h("c"))
    assert run.replaced(2, h("y")) == h(h("a") + h("b") + h("y"))


def test_paths_survive_being_written():
    block = merkle.Block([h(str(i)) for i in range(14)], 3)
    steps = list(block.steps(13))
    again = merkle.decode_steps(merkle.encode_steps(steps))
    assert merkle.fold(h("x"), again) == merkle.fold(h("x"), steps)
    assert merkle.fold(h("13"), again) == block.top
    assert merkle.decode_steps("") == []
