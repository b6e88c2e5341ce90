"""Near-duplicates against all pairs of small tables; sketches; edge rows."""

import random

import numpy as np
import pytest

from cargoscope.llm import near_dup as nd
from tests.conftest import SMOKE_DIR


def plain_set(text, size):
    words = bytes(text or "", "utf-8").translate(nd._LOWER).split()
    return ({tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
            if len(words) >= size else {tuple(words)} if words else set())


def brute(rows, size, percent=80):
    """doc_id -> (set size, least reachable id), over every pair."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    near = {(i, j) for at in by.values() if len(at) > 1 for i in at for j in at if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def planted(seed):
    """Copies, edited copies, chains of edits and texts that share passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 120]))]
        out.append(base)
        for _ in range(rnd.randrange(6)):
            base = list(base)
            for _ in range(rnd.randrange(4)):
                base[rnd.randrange(len(base))] = word()
            out.append(base)
    out += [passage + [word() for _ in range(rnd.randrange(4, 40))] for _ in range(60)]
    ids = rnd.sample(range(10_000), len(out))
    return [(i, " ".join(w)) for i, w in zip(ids, out)]


def result(df):
    return sorted(((r[0], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 5)])
def test_components_equal_all_pairs(spark, seed, size, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(nd.near_duplicates(df, size)) == sorted(brute(rows, size), key=str)


EDGE = [(None, "same words here for both of them"), (4, "same words here for both of them"),
        (4, "same words here for both of them"), (2, "SAME words\there for both of them"),
        (9, None), (8, ""), (7, " \n "), (6, "short"), (5, "Short"), (3, "É one"), (None, "only null"),
        (11, "w" + " w" * 40000), (12, "w w w w w w w")]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in EDGE], "doc_id long, text string, FP string")
    assert result(nd.near_duplicates(df, 5)) == sorted(brute_alone(EDGE, 5), key=str)
    assert nd.near_duplicates(df.limit(0), 5).count() == 0
    kept = nd.deduplicate(df, 5)
    assert kept.columns == df.columns
    twice = spark.createDataFrame([(20, "q w e r t y u", "a"), (20, "q w e r t y u", "b"), (20, "z x", "c"),
                                   (21, None, "d"), (21, None, "d")], df.schema)
    assert sorted(r["text"] or "-" for r in nd.deduplicate(twice, 5).collect()) == [
        "-", "-", "q w e r t y u", "z x"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 5, 7, 8, 9, 11]


def test_links_through_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (5, " ".join(["x", *base[1:]])), (None, "a b c d e f g"),
            (None, " ".join([*base[:-1], "y"])), (3, " ".join(["z", "q", *base[2:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, 5)) == sorted(brute(rows, 5), key=str)


def brute_alone(rows, size):
    return [(d, n, d if n == 0 else c) for d, n, c in brute(rows, size)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 5000):
        assert nd.sketch(rng.integers(0, 2**63, n, dtype=np.uint64)).max() < np.iinfo(np.uint64).max
    errors = []
    for _ in range(150):
        both, x, y = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (400, 50, 50))
        a, b = (nd.sketch(np.unique(np.concatenate([both, z]))) for z in (x, y))
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.16


def test_query_equals_all_pairs(spark):
    import __spark_entry__ as E
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()]
    got = E.queries()["op2_near_dup"](spark, SMOKE_DIR)
    assert result(got) == sorted(brute_alone(rows, 4), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
