"""Mixing: targets, exact quotas, nearness, disjoint draws."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from cargoscope.llm import mixing
from tests.conftest import SMOKE_DIR


def plain_targets(sizes, weights, cap=3):
    """Share by weight; fix what is above its cap; share the rest again."""
    fixed = {}
    while True:
        left = sum(sizes) - sum(fixed.values())
        rest = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = [i for i in rest if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed.update({i: cap * sizes[i] for i in over})


@pytest.mark.parametrize("sizes", [[5], [0, 10], [1, 1, 1000], [100, 3, 7, 9, 0, 50], [0, 0]])
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes))
    if sum(sizes):
        assert got == pytest.approx(plain_targets(sizes, weights))


def test_leaf_quotas_are_exact_disjoint_and_independent_of_tasks():
    quotas = np.array([40, 0, 7, 93], dtype=np.int64)
    whole = list(mixing.leaf_quotas(quotas, 11, 0, 11, 5))
    assert [s for s, *_ in whole] == list(range(11))
    at = np.zeros_like(quotas)
    for _, start, counts in whole:
        assert (start == at).all() and counts.sum() in (12, 13)
        at = at + counts
    assert (at == quotas).all()
    parts = [x for lo in range(0, 11, 3) for x in mixing.leaf_quotas(quotas, 11, lo, min(11, lo + 3), 5)]
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(whole, parts))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _u string, Size int")


ROWS = ([(i, "w " * (1 + i % 40), f"s{i % 3 if i % 7 else 0}", "x", 1) for i in range(600)]
        + [(1000 + i, "v " * 10, None, "x", 1) for i in range(5)]
        + [(2000, None, "empty", None, None), (2001, "", "empty", None, None)]
        + [(5, "w " * 6, "s2", "x", 1)] * 3 + [(3000, "z " * 30000, "long", "x", 1)])


def check(rows, size_of, near):
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["size"]
    taken = Counter()
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([by[s] for s in order],
                                         [1 + i % 3 for i in range(len(order))])))
    for r in rows:
        assert r["size"] == size_of(r) and r["source_size"] == by[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in order:
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= near(largest), s


def test_rows_sources_and_reruns(spark):
    df = make(spark, ROWS)
    out = mixing.mix(df, block_words=200, blocks_per_shard=8)
    assert [c.lower() for c in out.columns].count("size") == 1
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert all(r["_u"] == ("x" if r["source"] != "empty" else None) for r in rows)
    check([r for r in rows], lambda r: len((r["text"] or "").split()), lambda big: 4 * big)
    again = mixing.mix(df.repartition(5), block_words=200, blocks_per_shard=8).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    for r in rows:
        assert r["copies"] == len(r["draws"]) == len({d["pass"] for d in r["draws"]})
    assert len({d["shard"] for r in rows for d in r["draws"]}) > 10
    assert mixing.mix(df.limit(0)).count() == 0


def test_shuffled_write(spark, scratch):
    mixed = mixing.mix(make(spark, ROWS), block_words=200, blocks_per_shard=8,
                       keep=["doc_id", "source"])
    mixing.write_mix(mixed, f"{scratch}/mix")
    rows = spark.read.parquet(f"{scratch}/mix").collect()
    assert len(rows) == sum(r["copies"] for r in mixed.collect())
    one = [r["source"] for r in rows if r["shard"] == rows[0]["shard"]]
    assert one != sorted(one, key=str)


def test_query(spark):
    import __spark_entry__ as E
    docs = {r["doc_id"]: r
            for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    rows = E.queries()["op10_mixing"](spark, SMOKE_DIR).collect()
    assert len(rows) == len(docs)
    check([{**r.asDict(), "source": docs[r["doc_id"]]["source"],
            "copies": r["taken"] // r["size"] if r["size"] else 0} for r in rows],
          lambda r: len(docs[r["doc_id"]]["text"].split()), lambda big: big / 2 + 1)
