"""Nearest-neighbour votes against brute force, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pytest

from cargoscope.llm import quality_knn as knn

SF_DIR = "/root/testdata/sf0.1"


def test_blocked_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    terms = np.stack([knn.term_counts(" ".join(rng.choice(["the", "a!", "xyz", "|", "Qu"], 30)))
                      for _ in range(90)])
    labels = (rng.random(90) < 0.3).astype(np.float32)
    model = knn.fit_terms(terms, labels, latent=8, neighbours=5)
    want = []
    for z in model.project(terms):
        sims = np.array([float(np.dot(z, v)) for v in model.vectors])
        top = np.argsort(-sims)[:5]
        weight = (np.maximum(sims[top], 0) ** model.power + 1e-9) * np.where(
            labels[top] == 1, 1 / labels.mean(), 1 / (1 - labels.mean()))
        want.append((weight * labels[top]).sum() / weight.sum())
    for block in (7, 32, 1000):
        got = model.scores(terms, block)
        assert np.mean(np.abs(got - want) < 1e-3) > 0.9  # equal cosines may pick either neighbour
        assert np.abs(got - model.scores(terms, 1000)).max() < 1 + 1e-9


def test_held_out_accuracy_and_contract(spark):
    import __spark_entry__ as E
    rows = E.queries()["op3_quality_knn"](spark, SF_DIR).collect()
    truth = {r["doc_id"]: r["quality"]
             for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    good, bad = [], []
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            (good if truth[r["doc_id"]] else bad).append(r["score"])
    good, bad = np.array(good), np.array(bad)
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.99 and (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.9


TEXTS = [None, "", " ", "the cat sat on the mat and looked around", "x | y | z | w |" * 30,
         "the cat sat on the mat and looked around", "long text " * 30000]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "a b", None)],
                                 "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, None), (None, 1), (99, 1)],
                                   "doc_id long, quality int")
    model = knn.fit(docs, labels)
    assert len(model.labels) == 2
    out = knn.score(docs, model)
    assert [c.lower() for c in out.columns].count("score") == 1
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(got) == 8 and all(0 <= s <= 1 for s in got.values())
    assert got[3] == got[5] > 0.5 > got[4] and got[0] == got[1]
    none = knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in knn.score(docs, none).collect()} == {0.5}
    assert knn.score(docs.limit(0), model).count() == 0


def test_bound_on_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"words {i} here") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) AS quality")
    a, b = (knn.fit(docs.repartition(n), labels.repartition(n), per_class=6) for n in (1, 5))
    assert sorted(a.labels) == [0] * 6 + [1] * 6
    assert a.vectors == pytest.approx(b.vectors, abs=1e-4)
