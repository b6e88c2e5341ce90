"""The pipeline, stage by stage, against plain versions on the small tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from cargoscope.llm import quality_knn, secrets
from cargoscope.llm.common import crc_mod, staged, tables
from tests.conftest import SMOKE_DIR
from tests.llm.test_decontaminate import brute
from tests.llm.test_mixing import check, plain_targets
from tests.llm.test_near_dup import brute_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after every stage."""
    docs = tables(spark, SMOKE_DIR, "documents")
    out = {}
    for name, stage in cp.STAGES:
        after = staged(stage(spark, docs, SMOKE_DIR), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert [n for n, _ in cp.STAGES] == list(steps) and cp.ORACLE_SQL is None
    for _, after in list(steps.values())[:-1]:
        assert after.columns == COLUMNS


def test_quality(spark, steps):
    before, after = map(rows, steps["quality"])
    model = quality_knn.fit(steps["quality"][0], tables(spark, SMOKE_DIR, "labels"),
                            use=crc_mod("doc_id", 5) != 0)
    scores = {d: model.scores(np.stack([quality_knn.term_counts(r["text"])]))[0]
              for d, r in before.items()}
    assert set(after) == {d for d, s in scores.items() if s >= cp.QUALITY_FROM}
    assert all(after[d] == before[d] for d in after)
    good = {r["doc_id"] for r in tables(spark, SMOKE_DIR, "labels").filter("quality = 1").collect()}
    assert len(good & set(after)) >= 0.98 * len(good & set(before))


def test_near_dedup(steps):
    before, after = map(rows, steps["near_dedup"])
    found = brute_alone([(d, r["text"]) for d, r in before.items()], 5)
    assert set(after) == {d for d, _, c in found if d == c}
    assert all(after[d] == before[d] for d in after)


def test_decontaminate(spark, steps):
    before, after = map(rows, steps["decontaminate"])
    items = [tuple(r) for r in tables(spark, SMOKE_DIR, "benchmark").collect()]
    for d, r in before.items():
        n, hit, _ = brute(r["text"], items)
        if not hit:
            assert after[d] == r
        elif len(hit) > 0.5 * n:
            assert d not in after
        else:
            assert not brute(after[d]["text"], items)[1]
            assert after[d]["n_chars"] == len(after[d]["text"])


def test_secrets(steps):
    before, after = map(rows, steps["secrets"])
    assert set(before) == set(after)
    for d, r in after.items():
        assert secrets.all_spans(r["text"]) == []
        if not secrets.all_spans(before[d]["text"]):
            assert r == before[d]


def test_mixing(steps):
    before, after = steps["mixing"][0].collect(), steps["mixing"][1]
    assert after.columns == [*COLUMNS, "shard", "copy", "order_key"]
    copies = Counter(r["doc_id"] for r in after.collect())
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    total = Counter()
    for r in before:
        total[r["source"]] += size[r["doc_id"]]
    order = sorted(total)
    want = dict(zip(order, plain_targets([total[s] for s in order],
                                         [1 + i % 3 for i in range(len(order))])))
    check([{"doc_id": r["doc_id"], "source": r["source"], "size": size[r["doc_id"]],
            "source_size": total[r["source"]], "target": want[r["source"]],
            "copies": copies[r["doc_id"]]} for r in before],
          lambda r: size[r["doc_id"]], lambda big: big / 2 + 1)


EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30000, "en", "a", 1),
        (3, "word " * 30000, "en", "a", 1), (None, "some words here", "en", None, 15),
        (None, "some words here", "en", "b", 15), (4, 'token = "abcdef123"', "en", "b", 19)]


def test_edge_rows_through_all_stages(spark):
    docs = spark.createDataFrame([(*r, "x", True) for r in EDGE],
                                 "doc_id long, text string, lang string, source string, "
                                 "n_chars long, hits string, __row boolean")
    for rows_in in (docs, docs.limit(0)):
        now = rows_in
        for name, stage in cp.STAGES:
            now = staged(stage(spark, now, SMOKE_DIR), "edge")
            assert now.columns[:7] == docs.columns
    assert now.count() == 0


def test_run(spark, steps):
    import __spark_entry__ as E
    got = E.queries()["pipeline"](spark, SMOKE_DIR).collect()
    assert Counter(map(str, got)) == Counter(map(str, steps["mixing"][1].collect()))
