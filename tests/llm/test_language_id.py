"""Language profiles against a plain dictionary version, and held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cargoscope.llm import language_id as li
from cargoscope.llm.queries import QUERIES
from tests.conftest import SMOKE_DIR

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").replace("Σ", "σ").lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if padded[i:i + n] != " ":
                    counts[padded[i:i + n]] += 1
    return counts


def code(gram):
    value = len(gram) << 60
    for i, ch in enumerate(reversed(gram)):
        value |= (0 if ch == " " else ord(ch)) << (20 * i)
    return value


def plain_top(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain_model(rows, size):
    langs = {}
    for text, lang in rows:
        langs.setdefault(lang, Counter()).update(plain_counts(text))
    return {k: {g: i for i, g in enumerate(plain_top(c, size))} for k, c in sorted(langs.items()) if c}


def plain_predict(text, model, size):
    ranked = plain_top(plain_counts(text), size)
    best = ("und", 0.0)
    if ranked and model:
        dist = {k: sum(abs(m[g] - i) if g in m else size for i, g in enumerate(ranked))
                for k, m in model.items()}
        lang = min(dist, key=lambda k: (dist[k], k))
        best = (lang, 1.0 - dist[lang] / (len(ranked) * size))
    return best


@pytest.mark.parametrize("text", ["", None, " 12 ", "a", "Ab ab,ab", "été Straße\nΣΑΣ x", "a" * 5, "a1b2 c_d",
                                  "東京 タワー", "İx ǅ"])
@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1 << 18])
def test_counts_equal_plain_counts(text, stretch, monkeypatch):
    monkeypatch.setattr(li, "STRETCH", stretch)
    codes, counts = li.ngram_counts(text)
    assert dict(zip(codes.tolist(), counts.tolist())) == {
        code(g): n for g, n in plain_counts(text).items()}


def test_letters_fit_the_code():
    assert int(li._letters().max()) < 1 << li._BITS


def test_top_breaks_ties_by_code():
    assert li.top(np.array([3, 5, 9]), np.array([2, 7, 2]), 2).tolist() == [5, 3]


def docs(spark):
    return spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")


def test_query_equals_plain_model(spark):
    rows = docs(spark).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    model = plain_model([(r.text, r.lang) for r in rows if not held[r.doc_id] and r.lang is not None],
                        li.PROFILE)
    want = {r.doc_id: (held[r.doc_id], *plain_predict(r.text, model, li.PROFILE)) for r in rows}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score)
           for r in QUERIES["op13_language_id"](spark, SMOKE_DIR).collect()}
    assert got == want


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in docs(spark).collect() if r.lang and len(r.text or "") > 40}
    got = [r for r in QUERIES["op13_language_id"](spark, SMOKE_DIR).collect()
           if r.held_out and r.doc_id in truth]
    assert len(got) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) >= 0.95


def test_a_pass_per_group_of_languages_gives_the_same(spark):
    frame = docs(spark).withColumnRenamed("source", "score")  # a clashing name gives way
    profiles = li.fit(docs(spark))
    one = li.predict(frame, profiles, keep=["doc_id", "score"])
    many = li.predict(frame, profiles, keep=["doc_id", "score"], at_once=1)
    assert one.columns == many.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_small_tables_hand_on_partial_counts(spark, monkeypatch):
    full = {tuple(r) for r in li.count_ngrams(docs(spark)).collect()}
    monkeypatch.setattr(li, "TABLE", 10)
    assert {tuple(r) for r in li.count_ngrams(docs(spark)).collect()} == full


def test_edge_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "12 !", "en", "s", 4),
            (4, "the cat and the hat", "en", "s", 1), (4, "the cat and the hat", "en", "s", 1),
            (5, "der Hund und die Katze", "de", "s", 1), (6, "the hat", None, "s", 1),
            (None, "und die", "de", None, None), (7, "x" * 300_000 + " die Katze" * 50_000, None, "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.lang_pred, r.score)
           for r in li.predict(frame, li.fit(frame), keep=["doc_id"]).collect()]
    pred = {(i, p) for i, p, _ in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "en"), (None, "de"), (7, "de")} == pred
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert all(s == 0.0 for _, p, s in got if p == "und")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "the cat", "en", "s", 7)], SCHEMA)
    assert li.predict(none, li.fit(some)).count() == 0
    assert [(r.lang_pred, r.score) for r in li.predict(some, li.fit(none)).collect()] == [("und", 0.0)]
