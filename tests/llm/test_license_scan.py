"""Licence scans against all passages of small texts; edge rows."""

import random

import pytest

from cargoscope.llm import license_scan as ls
from cargoscope.llm.decontaminate import normalized_words
from cargoscope.llm.license_templates import TEXTS, templates
from tests.conftest import SMOKE_DIR


def brute(text, pairs, threshold):
    """Best Dice of any passage with each template, where it reaches the threshold."""
    grams = ls.bigrams(normalized_words(text))
    out = {}
    for k, (_, template) in enumerate(pairs):
        own = set(ls.bigrams(normalized_words(template)))
        best = max((2 * len(own & set(grams[i:j])) / (len(own) + len(set(grams[i:j])))
                    for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)), default=0)
        if best >= threshold:
            out[k] = best
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_passage_equals_brute_force(seed):
    rnd = random.Random(seed)
    pairs = [(f"L{i}", " ".join(rnd.choices("abcdef", k=rnd.choice([2, 3, 5, 9])))) for i in range(8)]
    for threshold in (0.6, 0.8, 1.0):
        index = ls.Index(pairs, threshold)
        for _ in range(40):
            text = " ".join(rnd.choices("abcdefgz", k=rnd.randrange(40)))
            got = {}
            for _, _, _, k, dice in index.passages(normalized_words(text)):
                got[k] = max(dice, got.get(k, 0))
            assert got == pytest.approx(brute(text, pairs, threshold))


@pytest.mark.parametrize("seed", range(3))
def test_skipping_chooses_as_without(seed):
    rnd = random.Random(seed)
    pairs = [(f"L{i}", " ".join(rnd.choices("abcd", k=rnd.choice([2, 3, 4, 6])))) for i in range(6)]
    index = ls.Index(pairs, 0.8)
    full = ls.Index(pairs, 0.8)
    full.passages = lambda words, skip: ls.Index.passages(full, words, False)
    for _ in range(60):
        text = " ".join(rnd.choice([rnd.choice("abcdz"), rnd.choice(pairs)[1]]) for _ in range(30))
        words = normalized_words(text)
        got, want = index.match(words), full.match(words)
        assert got == want
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("edit", [("xyzzy", "xyzzy"), ("Software", "Work")])
def test_many_copies_in_linear_time(edit):
    """1,000 copies in one text, as they are and each edited, all found."""
    import time
    copy = TEXTS["MIT"].replace(*edit)
    index = ls.Index(templates())
    words = normalized_words((copy + "\nzz\n") * 1000)
    start = time.process_time()
    found = index.match(words)
    assert [index.ids[k] for _, _, k, _ in found] == ["MIT"] * 1000
    assert time.process_time() - start < (4 if edit[0] == "xyzzy" else 40)


def test_texts_notices_and_edits():
    index = ls.Index(templates())
    ids = lambda t: [index.ids[k] for _, _, k, _ in index.match(normalized_words(t))]
    for name, text in templates():
        got = ids("Some words before.\n" + text + "\nand after it")
        assert got == [name], (name, got)
    assert ids("/* " + TEXTS["MIT"].replace("Software", "Work", 3).replace(". ", ".\n * ")) == ["MIT"]
    assert ids("see the license of the software and the terms of use, version 3") == []
    assert ids("Released under the MIT Licence. x y z Licensed under CC BY-NC 4.0.") == [
        "MIT", "CC-BY-NC-4.0"]


def test_rows(spark):
    texts = [None, "", "one", "Released under the MIT License.", "Released under the MIT License.",
             "of the " * 30000 + "é Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, LICENSES string")
    out = {r["doc_id"]: r for r in ls.find_licenses(df).collect()}
    assert [len(out[i]["licenses"]) for i in range(6)] == [0, 0, 0, 1, 1, 1]
    last = out[5]["licenses"][0]
    assert texts[5][last["start"]:last["end"]] == "Licensed under CC BY-NC 4.0"
    assert ls.find_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ls.Index([("X", "one")])


def test_query(spark):
    import __spark_entry__ as E
    index = ls.Index(templates())
    texts = {r["doc_id"]: r["text"]
             for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    rows = E.queries()["op1_license_scan"](spark, SMOKE_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = index.match(normalized_words(texts[r["doc_id"]]))
        assert r["licenses"] == ",".join(sorted({index.ids[k] for _, _, k, _ in found}))
        assert r["n_passages"] == len(found)
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in rows:
        for line, name in lines.items():
            if line in (texts[r["doc_id"]] or ""):
                assert name in r["licenses"].split(",")
