"""Decontamination against a brute-force window search."""

import hashlib
import random

import pytest

from cargoscope.llm import decontaminate as dec
from tests.conftest import SMOKE_DIR

DOCS = "doc_id long, text string, lang string, n_chars long"


def brute(text, items, window=10):
    words = dec.normalized_words(text)
    hit, found = set(), set()
    for name, item in items:
        own = dec.normalized_words(item)
        size = min(window, len(own))
        if not size:
            continue
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("null" if name is None else str(name))
    return len(words), hit, sorted(found)


def hit_words(spans):
    return {i for h in spans for i in range(h["start"], h["start"] + h["len"])}


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_brute_force(seed):
    rnd = random.Random(seed)
    vocab = "abc" if seed % 2 else "abcdefghij"
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 3, 5, 9, 30]))))
             for i in range(25)]
    for window in (3, 10):
        m = dec.Matcher([(str(n), dec.normalized_words(t), True) for n, t in items], window)
        for _ in range(60):
            text = " ".join(rnd.choices(vocab + "z", k=rnd.randrange(60)))
            spans, names = m.match(dec.normalized_words(text))
            _, hit, found = brute(text, items, window)
            assert {i for a, n, _ in spans for i in range(a, a + n)} == hit
            assert names == found


def edge_docs(spark):
    long = "q0 " * 30000
    rows = [(1, None, "en", None), (2, "", "en", 0), (3, "one two three", None, 13),
            (3, "one two three", None, 13), (4, long + "W1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11 end", "x", 9),
            (None, "short item", "en", 10), (5, "Été — naïve 東京 short ITEM tail", "fr", 3)]
    return spark.createDataFrame(rows, DOCS)


ITEMS = [(7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (8, "short item"), (9, None), (10, ""),
         (8, "short item"), (None, "naïve 東京")]


@pytest.mark.parametrize("block", [1_000_000, 11, 5])
def test_edge_rows_and_blocks(spark, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dec.find_hits(edge_docs(spark), bench, max_block_words=max(block, 11)).collect()
    assert len(out) == 7
    for r in out:
        n, hit, found = brute(r["text"], ITEMS)
        assert (r["n_words"], hit_words(r["hits"]), r["items"]) == (n, hit, found)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["hits"] for r in dec.find_hits(edge_docs(spark), bench).collect())
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dec.find_hits(edge_docs(spark).limit(0), some).count() == 0


def test_spans_leave_and_clean_rows_stay(spark):
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    docs = edge_docs(spark).selectExpr("*", "lang AS Hits")
    out = {(r["doc_id"], r["lang"]): r for r in dec.decontaminate(docs, bench).collect()}
    assert (None, "en") not in out  # two of two words are benchmark words
    assert out[(4, "x")]["text"].endswith("q0  end") and out[(4, "x")]["Hits"] == "x"
    assert out[(5, "fr")]["text"] == "Été — naïve 東京  tail"
    assert out[(5, "fr")]["n_chars"] == len("Été — naïve 東京  tail")
    assert out[(3, None)]["text"] == "one two three" and out[(1, "en")]["text"] is None


@pytest.mark.parametrize("block", [1_000_000, 13])
def test_nothing_is_left_after_cuts(spark, block):
    items = [(1, " ".join(f"a{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b = (t.split() for _, t in items)
    noise = " ".join(f"n{i}" for i in range(60))
    texts = [" ".join([noise, *a[:6], *b, *a[6:], noise]), noise, " ".join([*a, noise, *b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in dec.decontaminate(df, bench, max_block_words=block).collect()}
    assert out[1] == noise and len(out) == 3
    assert all(not brute(t, items)[1] for t in out.values())
    assert out[0].split() == (noise + " " + noise).split()


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E
    items = [tuple(r) for r in spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"]
             for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    for r in E.queries()["op7_decontaminate"](spark, SMOKE_DIR).collect():
        n, hit, found = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == bool(hit)
