"""Katz back-off against a dictionary version of the same formulas."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoscope.llm import katz
from tests.conftest import SMOKE_DIR

START, END, UNKNOWN = ("<s>",), ("</s>",), ("<unk>",)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*low.encode().split(), END]


class Plain:
    """Counts, discounts and weights in dictionaries."""

    def __init__(self, texts):
        self.c1, self.c2, self.next = Counter(), Counter(), defaultdict(set)
        for t in texts:
            for h, w in zip([START, *tokens(t)], tokens(t)):
                self.c1[w] += 1
                self.c2[h, w] += 1
                self.next[h].add(w)
        self.n = sum(self.c1.values())
        self.history = Counter({h: sum(self.c2[h, w] for w in ws) for h, ws in self.next.items()})
        self.d1, self.d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)])
                            for c in (self.c1, self.c2))
        self.unknown = (sum(self.d1[min(c, 6)] for c in self.c1.values()) / self.n
                        if self.n else 1.0)

    def p1(self, w):
        c = self.c1[w]
        return (c - self.d1[min(c, 6)]) / self.n if c else self.unknown

    def p(self, w, h):
        r = self.c2[h, w]
        if r:
            return (r - self.d2[min(r, 6)]) / self.history[h]
        if not self.history[h]:
            return self.p1(w)
        return self.alpha(h) * self.p1(w)

    def alpha(self, h):
        seen = sum((self.c2[h, w] - self.d2[min(self.c2[h, w], 6)]) / self.history[h]
                   for w in self.next[h])
        return (1 - seen) / (1 - sum(self.p1(w) for w in self.next[h]))

    def score(self, text):
        ws = tokens(text)
        return sum(math.log10(self.p(w, h)) for h, w in zip([START, *ws], ws))

    def row(self, text):
        ws = tokens(text)
        return (len(ws), sum(self.c1[w] > 0 for w in ws), self.n,
                sum(math.log10((self.c1[w] + 1) / (self.n + len(self.c1) + 1)) for w in ws),
                self.score(text))


def corpus(seed, n=80):
    rnd = random.Random(seed)
    words = ["the", "of", "A", "b", "Cé", "d\x1ce", *[f"w{i}" for i in range(40)]]
    weight = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rnd.choices(words, weight, k=rnd.randrange(30))) for _ in range(n)] + [
        None, "", " ", "new words only", "the of " * 20000]


def test_model_sums_to_one():
    for seed in range(3):
        m = Plain(corpus(seed)[:-1])
        events = [*m.c1, UNKNOWN]
        for h in [START, UNKNOWN, *m.history]:
            assert sum(m.p(w, h) for w in events) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("shard_tokens", [50, 700, 10**6])
def test_scores_equal_plain_model(spark, shard_tokens):
    texts = corpus(1)
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, shard string, Train int").repartition(3)
    train = F.col("doc_id") % 4 != 1
    got = katz.fit_and_score(df, train, shard_tokens=shard_tokens)
    m = Plain([t for i, t in enumerate(texts) if i % 4 != 1])
    rows = got.scores.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        assert list(r)[1:] == pytest.approx(m.row(texts[r["doc_id"]]), rel=1e-9)
    stored = Counter()
    for r in got.counts.collect():
        values = katz.unpack(r["counts"], np.int64)
        assert len(values) == len(katz.unpack_sorted(r["keys"]))
        stored[r["level"]] += int(values.sum())
    assert stored == {0: m.n, 1: sum(m.c2.values())}
    weights = np.concatenate([katz.unpack(r["weights"], np.float64) for r in got.backoff.collect()])
    assert sorted(10**weights) == pytest.approx(sorted(m.alpha(h) for h in m.history))


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "a b")], schema)
    none = katz.fit_and_score(df, F.lit(False)).scores.collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in none] == [
        (0, 0, 0, 0)] * 4
    null = katz.fit_and_score(df, F.lit(None).cast("boolean")).scores.collect()
    assert [r["score"] for r in null] == [0] * 4
    m = Plain(["a b", "a b", "a b"])
    some = katz.fit_and_score(df, F.col("doc_id").isNotNull()).scores.collect()
    for r in some:
        assert list(r)[1:] == pytest.approx(m.row("a b" if r["doc_id"] else None))
    assert katz.fit_and_score(df.limit(0), F.lit(True)).scores.count() == 0


def test_discounts():
    of = [1000, 400, 220, 140, 95, 70]
    d = katz.discounts(of)
    lost = sum(n * x for n, x in zip(of, d[1:6]))
    assert lost == pytest.approx(of[0]) and (d[1:6] > 0).all() and (d[1:6] < range(1, 6)).all()
    assert (katz.discounts([3, 0, 1, 0, 0, 9])[1:6] == 0.5).all()


# n_1 .. n_6 of the training rows of sf0.1 (words, pairs): copies raise n_5
COPIES = ([207344, 59772, 25017, 14274, 13493, 7080],
          [1579638, 246704, 51653, 21705, 18939, 7580])


def test_copies_keep_good_turing():
    for of in COPIES:
        assert 5 * of[4] > 4 * of[3]  # unsmoothed, r = 4 would gain
        d = katz.discounts(of)
        assert (d[1:6] == katz.turing(of)).all() and len(set(d[1:6])) == 5
        assert (d[1:6] > 0).all() and (d[1:6] < range(1, 6)).all()
        assert sum(n * x for n, x in zip(of, d[1:6])) == pytest.approx(of[0])
        b = katz.slope(of)
        kept = [(1 + 1 / r) ** (b + 1) for r in range(1, 6)]  # r* / r on the line
        lost = [1 - x / r for r, x in zip(range(1, 6), r_star(d))]
        assert [x / lost[0] for x in lost] == pytest.approx([(1 - x) / (1 - kept[0]) for x in kept])
    assert katz.turing([3, 0, 1, 0, 0, 9]) is None and katz.turing([5, 0, 0, 0, 0, 0]) is None


def r_star(d):
    return [r - d[r] for r in range(1, 6)]


def test_table_with_copies_takes_good_turing(spark):
    texts = [t for i, t in enumerate(corpus(4)[:-1]) for _ in range(5 if i % 4 == 0 else 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = katz.fit_and_score(df, F.lit(True), shard_tokens=300)
    m = Plain(texts)
    of = [sum(v == r for v in m.c2.values()) for r in range(1, 7)]
    assert 5 * of[4] > 4 * of[3]  # copies: unsmoothed, r = 4 would gain
    assert (got.totals.bigram[1:6] == katz.turing(of)).all()
    for r in got.scores.collect():
        assert r["score"] == pytest.approx(m.score(texts[r["doc_id"]]), rel=1e-9)


def test_query_equals_plain_model(spark):
    import __spark_entry__ as E
    texts = {r["doc_id"]: r["text"]
             for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    m = Plain([t for d, t in texts.items() if not held[d]])
    rows = E.queries()["op5_katz"](spark, SMOKE_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == held[r["doc_id"]]
        got = [r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
        assert got == pytest.approx(m.row(texts[r["doc_id"]]), rel=1e-9)
    # the model predicts held-out texts better than its base does
    assert sum(r["score"] - r["base_score"] for r in rows if r["held_out"]) > 0
