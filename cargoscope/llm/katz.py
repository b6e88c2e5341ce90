"""Language-model scoring: Katz back-off over bigrams and unigrams.

Counts come from the training rows, discounts from Good-Turing over smoothed
counts of counts (a line through log n_r), back-off weights from exact sums over each history's continuations.
A token costs::

    P(w | h) = r* / c(h)          if r = c(h w) > 0
             = alpha(h) P(w)      if c(h) > 0
             = P(w)               otherwise
    P(w)     = r* / N             if r = c(w) > 0, else the unknown class's mass

with r* the discounted count. alpha(h) is the mass that h's continuations
lose over the unigram mass outside them, so P(. | h) sums to one over the
vocabulary and the unknown class, which every unseen word belongs to. A text
starts after a start symbol (a history only) and ends with an end token.

How it scales. Texts are packed once into shards of about ``SHARD_TOKENS``
tokens (a table). A shard counts its own distinct words and pairs first, so a
word or pair weighs as much as the shards that hold it, however often it
occurs. Each shard's counts go out in packed stretches by hash bucket; a
bucket adds them up, stores its part of the count tables, and answers each
shard with the totals. Continuation sums and back-off weights travel the same
way. No group holds more than a bucket's share of distinct n-grams, and
nothing but counts of counts reaches the driver. Hashes of words have 64
bits, keys of n-grams 56.

Edge cases: null and empty texts are one end token; rows that do not train
are only scored; without training rows every word is unknown (probability 1);
repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from cargoscope.llm.common import staged

SHARD_TOKENS = 1_500_000
K = 5  # counts up to K are discounted by Good-Turing
ABOVE = 0.001  # what counts above K lose, so that every history keeps some mass
UNIGRAM, BIGRAM = 0, 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END, _START = (np.uint64(xxhash.xxh3_64_intdigest(b" " + x)) for x in (b"end", b"start"))
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                                          0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their gaps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, and of the end token."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    digest = xxhash.xxh3_64_intdigest
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = [digest(w) for w in words]
    out[-1] = _END
    return out


# ------------------------------------------------------------------ shards

def shards_of(docs: DataFrame, train: Column, id_col: str, text_col: str,
              shard_tokens: int) -> DataFrame:
    """One row per shard: ids, token counts and training flags of its texts,
    its vocabulary (hashes, commonest first) and its tokens (places in it)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"),
                         F.coalesce(train, F.lit(False)).alias("train"),
                         F.col(f"`{text_col}`").alias("text"))
    schema = StructType([StructField("ids", ArrayType(source.schema["id"].dataType)),
                         *_parse_datatype_string("shard long, sizes array<int>, "
                                                 "trains array<boolean>, vocab binary, "
                                                 "tokens binary").fields])
    arrow = to_arrow_schema(schema)

    def emit(ids, trains, texts, n) -> pa.RecordBatch:
        hashes, inverse, counts = np.unique(np.concatenate(texts), return_inverse=True,
                                            return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        shard = (TaskContext.get().partitionId() << 32) + n
        values = [ids, shard, [len(t) for t in texts], trains, pack(hashes[order]),
                  pack(rank[inverse])]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]):
        ids, trains, texts, size, n = [], [], [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                trains.append(batch.column(1)[i].as_py())
                texts.append(word_hashes(batch.column(2)[i].as_py()))
                size += len(texts[-1])
                if size >= shard_tokens:
                    yield emit(ids, trains, texts, n)
                    ids, trains, texts, size, n = [], [], [], 0, n + 1
        if texts:
            yield emit(ids, trains, texts, n)

    return staged(source.mapInArrow(run, schema), "katz-shards")


class Shard:
    """A shard's arrays, and its distinct n-grams in key order."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.trains = np.array(row["trains"], dtype=bool)
        self.vocab = unpack(row["vocab"], np.uint64)
        self.words = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.start = len(self.vocab)  # the start symbol's place
        self.before = np.empty_like(self.words)
        self.before[1:] = self.words[:-1]
        self.before[self.starts] = self.start
        self.history_keys = _mix(np.append(self.vocab, _START)) >> np.uint64(8)
        self.taught = np.repeat(self.trains, self.sizes)
        # pairs: codes of (history, word), their training counts, keys and key order
        code = self.before * (self.start + 1) + self.words
        both = np.sort(code * 2 + ~self.taught)
        at = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        self.pairs = both[at] >> 1
        self.pair_counts = np.add.reduceat(1 - (both & 1), at)
        self.code = code
        self.history, self.word = np.divmod(self.pairs, self.start + 1)
        hashes = np.append(self.vocab, _START)
        self.pair_keys = _mix(_mix(hashes[self.history]) * _STEP + hashes[self.word]) >> np.uint64(8)
        self.word_counts = np.bincount(self.words[self.taught], minlength=self.start)

    def keys(self, level: int) -> np.ndarray:
        return self.pair_keys if level == BIGRAM else self.history_keys[:-1]


def stretches(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in key order) for each bucket that has keys."""
    order = np.argsort(keys)
    bucket = ((keys[order] >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int((int(keys[places[0]]) >> 24) * buckets >> 32), places


def _rows(schema: str):
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def make(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
    return make


# ------------------------------------------------------------------ counts

_REQUEST = "level int, bucket int, shard long, keys binary, counts binary"
_REPLY = ("kind string, level int, bucket int, shard long, keys binary, counts binary, "
          "stats array<long>")


def _requests(shards: DataFrame, buckets: int) -> DataFrame:
    make = _rows(_REQUEST)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                for level, counts in ((UNIGRAM, s.word_counts), (BIGRAM, s.pair_counts)):
                    keys = s.keys(level)
                    out = [(level, b, row["shard"], pack_sorted(keys[p]),
                            pack(counts[p].astype(np.uint32)))
                           for b, p in stretches(keys, buckets)]
                    if out:
                        yield make(out)

    return shards.mapInArrow(run, _REQUEST)


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's n-grams: its part of the count table, the answer
    to each shard (total, and a top bit where the shard is to stand for the
    n-gram in sums over types) and the counts of counts."""
    level, bucket = int(pdf["level"].iloc[0]), int(pdf["bucket"].iloc[0])
    pdf = pdf.sort_values("shard")
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    counts = np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]).astype(np.int64)
    distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(group, weights=counts).astype(np.int64)
    taught = np.flatnonzero(counts)
    stands = np.zeros(len(counts), dtype=np.uint32)
    stands[taught[np.unique(group[taught], return_index=True)[1]]] = 1
    answer = np.minimum(total, (1 << 31) - 1).astype(np.uint32)[group] | (stands << np.uint32(31))
    some = total > 0
    of = np.bincount(np.minimum(total[some], K + 2), minlength=K + 3)
    rows = [("counts", level, bucket, None, pack_sorted(distinct[some]), pack(total[some]),
             [int(some.sum()), int(total.sum()), *of[1:K + 2].tolist()])]
    at = 0
    for shard, k in zip(pdf["shard"], keys):
        rows.append(("answer", level, bucket, int(shard), None, pack(answer[at:at + len(k)]), None))
        at += len(k)
    return pd.DataFrame(rows, columns=["kind", "level", "bucket", "shard", "keys", "counts",
                                       "stats"])


def slope(of: list[int]) -> float:
    """Slope of log n_r over log r, each n_r first spread over the gap around
    it (simple Good-Turing); NaN for fewer than two counts above zero."""
    r = np.flatnonzero(of) + 1
    if len(r) < 2:
        return math.nan
    before = np.append(0, r[:-1])
    after = np.append(r[1:], 2 * r[-1] - r[-2])
    x, y = np.log(r), np.log(2 * np.array(of)[r - 1] / (after - before))
    x = x - x.mean()
    return float(x @ y / (x @ x))


def turing(of: list[int]) -> np.ndarray | None:
    """Katz's discounts for r = 1 .. K from smoothed n_1 .. n_{K+1}.

    On the line log n_r = a + b log r, r* / r is (1 + 1/r)^(b + 1). A count
    loses a share of itself in proportion to 1 - r* / r, and all lose n_1
    together. For b < -1 and some n_r above zero with 1 < r <= K every discount
    lies strictly between 0 and r; otherwise there are none.
    """
    b = slope(of)
    if not b < -1 or not of[0] or not any(of[1:K]):
        return None
    r = np.arange(1, K + 1)
    share = 1 - (1 + 1 / r) ** (b + 1)
    return r * share * (of[0] / (r * share @ np.array(of[:K])))


def discounts(of: list[int]) -> np.ndarray:
    """r - r* for r = 0 .. K + 1 (the last for all counts above K).

    Good-Turing from smoothed counts of counts; absolute discounting for
    r <= K where these do not fall faster than 1/r.
    """
    n = [0, *of]
    out = np.zeros(K + 2)
    out[K + 1] = ABOVE
    good = turing(of)
    if good is None:
        good = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out[1:K + 1] = good
    return out


@dataclass(frozen=True)
class Totals:
    """Figures of the training rows that every task needs."""

    tokens: int
    words: int
    texts: int
    unigram: np.ndarray
    bigram: np.ndarray
    unknown: float

    def lost(self, counts: np.ndarray, level: int) -> np.ndarray:
        return (self.bigram if level == BIGRAM else self.unigram)[np.minimum(counts, K + 1)]

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (counts - self.lost(counts, UNIGRAM)) / max(self.tokens, 1),
                        self.unknown)


def _totals(replies: DataFrame, shards: DataFrame) -> Totals:
    rows = (replies.filter("kind = 'counts'").groupBy("level")
            .agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3)]).collect())
    by = {r["level"]: [int(r[f"s{i}"]) for i in range(K + 3)] for r in rows}
    zero = [0] * (K + 3)
    words, tokens, *one = by.get(UNIGRAM, zero)
    two = by.get(BIGRAM, zero)[2:]
    texts = shards.select(F.sum(F.size(F.filter("trains", lambda t: t)))).head()[0] or 0
    unigram = discounts(one)
    mass = sum(n * d for n, d in zip(one, unigram[1:])) - one[K] * ABOVE + (
        words - sum(one[:K])) * ABOVE
    return Totals(tokens, words, texts, unigram, discounts(two), mass / tokens if tokens else 1.0)


# ------------------------------------------------------------------ sums, weights, scores

_PART = ("kind string, bucket int, shard long, keys binary, a binary, b binary, "
         "sizes array<int>, known array<int>, base array<double>, score array<double>")


def _parts(shards: DataFrame, replies: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """Per shard: sums over the continuations it stands for, by history;
    scores of its texts but for back-off weights; the weights they need."""
    answers = replies.filter("kind = 'answer'").groupBy("shard").agg(
        F.collect_list(F.struct("level", "bucket", "counts")).alias("answers"))
    make = _rows(_PART)
    none = (None,) * 4

    def parts(row: dict) -> Iterator[pa.RecordBatch]:
        s = Shard(row)
        got = {(x["level"], x["bucket"]): x["counts"] for x in row["answers"]}
        total = [np.zeros(len(s.keys(level)), dtype=np.uint32) for level in (UNIGRAM, BIGRAM)]
        for level in (UNIGRAM, BIGRAM):
            for b, places in stretches(s.keys(level), buckets):
                total[level][places] = unpack(got[level, b], np.uint32)
        low = np.uint32((1 << 31) - 1)
        stands = (total[BIGRAM] >> np.uint32(31)).astype(bool)
        words = (total[UNIGRAM] & low).astype(np.int64)
        pairs = (total[BIGRAM] & low).astype(np.int64)
        histories = np.append(words, totals.texts)
        chance = totals.word_probability(words)
        # sums over continuations
        own = np.flatnonzero(stands)
        n = len(histories)
        lost = np.bincount(s.history[own], totals.lost(pairs[own], BIGRAM), n) / np.maximum(
            histories, 1)
        inside = np.bincount(s.history[own], chance[s.word[own]], n)
        used = np.flatnonzero(np.bincount(s.history[own], minlength=n))
        out = [("sum", b, row["shard"], pack_sorted(s.history_keys[used[p]]), pack(lost[used[p]]),
                pack(inside[used[p]]), *none) for b, p in stretches(s.history_keys[used], buckets)]
        # scores
        seen = pairs > 0
        with np.errstate(divide="ignore"):
            direct = np.log10(np.where(seen, (pairs - totals.lost(pairs, BIGRAM)) / np.maximum(
                histories[s.history], 1), 1.0))
            cost = np.where(seen, direct, np.log10(chance)[s.word])
        at = np.searchsorted(s.pairs, s.code)
        base = np.log10((words + 1) / (totals.tokens + totals.words + 1))
        out.append(("text", None, row["shard"], None, None, None, s.sizes.tolist(),
                    np.add.reduceat((words > 0)[s.words].astype(np.int32), s.starts).tolist(),
                    np.add.reduceat(base[s.words], s.starts).tolist(),
                    np.add.reduceat(cost[at], s.starts).tolist()))
        # weights that tokens back off through: (history, text, times)
        off = np.flatnonzero((~seen & (histories[s.history] > 0))[at])
        text = np.repeat(np.arange(len(s.sizes)), s.sizes)[off]
        both, times = np.unique(s.before[off] * len(s.sizes) + text, return_counts=True)
        history, text = np.divmod(both, max(1, len(s.sizes)))
        needed, which = np.unique(history, return_inverse=True)
        keys = s.history_keys[needed]
        by_bucket = list(stretches(keys, buckets))
        rank = np.empty(len(needed), dtype=np.int64)
        rank[np.concatenate([np.empty(0, np.int64)] + [p for _, p in by_bucket])] = np.arange(
            len(needed))
        order = np.argsort(rank[which], kind="stable")
        place = rank[which][order]
        first = 0
        for b, p in by_bucket:
            lo, hi = np.searchsorted(place, [first, first + len(p)])
            mine = order[lo:hi]
            pairs_at = np.concatenate([place[lo:hi] - first, text[mine]]).astype(np.uint32)
            out.append(("need", b, row["shard"], pack_sorted(keys[p]), pack(pairs_at),
                        pack(times[mine].astype(np.uint32)), *none))
            first += len(p)
        for i in range(0, len(out), 64):
            yield make(out[i:i + 64])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from parts(batch.slice(i, 1).to_pylist()[0])

    full = shards.drop("ids").join(answers, "shard")
    return staged(full.mapInArrow(run, _PART), "katz-parts")


_WEIGHT = "kind string, bucket int, shard long, keys binary, weights binary"


def _weigh(pdf: pd.DataFrame) -> pd.DataFrame:
    """log10 alpha of a bucket's histories: its part of the back-off table,
    and the weights each shard asked for."""
    bucket = int(pdf["bucket"].iloc[0])
    pdf = pdf.sort_values(["kind", "shard"])
    sums, needs = pdf[pdf["kind"] == "sum"], pdf[pdf["kind"] == "need"]
    keys, group = np.unique(np.concatenate([np.empty(0, np.uint64)] + [
        unpack_sorted(k) for k in sums["keys"]]), return_inverse=True)

    def added(col):
        return np.bincount(group, np.concatenate([np.empty(0)] + [
            unpack(x, np.float64) for x in sums[col]]), len(keys))

    alpha = np.log10(added("a") / np.maximum(1 - added("b"), 1e-300))
    rows = [("backoff", bucket, None, pack_sorted(keys), pack(alpha))] if len(keys) else []
    for shard, need in zip(needs["shard"], needs["keys"]):
        rows.append(("answer", bucket, int(shard), None,
                     pack(alpha[np.searchsorted(keys, unpack_sorted(need))])))
    return pd.DataFrame(rows, columns=["kind", "bucket", "shard", "keys", "weights"])


def _backed_off(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(shard, place, extra): what back-off weights add to each text's score,
    added up shard by shard."""
    need = parts.filter("kind = 'need'").select("shard", "bucket", "a", "b")
    joined = need.join(weights.filter("kind = 'answer'").select("shard", "bucket", "weights"),
                       ["shard", "bucket"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, costs = [], []
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weights"]):
            spot, text = unpack(a, np.uint32).reshape(2, -1)
            texts.append(text)
            costs.append(unpack(w, np.float64)[spot] * unpack(b, np.uint32))
        places, which = np.unique(np.concatenate(texts), return_inverse=True)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "place": places.astype(np.int32),
                             "extra": np.bincount(which, np.concatenate(costs))})

    return joined.groupBy("shard").applyInPandas(add, "shard long, place int, extra double")


@dataclass(frozen=True)
class Katz:
    """The model's tables and the scored rows."""

    scores: DataFrame
    counts: DataFrame  # level, bucket, packed keys and counts
    backoff: DataFrame  # bucket, packed history keys and log10 alpha
    totals: Totals


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                  shard_tokens: int = SHARD_TOKENS) -> Katz:
    """Learns from the rows where ``train`` holds and scores every row.

    ``scores`` has the id, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-one unigram) and score (Katz), in log10.
    """
    shards = shards_of(docs, train, id_col, text_col, shard_tokens)
    buckets = max(1, shards.count())
    replies = staged(_requests(shards, buckets).groupBy("level", "bucket").applyInPandas(
        _add_up, _REPLY), "katz-counts")
    totals = _totals(replies, shards)
    parts = _parts(shards, replies, totals, buckets)
    weights = staged(parts.filter("kind <> 'text'").groupBy("bucket").applyInPandas(
        _weigh, _WEIGHT), "katz-backoff")
    texts = parts.filter("kind = 'text'").join(shards.select("shard", "ids"), "shard").select(
        "shard", F.posexplode(F.arrays_zip("ids", "sizes", "known", "base", "score")).alias(
            "place", "t"))
    extra = _backed_off(parts, weights)
    scores = texts.join(extra, ["shard", "place"], "left").select(
        F.col("t.ids").alias(id_col), F.col("t.sizes").cast("long").alias("n_tokens"),
        F.col("t.known").cast("long").alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        F.col("t.base").alias("base_score"),
        (F.col("t.score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return Katz(scores, replies.filter("kind = 'counts'"), weights.filter("kind = 'backoff'"),
                totals)
