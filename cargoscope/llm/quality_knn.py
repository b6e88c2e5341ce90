"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms of a text are its hashed byte trigrams (log counts times inverse
document frequency) and a few one-hot terms of its shape (length, repeated
words, four-word runs and lines, doubled words, symbols, capitals). A
truncated singular value decomposition of the labelled texts' term matrix
gives the latent space; the labelled vectors and the projection are
broadcast. Every document is projected, its cosines with all labelled vectors
are computed exactly in blocks, and its ``neighbours`` nearest vote with
their label, weighted by a power of the cosine and so that both labels weigh
the same over the labelled rows.

The fit uses at most ``per_class`` labelled rows of either label, picked by a
hash (a documented bound: it fixes the size of what is collected and
broadcast, about ``2 * per_class * (latent + 1)`` floats). Scoring covers
every row: a narrow map, no shuffle, whatever the skew.

Edge cases: null and empty texts are scored as empty; null labels and ids
teach nothing; several labels of one id count by their mean; without labelled
rows every score is 0.5; ties between neighbours go to the earlier in hash
order; an empty table gives no rows; extra columns pass through, and give way
to a new column of their name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.common import annotate

TRIGRAMS = 1024
_BUCKETS = 12
_SHAPES = 7
TERMS = TRIGRAMS + _SHAPES * _BUCKETS
_SHAPE_WEIGHT = 0.7
_SYMBOL = re.compile(rb"[^0-9A-Za-z\x80-\xff\x00-\x20.,;:'\"!?()-]")
_CAPITAL = re.compile(rb"[A-Z]")


#: Upper ends of the buckets that shares fall into, closer near zero.
_EDGES = (0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85)


def _bucket(share: float) -> int:
    return bisect_left(_EDGES, share)


def term_counts(text: str | None) -> np.ndarray:
    """Log counts of trigrams, then one-hot shape terms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, dtype=np.float32)
    if len(raw) >= 3:
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
        code = (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 15
        out[:TRIGRAMS] = np.log1p(np.bincount(code & (TRIGRAMS - 1), minlength=TRIGRAMS))
    words = raw.split()
    n = len(words)
    runs = max(1, n - 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, len(raw))
    shape = (
        min(_BUCKETS - 1, n.bit_length()),
        _bucket(1 - len(set(words)) / n) if n else 0,
        _bucket(1 - len(set(zip(words, words[1:], words[2:], words[3:]))) / runs) if n > 3 else 0,
        _bucket(sum(map(eq, words, words[1:])) / n) if n else 0,
        _bucket(1 - len(set(lines)) / len(lines)) if lines else 0,
        _bucket(len(_SYMBOL.findall(raw)) / letters),
        _bucket(len(_CAPITAL.findall(raw)) / letters),
    )
    for k, v in enumerate(shape):
        out[TRIGRAMS + k * _BUCKETS + v] = 1.0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Projection, labelled latent vectors (unit length) and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 15
    power: float = 8.0

    def project(self, terms: np.ndarray) -> np.ndarray:
        return _unit(_weighted(terms, self.idf) @ self.basis)

    def scores(self, terms: np.ndarray, block: int = 2048) -> np.ndarray:
        """Votes of each row's nearest labelled vectors, found block by block."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        z = self.project(terms)
        sims = np.empty((len(z), 0), dtype=np.float32)
        labels = np.empty((len(z), 0), dtype=np.float32)
        for at in range(0, len(self.vectors), block):
            part = z @ self.vectors[at:at + block].T
            sims = np.concatenate([sims, part], axis=1)
            labels = np.concatenate([labels, np.broadcast_to(self.labels[at:at + block],
                                                             part.shape)], axis=1)
            if sims.shape[1] > self.neighbours:
                top = np.argpartition(-sims, self.neighbours - 1, axis=1)[:, :self.neighbours]
                sims = np.take_along_axis(sims, top, axis=1)
                labels = np.take_along_axis(labels, top, axis=1)
        votes = np.maximum(sims.astype(np.float64), 0) ** self.power + 1e-9
        mean = float(np.clip(self.labels.mean(), 1e-3, 1 - 1e-3))
        votes *= labels / mean + (1 - labels) / (1 - mean)  # either label weighs as much in all
        return np.round((votes * labels).sum(axis=1) / votes.sum(axis=1), 6)


def _weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(terms[:, :TRIGRAMS] * idf),
                           _SHAPE_WEIGHT * terms[:, TRIGRAMS:]], axis=1)


def fit_terms(terms: np.ndarray, labels: np.ndarray, latent: int = 64, neighbours: int = 15,
              power: float = 8.0) -> Model:
    """Latent-semantic model of labelled term vectors."""
    seen = (terms[:, :TRIGRAMS] > 0).sum(axis=0)
    idf = (np.log((1 + len(terms)) / (1 + seen)) + 1).astype(np.float32)
    x = _weighted(terms, idf)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = axes[:, np.argsort(values)[::-1][:latent]].astype(np.float32)
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), labels.astype(np.float32),
                 neighbours, power)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", use: Column | None = None, per_class: int = 3000,
        latent: int = 64, neighbours: int = 15, power: float = 8.0) -> Model:
    """Fits on a hashed sample of the rows of ``labels`` that satisfy ``use``."""
    chosen = labels if use is None else labels.filter(use)
    known = (chosen.select(F.col(f"`{id_col}`").alias("id"),
                           F.col(f"`{label_col}`").cast("double").alias("label"))
             .dropna().groupBy("id").agg(F.avg("label").alias("label")))
    side = F.col("label") >= 0.5
    # A hashed share of about twice the bound first, so that what is ranked is bounded as well.
    sizes = {r["side"]: r["n"] for r in known.groupBy(side.alias("side")).agg(
        F.count("*").alias("n")).collect()}
    share = F.when(side, 2 * per_class / sizes.get(True, 1)).otherwise(
        2 * per_class / sizes.get(False, 1))
    order = Window.partitionBy(side).orderBy(F.xxhash64("id"), "id")
    taught = (known.filter(F.pmod(F.xxhash64("id"), 1 << 20) < share * (1 << 20))
              .withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_class))
    # At most 2 * per_class rows. Of several rows of one id, the one of least text hash.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(taught), "id").groupBy("id", "label", "k").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))

    def make():
        return lambda texts: [[term_counts(t).astype(np.float16).tobytes() for t in texts]]

    found = annotate(rows, make, "terms binary", "text", ["label", "k"]).toArrow()
    found = found.sort_by([("k", "ascending"), ("label", "ascending")])
    terms = np.frombuffer(b"".join(found["terms"].to_pylist()), dtype=np.float16)
    terms = terms.reshape(-1, TERMS).astype(np.float32)
    if not len(terms):
        return Model(np.ones(TRIGRAMS, np.float32), np.zeros((TERMS, latent), np.float32),
                     np.zeros((0, latent), np.float32), np.zeros(0, np.float32))
    return fit_terms(terms, found["label"].to_numpy(), latent, neighbours, power)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score",
          keep: list[str] | None = None, rows: int = 256) -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts):
            got: list[float] = []
            for at in range(0, len(texts), rows):
                terms = np.stack([term_counts(t) for t in texts[at:at + rows]])
                got += shared.value.scores(terms).tolist()
            return [got]
        return run

    return annotate(docs, make, f"`{out}` double", text_col, keep)
