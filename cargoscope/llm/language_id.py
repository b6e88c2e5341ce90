"""Language of every document by rank-order profiles of n-grams.

A profile is the list of a text's most frequent n-grams, most frequent first.
A language's profile is that of all its training texts together. A document
gets the language whose profile is least out of place against its own: every
n-gram of the document adds the difference of its two ranks, or the profile
length where the language's profile lacks it.

N-grams are of one to three characters of lower-case words (runs of letters),
each word with a blank on either side; a blank alone does not count. An
n-gram is one 64-bit integer that holds its length and its characters, so
counting is sorting of integers and no two n-grams share a code.

Learning counts inside each task first, with a bounded table, then sums per
(language, n-gram); no task sees all texts of a language. What goes to the
workers is ``LANGS_AT_ONCE`` profiles at a time, so its size is bounded
whatever the number of languages: more languages mean more passes over the
documents, each of which keeps the nearest language so far.

Edge cases: a null text, or one without a letter, is ``und`` with score 0,
and so is every text when nothing was learnt (empty training table, all
languages null). Long texts are read in stretches, whole. Equal counts rank
by code, equal distances go to the language that sorts first by code point.
Repeated rows are scored, and learnt from, each for itself. Extra columns
pass through; one named like a new column gives way to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.common import _slices, annotate, free_name, staged
from cargoscope.plans.ranking import with_global_position

PROFILE = 400  # n-grams in a profile
LANGS_AT_ONCE = 256  # profiles that one pass holds
UNKNOWN = "und"
STRETCH = 1 << 18  # characters read at a time
TABLE = 1 << 19  # n-grams a learning task holds before it hands them on
_BITS = 20  # every letter lies below 2**20 (planes 0 to 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 for all else."""
    points = np.arange(0x110000)
    keep = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(keep, points, 0)


def _stretches(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text), STRETCH):
        # The one lower-case form that depends on neighbours is made plain first.
        low = text[i:i + STRETCH].replace("Σ", "σ").lower()
        yield _letters()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)]
    yield np.zeros(1, np.int64)  # the blank after the last word


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    unique, place = np.unique(codes, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the n-grams of ``text`` and how often each occurs."""
    parts = []
    seen = np.zeros(1, np.int64)  # the last characters read; a blank before the first word
    for points in _stretches(text or ""):
        both = np.concatenate([seen, points])
        fresh = np.arange(len(both)) >= len(seen)
        keep = np.ones(len(both), bool)
        keep[1:] = (both[1:] != 0) | (both[:-1] != 0)  # one blank between words
        c, fresh = both[keep], fresh[keep]
        one = c[fresh & (c != 0)]
        two = (c[:-1] << _BITS | c[1:])[fresh[1:]]
        three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[fresh[2:] & (c[1:-1] != 0)]
        codes = np.concatenate([one | 1 << 60, two | 2 << 60, three | 3 << 60])
        if len(codes):
            parts.append(np.unique(codes, return_counts=True))
        seen = c[-2:]
    return _merged(parts)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n) over all texts of each non-null language. Tasks hand on
    partial counts whenever their table holds ``TABLE`` n-grams."""
    source = docs.filter(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    out = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on():
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)).cast(pa.string()), pa.array(codes), pa.array(counts)],
                    schema=out)
            held.clear()

        for batch in batches:
            for part in _slices(batch, 1, 1 << 20):
                parts = defaultdict(list)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    parts[lang].append(ngram_counts(text))
                for lang, new in parts.items():
                    held[lang] = _merged(([held[lang]] if lang in held else []) + new)
                if sum(len(c) for c, _ in held.values()) > TABLE:
                    yield from hand_on()
        yield from hand_on()

    return (source.mapInArrow(run, "lang string, code long, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, use: Column | None = None, text_col: str = "text", lang_col: str = "lang",
        size: int = PROFILE) -> DataFrame:
    """Profiles (lang_no, lang, rank, code) learnt from the rows where ``use``
    holds (null counts as no); ``rank`` and ``lang_no`` count from 0. A
    language without an n-gram has no profile."""
    source = docs if use is None else docs.filter(use)
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    profiles = staged(count_ngrams(source, text_col, lang_col)
                      .withColumn("rank", F.row_number().over(best) - 1)
                      .filter(F.col("rank") < size).drop("n"), "language-profiles")
    langs = with_global_position(profiles.select("lang").distinct(), [F.col("lang")],
                                 name="lang_no", total_name=None)
    return staged(profiles.join(langs, "lang"), "language-numbers")


class Profiles(NamedTuple):
    """Some languages' profiles: ``rank[l, j]`` is the rank that language ``l``
    gives to ``codes[j]``, or ``size`` where it has none."""
    langs: list[str]
    codes: np.ndarray
    rank: np.ndarray
    size: int


def profiles_of(rows: Sequence, size: int) -> Profiles:
    langs = sorted({r["lang"] for r in rows})
    codes = np.unique(np.array([r["code"] for r in rows], np.int64))
    rank = np.full((len(langs), len(codes)), size, np.int64)
    for r in rows:
        rank[langs.index(r["lang"]), np.searchsorted(codes, r["code"])] = r["rank"]
    return Profiles(langs, codes, rank, size)


def distances(ranked: np.ndarray, model: Profiles) -> np.ndarray:
    """Out-of-place distance of a document's ranked codes to each language."""
    at = np.minimum(np.searchsorted(model.codes, ranked), len(model.codes) - 1)
    known = model.codes[at] == ranked
    gap = np.abs(model.rank[:, at] - np.arange(len(ranked)))
    return np.where(known & (model.rank[:, at] < model.size), gap, model.size).sum(axis=1)


def predict(docs: DataFrame, profiles: DataFrame, size: int = PROFILE, text_col: str = "text",
            keep: Sequence[str] | None = None, at_once: int = LANGS_AT_ONCE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (1 for equal profiles, 0 for nothing in
    common): 1 - distance / (n-grams compared * profile length)."""
    count = profiles.agg((F.max("lang_no") + 1).alias("n")).first()["n"] or 0
    models = []
    for first in range(0, max(count, 1), at_once):
        rows = profiles.filter(F.col("lang_no").between(first, first + at_once - 1)).collect()
        models.append(docs.sparkSession.sparkContext.broadcast(profiles_of(rows, size) if rows else None))
    names = [c for c in (docs.columns if keep is None else keep)
             if c.lower() not in ("lang_pred", "score")]
    text = free_name(docs, "__text_of_row")
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(text))
    for no, model in enumerate(models):
        last = no == len(models) - 1
        out = _nearest(out, model, size, text, names if last else [*names, text], again=no > 0)
    return out


def _nearest(docs: DataFrame, model, size: int, text_col: str, keep, again: bool) -> DataFrame:
    given = ("lang_pred", "score") if again else ()

    def make():
        profiles = model.value

        def score(texts, langs=None, scores=None):
            best_langs, best_scores = [], []
            for i, text in enumerate(texts):
                ranked = top(*ngram_counts(text), size)
                best = (langs[i], scores[i]) if again else (UNKNOWN, 0.0)
                if len(ranked) and profiles is not None:
                    gaps = distances(ranked, profiles)
                    at = int(gaps.argmin())
                    close = 1.0 - float(gaps[at]) / (len(ranked) * size)
                    if not again or close > best[1]:
                        best = (profiles.langs[at], close)
                best_langs.append(best[0])
                best_scores.append(best[1])
            return [best_langs, best_scores]

        return score

    return annotate(docs, make, "lang_pred string, score double", text_col, keep, given)
