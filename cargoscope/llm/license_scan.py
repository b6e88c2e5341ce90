"""Licence scans: Dice coefficient over word bigrams against templates.

Text and templates are normalised alike (ASCII lower case, words of letters,
digits and non-ASCII characters, equal spellings). A passage of a text, from
one template bigram to another, is compared with a template by the Dice
coefficient of their bigram sets, 2 I / (A + B). Size bounds prune: at
threshold t a passage needs I >= t B / (2 - t) bigrams in common, and may
hold at most A <= (2 - t) B / t bigrams. Templates that a text cannot reach
are dropped before any passage is tried.

A passage starts at a bigram it does not repeat and ends at one it did not hold
before, since a longer one with the same bigrams scores the same. So all
passages of a template together cover each word at most once per bigram of the
template, and a text of many copies of one licence takes linear time.

Passages that reach the threshold are chosen greedily, most common bigrams
first, without overlap. Within a passage that equals its template no other is
looked for, unless that one is not chosen. All work is per row: no shuffle. The templates are a
fixed list; their index is built once per task.

Edge cases: null and empty texts match nothing; very long texts and long runs
of copies are scanned whole; repeated rows give repeated results; ties go to the earlier passage,
then to the earlier template; templates of fewer than two words are refused;
an empty table gives no rows; extra columns pass through, and give way to a
new column of their name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from cargoscope.llm.common import annotate
from cargoscope.llm.decontaminate import normalized_words
from cargoscope.llm.license_templates import SAME, templates

THRESHOLD = 0.8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SAME = {a.encode(): b.encode() for a, b in SAME.items()}


def bigrams(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    words = [_SAME.get(w, w) for w in words]
    return list(zip(words, words[1:]))


class Index:
    """Templates by bigram, with their size bounds."""

    def __init__(self, pairs: Sequence[tuple[str, str]], threshold: float = THRESHOLD):
        self.ids = [name for name, _ in pairs]
        self.sets = [frozenset(bigrams(normalized_words(text))) for _, text in pairs]
        if not all(self.sets):
            raise ValueError("a template needs two words or more")
        self.threshold = threshold
        self.least = [math.ceil(threshold * len(s) / (2 - threshold) - 1e-9) for s in self.sets]
        self.most = [math.floor((2 - threshold) * len(s) / threshold + 1e-9) for s in self.sets]
        self.of: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            for b in s:
                self.of[b].append(k)
        self.firsts = {w for b in self.of for w in b} | {a for a, b in _SAME.items()
                                                         if any(b in x for x in self.of)}

    def passages(self, words: list[bytes], skip: bool = False
                 ) -> list[tuple[int, int, int, int, float]]:
        """(common, first word, past the last word, template, Dice) of the best
        passage from each starting bigram, for every template in reach; with
        ``skip``, none from inside a passage equal to its template."""
        known = self.firsts
        at = [i for i, w in enumerate(words) if w in known]
        hits: dict[int, list[int]] = defaultdict(list)
        seen: dict[int, set] = defaultdict(set)
        last = -2
        for i in at:
            if i == last + 1:
                pair = (_SAME.get(words[last], words[last]), _SAME.get(words[i], words[i]))
                for k in self.of.get(pair, ()):
                    hits[k].append(last)
                    seen[k].add(pair)
            last = i
        reach = [k for k in sorted(hits) if len(seen[k]) >= self.least[k]]
        if not reach:
            return []
        grams = bigrams(words)
        place: dict[tuple[bytes, bytes], int] = {}
        before = np.full(len(grams), -1)  # where each bigram stood last
        after = np.full(len(grams), len(grams))  # and stands next
        for i, gram in enumerate(grams):
            j = place.get(gram)
            if j is not None:
                before[i], after[j] = j, i
            place[gram] = i
        return [p for k in reach for p in self._windows(before, after, np.array(hits[k]), k, skip)]

    def _windows(self, before: np.ndarray, after: np.ndarray, at: np.ndarray, k: int,
                 skip: bool) -> Iterator[tuple[int, int, int, int, float]]:
        size, least, most = len(self.sets[k]), self.least[k], self.most[k]
        own = np.zeros(len(before), dtype=bool)
        own[at] = True
        # A start needs enough of the template's bigrams before its own comes again.
        enough = np.searchsorted(at, after[at]) - np.arange(len(at)) >= least
        free = 0
        for begin in at[enough].tolist():
            if begin < free:
                continue
            limit, width = int(after[begin]), 2 * most
            while True:
                stop = min(begin + width, limit)
                new = before[begin:stop] < begin
                held = np.cumsum(new)
                if held[-1] > most or stop == limit:
                    break
                width *= 2
            new &= own[begin:stop]
            common = np.cumsum(new)
            ends = np.flatnonzero(new & (common >= least) & (held <= most))
            if not len(ends):
                continue
            dice = 2 * common[ends] / (held[ends] + size)
            best = int(dice.argmax())
            if dice[best] >= self.threshold:
                end = begin + int(ends[best]) + 2
                yield int(common[ends[best]]), begin, end, k, float(dice[best])
                if skip and common[ends[best]] == held[ends[best]] == size:
                    free = end

    def match(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Chosen passages: (first word, past the last word, template, Dice)."""
        for skip in (True, False):
            chosen: list[tuple[int, int, int, float]] = []
            whole = True
            for _, a, b, k, dice in sorted(self.passages(words, skip),
                                           key=lambda p: (-p[0], -p[4], p[1], p[3])):
                i = bisect_left(chosen, (a,))
                if (i == 0 or chosen[i - 1][1] <= a) and (i == len(chosen) or b <= chosen[i][0]):
                    insort(chosen, (a, b, k, dice))
                elif dice == 1.0:
                    whole = False
            if whole:
                break
        return chosen


def find_licenses(docs: DataFrame, pairs: Sequence[tuple[str, str]] | None = None,
                  threshold: float = THRESHOLD, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Adds ``licenses``: passages with licence id, start, end (code points,
    end exclusive) and Dice coefficient, in text order."""
    pairs = templates() if pairs is None else list(pairs)

    def make():
        index = Index(pairs, threshold)

        def run(texts):
            out = []
            for text in texts:
                found = index.match(normalized_words(text))
                places = [m.span() for m in _WORD.finditer(text)] if found else []
                out.append([{"license": index.ids[k], "start": places[a][0],
                             "end": places[b - 1][1], "dice": dice} for a, b, k, dice in found])
            return [out]
        return run

    return annotate(docs, make, "licenses array<struct<license:string,start:int,end:int,"
                                "dice:double>>", text_col, keep)
