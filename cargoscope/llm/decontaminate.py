"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items (words as symbols) form one automaton per block of
items; training words stream through it and the longest match ending at each
word is tracked. A window is ``window`` consecutive item words (an item of
fewer words is one window); a word inside an occurrence of a window is hit.

Block sizes are bounded: items are dealt into blocks of at most
``max_block_words`` words, and one block is built and broadcast at a time, so
what the driver and a task hold does not grow with the benchmark. A single
item above the bound is cut into pieces that overlap by ``window - 1`` words,
which keeps every window.

Edge cases: null and empty texts have no words, no hits and stay; items
without words are ignored; repeated items each count under their own id, and
null item ids count as the text ``null``; empty tables give no hits or no
rows; extra columns pass through, and give way to a new column of their name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import annotate, free_name, set_aside, staged

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
               else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OUT = "n_words long, hits array<struct<start:int,len:int,longest:int>>, items array<string>"


def normalized_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of digits, letters and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over integer symbols."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self._ends: list[tuple[int, int]] = []
        self._short: list[tuple[list[int], int]] = []

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            state = self._state(length[last] + 1, {})
            p = last
            while p != -1 and symbol not in nxt[p]:
                nxt[p][symbol] = state
                p = link[p]
            link[state] = 0 if p == -1 else self._split(p, symbol)
            return state
        return self._split(last, symbol)

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state for p's longest string plus ``symbol``, cloned if need be."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int], item: int, whole: bool = True) -> None:
        """Adds an item; ``whole`` is False for a piece of a longer item."""
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)
            if self.length[last] >= self.window:
                self._ends.append((last, item))
        if whole and 0 < len(symbols) < self.window:
            self._short.append((symbols, item))

    def freeze(self) -> None:
        """Resolves which items a match stands for, once all items are in."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: The ancestor that holds the last ``window`` words of a state's strings.
        self.top = [0] * len(self.link)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.top[s] = s if self.length[up] < self.window else self.top[up]
        self.items: dict[int, set[int]] = defaultdict(set)
        for s, item in self._ends:
            # Later splits may have moved the prefix below a clone; its window's state is the same.
            self.items[self.top[s]].add(item)
        short = defaultdict(list)
        for symbols, item in self._short:
            state = 0
            for symbol in symbols:
                state = self.next[state][symbol]
            short[state].append((len(symbols), item))
        self.short = dict(short)
        #: Nearest state at or above each state that ends a short item.
        self.near = [0] * len(self.link)
        for s in order:
            self.near[s] = s if s in self.short else self.near[self.link[s]]
        self.shortest = min([self.window, *(m for v in self.short.values() for m, _ in v)])

    def scan(self, symbols: list[int], base: int = 0) -> Iterator[tuple[int, int, int, object]]:
        """Yields (end, length, longest match, items) for each window that ends at a word."""
        nxt, link, length, near, window = self.next, self.link, self.length, self.near, self.window
        state = matched = 0
        for i, symbol in enumerate(symbols, base + 1):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(symbol)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                yield i, window, matched, self.items[self.top[state]]
            at = near[state]
            while at:
                for m, item in self.short[at]:
                    if m <= matched:
                        yield i, m, matched, (item,)
                at = near[link[at]]


class Matcher:
    """One block's automaton with its vocabulary."""

    def __init__(self, items: Iterable[tuple[str, list[bytes], bool]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self.automaton = SuffixAutomaton(window)
        index: dict[str, int] = {}
        for name, words, whole in items:
            if name not in index:
                index[name] = len(self.names)
                self.names.append(name)
            self.automaton.add([self.vocab.setdefault(w, len(self.vocab)) for w in words],
                               index[name], whole)
        self.automaton.freeze()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[str]]:
        """Maximal hit spans (first word, words, longest match) and item ids."""
        ids = list(map(self.vocab.get, words))
        found: set[int] = set()
        spans: list[list[int]] = []
        start, n, shortest = 0, len(ids), self.automaton.shortest
        while start < n:
            if ids[start] is None:
                start += 1
                continue
            end = start
            while end < n and ids[end] is not None:
                end += 1
            if end - start >= shortest:  # words outside the vocabulary reset the match
                for stop, size, longest, items in self.automaton.scan(ids[start:end], start):
                    found.update(items)
                    first = stop - size
                    while spans and spans[-1][0] >= first:
                        longest = max(longest, spans.pop()[2])
                    if spans and spans[-1][1] >= first:
                        spans[-1][1] = max(spans[-1][1], stop)
                        spans[-1][2] = max(spans[-1][2], longest)
                    else:
                        spans.append([first, stop, longest])
            start = end
        return ([(a, b - a, m) for a, b, m in spans],
                sorted(self.names[i] for i in found))


def item_blocks(benchmark: DataFrame, window: int, max_block_words: int, id_col: str,
                text_col: str) -> Iterator[list[tuple[str, list[bytes], bool]]]:
    """Items in blocks of at most ``max_block_words`` words, fetched row by row."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")),
                            F.col(f"`{text_col}`")).toLocalIterator()
    block: list[tuple[str, list[bytes], bool]] = []
    size = 0
    for name, text in rows:
        words = normalized_words(text)
        whole = len(words) <= max_block_words
        step = max(1, max_block_words - window + 1)
        pieces = [words] if whole else [words[at:at + max_block_words]
                                        for at in range(0, len(words) - window + 1, step)]
        for piece in pieces:
            if block and size + len(piece) > max_block_words:
                yield block
                block, size = [], 0
            block.append((name, piece, whole))
            size += len(piece)
    yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10,
              max_block_words: int = 1_000_000, text_col: str = "text",
              keep: list[str] | None = None, item_id_col: str = "item_id",
              item_text_col: str = "text") -> DataFrame:
    """Adds n_words, hits (maximal hit spans in words, with the longest match
    inside) and items (ids with an occurring window, sorted as text).

    One narrow pass over the documents for each block of items (one pass for
    benchmarks of up to ``max_block_words`` words); no shuffle, whatever the
    skew. Passes before the last are staged, so a task holds one automaton.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    out = docs
    for k, block in enumerate(item_blocks(benchmark, window, max_block_words, item_id_col,
                                          item_text_col)):
        if k:
            out = staged(out, "decontaminate")
        if text_col not in out.columns:
            raise ValueError(f"several blocks of items need {text_col} among the kept columns")
        items = spark.sparkContext.broadcast(block)

        def make(items=items):
            matcher = Matcher(items.value, window)

            def run(texts, hits=None, found=None):
                counts, spans, ids = [], [], []
                for i, text in enumerate(texts):
                    words = normalized_words(text)
                    own, also = matcher.match(words)
                    if hits is not None:
                        own = merge_spans(own + [(h["start"], h["len"], h["longest"])
                                                 for h in hits[i]])
                        also = sorted({*also, *found[i]})
                    counts.append(len(words))
                    spans.append([{"start": a, "len": n, "longest": m} for a, n, m in own])
                    ids.append(also)
                return [counts, spans, ids]
            return run

        out = annotate(out, make, _OUT, text_col, names, given=["hits", "items"] if k else [])
    return out


def merge_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for first, n, longest in sorted(spans):
        if out and out[-1][0] + out[-1][1] >= first:
            a, m, best = out[-1]
            out[-1] = (a, max(m, first + n - a), max(best, longest))
        else:
            out.append((first, n, longest))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first to last word."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, n in spans:
        out.append(text[at:places[first][0]])
        at = places[first + n - 1][1]
    out.append(text[at:])
    return "".join(out)


def _cut_until_clean(text: str, matcher: Matcher, min_span_words: int) -> str:
    """Cuts hit spans again and again: what a cut joins may hit once more."""
    while True:
        spans = [(a, n) for a, n, _ in matcher.match(normalized_words(text))[0]
                 if n >= min_span_words]
        if not spans:
            return text
        text = cut_spans(text, spans)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  min_span_words: int = 1, max_coverage: float = 0.5, text_col: str = "text",
                  max_block_words: int = 1_000_000, item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Removes benchmark passages from the documents.

    A document with more than ``max_coverage`` of its words hit is dropped; a
    hit span of at least ``min_span_words`` words is cut from the others,
    until none is left. Documents without hits come back unchanged, and all
    columns stay (``n_chars`` follows a changed text where the table has it).
    """
    spark = docs.sparkSession
    own, place = set_aside(docs, [n for n in ("n_words", "hits", "items") if n != text_col])
    flag = free_name(own, "hit")
    hit = find_hits(own, benchmark, window, max_block_words, text_col, None, item_id_col,
                    item_text_col)
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["len"])
    out = hit.filter(covered <= F.col("n_words") * max_coverage).select(
        *[F.col(f"`{c}`") for c in own.columns], (F.size("hits") > 0).alias(flag))
    others = [c for c in own.columns if c != text_col] + [flag]
    moved = free_name(out, "moved")
    while True:
        blocks = 0
        for block in item_blocks(benchmark, window, max_block_words, item_id_col, item_text_col):
            out = staged(out, "decontaminate") if blocks else out
            blocks += 1
            items = spark.sparkContext.broadcast(block)

            def make(items=items):
                matcher = Matcher(items.value, window)

                def run(texts, flags, before):
                    clean = [_cut_until_clean(t, matcher, min_span_words) if f else t
                             for t, f in zip(texts, flags)]
                    return [clean, [bool(m) or c != t
                                    for m, c, t in zip(before, clean, texts)]]
                return run

            earlier = out if blocks > 1 else out.withColumn(moved, F.lit(False))
            out = annotate(earlier, make, f"`{text_col}` string, `{moved}` boolean", text_col,
                           others, given=[flag, moved])
        if blocks == 1:
            break
        # A cut for one block may join words that hit another: sweep until nothing moves.
        out = staged(out, "decontaminate")
        if not out.filter(moved).head(1):
            break
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col(flag), F.length(f"`{text_col}`"))
                                 .otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType))
    return out.select(*[F.col(f"`{place[c]}`").alias(c) for c in docs.columns])
