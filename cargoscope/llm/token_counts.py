"""Token counts with overlap resynchronisation for huge documents.

A document of up to ``chunk_chars`` characters is cut at its stable
boundaries into words with the white space before them; its count is the sum
of theirs. The library encodes a word that comes again once, and the words
not yet met again as one text per document. A longer document is encoded in
chunks that overlap, with offsets; neighbouring chunks are spliced at a
boundary that both encodings have and that is proven stable. Where an overlap
has no such boundary it is doubled and encoded again, up to the rest of the
document.

Why a boundary is stable. The byte-level tokenizer first finds special
strings, then cuts the text into pieces by one pattern, and merges bytes
inside a piece only. No piece holds a non-space character followed by a
white-space character, and the pattern never looks back, so a position
between the two is the start of a piece in every text that holds them,
whatever surrounds them: tokens before and after it do not depend on each
other. A special string without white space cannot span such a position;
tokenizers whose special strings hold white space, or that normalise or
pre-tokenise by another scheme, are not cut but encoded whole. U+001C to
U+001F, which Python counts as white space and the pattern does not, are no
white space where words are cut.

Edge cases: null and empty texts have no tokens and no bytes; very long texts
are held whole but encoded by chunk; repeated rows count each; an empty table
gives no rows; extra columns pass through, and give way to a new column of
their name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from cargoscope.llm.common import annotate

#: A word with the white space before it, or the white space that ends a text.
SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def chunkable(spec: dict) -> bool:
    """True for the pieces-by-pattern byte-level scheme the proof covers."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec.get("truncation") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                        or any(c.isspace() for c in t["content"])
                        for t in spec.get("added_tokens", ())))


def stable(text: str, at: int) -> bool:
    return text[at].isspace() and not text[at - 1].isspace()


def splices(tokenizer, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(tokens, end position) of each spliced stretch of ``text``.

    A stretch starts at a stable boundary. Its chunk runs ``overlap``
    characters past the nominal end, and the next chunk starts there; the
    first stable position that is a token boundary of both ends the stretch.
    """
    def starts(a: int, b: int) -> list[int]:
        return [a + s for s, _ in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    begin, n = 0, len(text)
    while begin < n:
        seam, width = begin + chunk, overlap
        while True:
            stop = min(n, seam + width)
            own = starts(begin, stop)
            if stop == n:
                yield len(own), n
                begin = n
                break
            other = set(starts(seam, stop))
            cut = next((p for p in sorted(other.intersection(own))
                        if seam < p < stop and stable(text, p)), None)
            if cut is not None:
                yield sum(p < cut for p in own), cut
                begin = cut
                break
            width *= 2


def segment_counter(tokenizer, most: int = 1 << 17,
                    longest: int = 64) -> Callable[[list[str]], list[int]]:
    """Function from texts to their token counts, for a chunkable tokenizer.

    Segments met a second time are encoded alone and their counts kept; all
    others of a text go to the library joined, which leaves their counts as
    they are. Texts without repeated segments so cost one encoding, as whole
    texts do. ``most`` bounds the counts kept and the segments remembered (by
    one call's more), ``longest`` their characters: full tables start anew.
    """
    known: dict[str, int] = {}
    met: set[str] = set()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        totals, rests, again = [], [], set()
        for text in texts:
            total, rest = 0, []
            for segment in SEGMENT.findall(text):
                n = known.get(segment)
                if n is not None:
                    total += n
                    continue
                rest.append(segment)
                if segment in met:
                    again.add(segment)
                elif len(segment) <= longest:
                    met.add(segment)
            totals.append(total)
            rests.append(rest)
        if len(known) + len(again) > most:
            known.clear()
        fresh = list(again)
        known.update(zip(fresh, lengths(fresh)))
        met.difference_update(fresh)
        if len(met) > most:
            met.clear()
        joined = lengths(["".join([s for s in rest if s not in known]) for rest in rests])
        return [total + n + sum([known[s] for s in rest if s in known])
                for total, n, rest in zip(totals, joined, rests)]
    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, chunk_chars: int = 1 << 15,
                 overlap_chars: int = 1 << 9, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens (no added special tokens).

    ``tokenizer_file`` is a tokenizers ``.json`` file that every executor can
    read. Each task loads it once. Per row: no shuffle.
    """
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            cut = chunkable(json.load(f))
        count = segment_counter(tokenizer)

        def run(texts):
            texts = [t or "" for t in texts]
            if cut:
                counts = iter(count([t for t in texts if len(t) <= chunk_chars]))
                tokens = [next(counts) if len(t) <= chunk_chars
                          else sum(n for n, _ in splices(tokenizer, t, chunk_chars, overlap_chars))
                          for t in texts]
            else:
                tokens = [len(e) for e in
                          tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return [[len(t.encode("utf-8", "surrogatepass")) for t in texts], tokens]
        return run

    return annotate(docs, make, "n_bytes long, n_tokens long", text_col, keep,
                    slice_bytes=1 << 20)
