"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in column functions: no user functions, no shuffle. Each document
is measured and judged in its own row, so neither hot sources nor groups of
copies matter.

Edge cases: a null or empty text has no words, zero counts and fails the base
rule; repeated rows are judged one by one; other columns (any name) are
passed through by :func:`apply_rules` and may clash with a measure's name, in
which case the measure replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import SPACE_CLASS, text_or_empty, words_of

#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "the of and a to in is that it as was with for on by this be are an at or from he "
    "de la le les et des en un une du que qui dans pour pas sur est par au ce "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es "
    "el y los se las con no una su para lo"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Ratios of clean web prose, after published filter rules (mean word length
#: 3 to 10, at most one symbol per ten words, function words present, at most
#: half of the lines repeated).
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars", "n_words", low=3.0, high=10.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.03),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", high=0.5),
)


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words
    and n_repeat_words (all long) to every row.

    Windows of eight words are compared by a 64-bit hash of their words'
    64-bit hashes; sorting happens only in texts where a hash repeats.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words",
                "n_repeat_words"]
    taken = {m.lower() for m in measures}
    keep = [f"`{c}`" for c in df.columns if c.lower() not in taken]
    step = df.select(*keep, text_or_empty(text_col).alias("_t"))
    step = step.select(*keep, "_t", words_of(F.col("_t")).alias("_w"),
                       F.filter(F.split("_t", "\n"),
                                lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    n = F.size("_w").cast("long")
    step = step.select(
        *keep, n.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")
        .alias("n_stop_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW),
                    lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    flat = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    step = step.select(*keep, *flat, windows.alias("_v"))
    repeats = F.size(F.array_distinct("_v")) < F.size("_v")
    step = step.select(
        *keep, *flat,
        F.when(repeats, F.sort_array(F.transform("_v", lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))).alias("_p"))
    twice = F.transform("_p", lambda x, j: F.when(
        (F.get("_p", j - 1)["h"] == x["h"]) | (F.get("_p", j + 1)["h"] == x["h"]), x["i"]))
    step = step.select(*keep, *flat,
                       F.sort_array(F.filter(twice, lambda i: i.isNotNull())).alias("_r"))
    spans = F.transform("_r", lambda i, j: F.least(
        F.coalesce(F.get("_r", j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x)
    step = step.select(*keep, *flat, F.coalesce(covered, F.lit(0).cast("long"))
                       .alias("n_repeat_words"))
    # A later filter on a measure would be pushed below these projections and
    # repeat their work once per reference; it stops at a generator.
    return step.select(*keep, F.inline(F.array(F.struct(*measures))))


def _holds(rule: Rule) -> Column:
    ratio = F.col(rule.numerator) / F.nullif(F.col(rule.denominator), F.lit(0))
    bounds = []
    if rule.low is not None:
        bounds.append(ratio >= rule.low)
    if rule.high is not None:
        bounds.append(ratio <= rule.high)
    return F.coalesce(reduce(Column.__and__, bounds, F.lit(True)), F.lit(True))


def apply_rules(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text",
                min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Measures every row and compiles ``rules`` into one projection.

    Adds the measures, ``base_failed`` (fewer than ``min_words`` words, or
    more than ``max_repeat_percent`` percent of the words inside repeated
    windows), ``failed_rules`` (names, in table order) and ``kept``.
    """
    measured = with_measures(df, text_col)
    own = {"base_failed", "failed_rules", "kept"}
    keep = [f"`{c}`" for c in measured.columns if c.lower() not in own]
    failed = F.array_compact(F.array(*[F.when(~_holds(r), F.lit(r.name)) for r in rules])
                             if rules else F.array().cast("array<string>"))
    base = ((F.col("n_words") < min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
    judged = reduce(Column.__and__, [_holds(r) for r in rules], F.lit(True))
    return measured.select(*keep, base.alias("base_failed"), failed.alias("failed_rules"),
                           (~base & judged).alias("kept"))
