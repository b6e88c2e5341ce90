"""Token counts against the tokenizer library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cargoscope.llm import token_counts as tc
from tests.conftest import SMOKE_DIR

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def whole(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_splices_equal_whole_text(tokenizer, seed):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", "\t", "the", "don't", "été", "東京", "<|endoftext|>", "123", "!!",
             "'s", " a", "🙂", " ", "​", "\x1c", "x" * 90]
    for size in (1, 40, 700):
        text = "".join(rnd.choices(parts, k=size))
        for chunk, overlap in ((7, 1), (50, 8), (400, 64)):
            got = sum(n for n, _ in tc.splices(tokenizer, text, chunk, overlap))
            assert got == whole(tokenizer, text)


def test_overlap_widens_to_the_end_without_boundaries(tokenizer):
    text = "ab1" * 3000
    assert list(tc.splices(tokenizer, text, 100, 4)) == [(whole(tokenizer, text), len(text))]


def test_rows(spark, tokenizer):
    texts = [None, "", " ", "a b", "a b", "é<|endoftext|>z", "many words here " * 20000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)],
                               "doc_id long, text string, N_TOKENS int")
    out = tc.count_tokens(df, FILE, chunk_chars=5000, overlap_chars=32)
    assert [c.lower() for c in out.columns].count("n_tokens") == 1
    for r in out.collect():
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (whole(tokenizer, t), len((t or "").encode()))
    assert tc.count_tokens(df.limit(0), FILE).count() == 0


def test_query_equals_library(spark, tokenizer):
    import __spark_entry__ as E
    texts = {r["doc_id"]: r["text"]
             for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    rows = E.queries()["op8_token_counts"](spark, SMOKE_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = whole(tokenizer, texts[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)


def test_long_documents_of_the_tables_are_chunked(spark, tokenizer):
    """Every text above the default chunk size, with as many splices as it takes."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(
        F.length("text") > 1 << 15).select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(texts) > 1
    for r in tc.count_tokens(docs, FILE).collect():
        assert r["n_tokens"] == whole(tokenizer, texts[r["doc_id"]])
    for text in texts.values():
        assert len(list(tc.splices(tokenizer, text, 1 << 15, 1 << 9))) > 1


class Recording:
    """The library's tokenizer; keeps the texts given to it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("most", [3, 40, 1 << 17])
def test_segments_equal_whole_text(tokenizer, most):
    """Odd white space, special strings and separators, with tables that overflow."""
    rnd = random.Random(most)
    parts = [" ", "  ", "\n", " \n\n", "\t", "the", "don't", "été", "東京", "<|endoftext|>", "123", "!!",
             "'s", " a", "🙂", "\u00a0", "\u200b", "\x1c", "!\x1f", "\x85", "\u180e", "\u3000", "x" * 90]
    count = tc.segment_counter(tokenizer, most)
    for _ in range(40):
        texts = ["".join(rnd.choices(parts, k=rnd.choice((0, 1, 5, 200)))) for _ in range(5)]
        assert count(texts) == [whole(tokenizer, t) for t in texts]


def test_segments_start_at_pieces_of_the_pattern(tokenizer):
    """Before white space no piece runs on, whatever character ends the word."""
    ends = [c for c in map(chr, range(0x3100)) if len(tc.SEGMENT.findall(f"x{c}  x")) == 2
            and tc.SEGMENT.findall(f"x{c}  x")[0] == f"x{c}"]
    assert "\x1c" in ends and "\u00a0" not in ends
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"x{c}  " for c in ends))
    starts = {a for _, (a, _) in pieces}
    assert all(4 * i + 2 in starts for i in range(len(ends)))


def test_words_that_come_again_are_encoded_once(tokenizer):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(500)]
    texts = [" ".join(rnd.choices(words, k=100)) for _ in range(200)]
    library = Recording(tokenizer)
    count = tc.segment_counter(library)
    got = [n for i in range(0, len(texts), 20) for n in count(texts[i:i + 20])]
    assert got == [whole(tokenizer, t) for t in texts]
    assert sum(map(len, library.given)) < sum(map(len, texts)) / 10


def test_words_without_repeats_go_joined_and_tables_stay_bounded(tokenizer):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)]
    library = Recording(tokenizer)
    count = tc.segment_counter(library, most=60)
    texts.append(texts[0])  # its words are forgotten by then
    got = [n for t in texts for n in count([t])]
    assert got == [whole(tokenizer, t) for t in texts]
    assert [t for t in library.given if t] == texts
