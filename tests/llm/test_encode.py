import random

import pytest
from tokenizers import Tokenizer

from lacuna.llm.encode import encode_corpus, encoder, token_counts
from lacuna.session import default_tokenizer

PATH = default_tokenizer()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equal_to_the_library_on_random_texts(library):
    rnd = random.Random(5)
    parts = ["aaaa", "the ", " ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "é", "ש", "שלום", "😀", "𐤀", "0", "12", "--", "  ", "ing", "\xa0", "\x1c", "\x85", "ﬁ", "¼", "İ", "́", "<p>", "aaaaaaaaaaaaaaaa"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert encoder(PATH).encode(s) == library(s), s


def test_very_long_word(library):
    s = "ab" * 50_000 + "a" * 50_000
    assert encoder(PATH).encode(s) == library(s)


def test_rows_null_empty_repeated_extra_columns(spark, library):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "y"), (None, " \n", None)], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(d, PATH).collect()]
    assert got == [(1, []), (2, []), (3, library("Hello  world")), (3, library("Hello  world")), (None, library(" \n"))]
    assert [r["n_tokens"] for r in token_counts(d, PATH, ["doc_id"]).collect()] == [len(x) for _, x in got]
    assert encode_corpus(d.limit(0), PATH).count() == 0
