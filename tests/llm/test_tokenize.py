import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.tokenize import Encoder, default_pattern, default_vocabulary, encode_texts, token_counts


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return Encoder.load(default_vocabulary(), default_pattern()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_equals_the_public_library(pair, t):
    assert pair[0].encode(t) == pair[1].encode_ordinary(t)


def test_long_words_and_both_merges(pair):
    for t in ("a" * 5000, "abcab" * 400, "字" * 3000, "!?-" * 900, " " * 3000 + "x", "Donaudampfschifffahrt" * 60):
        assert pair[0].encode(t) == pair[1].encode_ordinary(t)
        w = t[:200].encode()
        assert pair[0]._merge_scan(w) == pair[0]._merge_heap(w)


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world", 1), (1, None, 2), (None, "", 3)], "doc_id long, text string, ids int")
    got = [tuple(r) for r in encode_texts(df, "doc_id", "text").collect()]
    assert got[1:] == [(1, []), (None, [])] and 50256 not in got[0][1] and len(got) == 3
    assert [tuple(r) for r in token_counts(df, "doc_id", "text").collect()] == [(1, len(got[0][1])), (1, 0), (None, 0)]
    assert encode_texts(df.where("false"), "doc_id", "text").count() == 0
