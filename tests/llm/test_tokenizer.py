import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from burstframe.llm import tokenizer

FILE = tokenizer.read_vocabulary()
ENCODER = tokenizer.Encoder(FILE)
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizer.PIECES, mergeable_ranks=tokenizer.parse_ranks(FILE), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ids) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", " \n\t ", "a" * 30_000, "ab" * 5000, "́" * 50, "🏳️‍🌈" * 40])
def test_texts(text):
    assert ENCODER.encode(text) == (REFERENCE.encode_ordinary(text) if text else [])


def test_pieces_by_merges():
    rng = random.Random(6)
    for _ in range(500):
        data = bytes(rng.choice(b"abcdeinorst .") for _ in range(rng.randint(1, 30)))
        assert list(ENCODER.transducer.encode(data)) == ENCODER.transducer.by_merges(data)


def test_reader_keeps_unfinished_characters():
    data = "aéж€🌈".encode()
    reader = tokenizer.Utf8Reader()
    assert "".join(reader.feed(data[i : i + 1]) for i in range(len(data))) + reader.end() == "aéж€🌈"
    for bad in (b"\xc3", b"\xe2\x82", b"\xff", b"\xed\xa0\x80", b"\xf0\x9f\x8f", b"a\xc3b"):
        reader = tokenizer.Utf8Reader()
        assert reader.feed(bad) + reader.end() == bad.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id bigint, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in tokenizer.token_ids(df, "doc_id", "text").collect())
    assert rows == [(1, REFERENCE.encode_ordinary("a b")), (2, []), (3, []), (3, [])]
    assert [f.dataType.simpleString() for f in tokenizer.token_ids(df, "doc_id", "text").schema] == ["bigint", "array<int>"]
    assert tokenizer.token_ids(df.limit(0), "doc_id", "text").count() == 0
    ids = tokenizer.token_ids(df, "doc_id", "text").unionByName(spark.createDataFrame([(4, None)], "doc_id bigint, ids array<int>"))
    assert sorted((r.doc_id, r.text) for r in tokenizer.decoded(ids, "doc_id", "ids").collect()) == [(1, "a b"), (2, ""), (3, ""), (3, ""), (4, "")]
