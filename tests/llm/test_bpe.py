import random

import public_tokenizers
import pytest
import regex
import tiktoken

from nearloom.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cuts_equal_the_pattern():
    match = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(0)
    splitter = bpe.Splitter(public_tokenizers.PATTERN)
    for _ in range(5000):
        text = "".join(rng.choice(" \n\t\x1c\x85\xa0 ab'sé1._🙂") for _ in range(rng.randint(0, 25)))
        numbers = splitter.cut(text)
        words = list(splitter.words)
        assert [words[i] for i in numbers] == match(text)


def test_encode_equals_the_library_and_decode_returns(spark, doc_frame, odd_rows, ranks, tokenizer):
    docs = doc_frame(odd_rows + [(20, "<|endoftext|> don't  stop\r\n\r\n x"), (21, "   "), (22, "\x00a b")])
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_chars=50_000, words_per_task=100)
    got = bpe.decode(encoded, ranks).collect()
    want = sorted(((r.doc_id or -1, tokenizer.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()))
    assert sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in got) == want


def test_nothing_and_null_ids(spark, doc_frame, ranks):
    none = bpe.encode(doc_frame([]), ranks, public_tokenizers.PATTERN)
    assert none.count() == 0 and none.columns == ["doc_id", "ids"]
    df = spark.createDataFrame([(1, None), (2, []), (3, [65, 66])], "doc_id bigint, ids array<int>")
    by_rank = {v: k for k, v in ranks.items()}
    assert {r.doc_id: r.decoded for r in bpe.decode(df, ranks).collect()} == {1: None, 2: b"", 3: by_rank[65] + by_rank[66]}


def test_packing():
    words = ["", "a", "é🙂", "x" * 1000]
    assert bpe.unpack_words(bpe.pack_words(words)) == [w.encode() for w in words]
    assert bpe.unpack_words(bpe.pack_words([])) == []
    import numpy as np

    for v in ([], [0], [1, 2**31, 5]):
        assert bpe.unpack(bpe.pack(np.array(v, np.int64))).tolist() == v
