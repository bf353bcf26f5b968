"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docmill.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("name", ["awkward", "sample"])
def test_same_ids_as_the_library(name, library, request):
    docs = request.getfixturevalue(name)
    want = sorted((repr(r.doc_id), *expected(library, r.text)) for r in docs.collect())
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs, PATH, PATTERN).collect())
    assert got == want


def test_odd_characters(library):
    ranks = bpe.read_ranks(PATH)
    codec = bpe.Codec(bpe.serialise(ranks), ranks, PATTERN)
    rng = random.Random(5)
    pool = ["a", "B", "é", "\x1c", "\x85", "᠎", "﻿", "​", "\xa0", "\n", " ", "\t", "1", "²", "漢", "😀",
            "́", "'", "s", "re", "!", "\x00", "İ", "Ⅷ", "ſ", "'ll", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_general_interface_keeps_columns(awkward):
    out = bpe.decode(bpe.encode(awkward, PATH, PATTERN), PATH)
    assert out.columns == [*awkward.columns, "token_ids", "decoded"]
    assert out.filter(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0


def test_empty_table(nothing):
    assert bpe.digest(nothing, PATH, PATTERN).count() == 0


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        bpe.serialise({b"a": 0, b"b": 2})
