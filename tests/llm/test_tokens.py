import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sumforge.llm import bpe_codec, token_counts
from tests.llm.conftest import HARD

ODD = ["a  b", "a \n b", "\x1ca\x1d b", "x\x85y\xa0z", "ab<|endoftext|>cd <|endoftext|>", "it's we'll 'sx", "١٢٣ ½ ²", "日本語 テスト", "a" * 300, "᠎ ﻿ a​b", "a\tb\r\nc  \n", " lead", "trail ", "\n\nx", "don't\n'll", "ǅ ꟸ x"]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_counts_of_rows(documents):
    texts = HARD + ODD
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(documents(texts)).collect()}
    assert got == {k: (len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_round_trip_of_rows(documents):
    texts = HARD + ODD
    docs = documents(texts)
    rows = {r.doc_id: r for r in bpe_codec.round_trip(docs).collect()}
    for k, t in enumerate(texts):
        ids = TIKTOKEN.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    decoded = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded} == {k: t or "" for k, t in enumerate(texts)}


@pytest.mark.parametrize("operator", [token_counts.token_counts, bpe_codec.round_trip])
def test_empty_table_and_null_ids(documents, operator):
    assert operator(documents([])).collect() == []
    assert len(operator(documents(["a", "a"], [None, None])).collect()) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n'st%1é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    counter = token_counts.counter(token_counts.default_vocabulary())
    codec = bpe_codec.codec(bpe_codec.default_ranks())
    assert counter.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    ids = TIKTOKEN.encode_ordinary(text)
    assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids) and codec.decode(codec.encode(text)) == text.encode()
