import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallycard.llm import bpe

SPEC = open(bpe.vocabulary(), encoding="utf-8").read()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(SPEC)


PIECES = st.lists(st.sampled_from(
    ["the", " ", "  ", "\n", "\n\n", "'s", "don't", "\u00e9l\u00e8ve", "\U0001f600", "123", "!!", "<|endoftext|>", "\x1c", "\x85", "\u3000", "aaaaaaaa", "\t", "x" * 40, "\u4f60\u597d"]), max_size=60).map("".join)


@settings(max_examples=120, deadline=None)
@given(text=PIECES)
def test_units_give_the_library_ids(text):
    codec = bpe.Codec.kept
    assert codec.encode(text) == codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == codec.tokenizer.decode(codec.encode(text), skip_special_tokens=False)


@settings(max_examples=120, deadline=None)
@given(text=PIECES, cut=st.floats(0, 1), window=st.sampled_from([1, 8, 64]))
def test_join_at_any_place(text, cut, window):
    codec = bpe.Codec.kept
    k = int(cut * len(text))
    parts = [(t, np.asarray(codec.encode(t), np.int32)) for t in (text[:k], text[k:])]
    assert codec.join(*parts, window=window)[1].tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


bpe.Codec.kept = bpe.Codec(SPEC)


def test_tree_of_unsplit_text(codec):
    text = "abcab" * 3000 + "zz" * 900
    parts = [(text[k:k + 700], np.asarray(codec.encode(text[k:k + 700]), np.int32)) for k in range(0, len(text), 700)]
    assert codec.concatenate(parts).tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("long_chars", [500, 32768])
def test_whole_table(spark, odd, odd_rows, codec, long_chars):
    got = bpe.encode_documents(odd, bpe.vocabulary(), form="digests", long_chars=long_chars).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = codec.tokenizer.encode(t or "", add_special_tokens=False).ids
        text = codec.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_round_trip_and_empty(spark, odd, none, odd_rows):
    back = bpe.decode_ids(bpe.encode_documents(odd, bpe.vocabulary()), bpe.vocabulary())
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(i, t or "") for i, t, *_ in odd_rows], key=repr)
    assert bpe.encode_documents(none, bpe.vocabulary()).count() == 0
