"""Ids against the unmodified tokenizer."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm.columns import read
from tallyframe.llm.tokens import BYTE_BPE, WORD_BPE, Encoder

from tests.llm.helpers import DATA

PATHS = [BYTE_BPE, WORD_BPE]
ENCODERS = {(path, special): Encoder(path, special) for path in PATHS for special in (True, False)}
WHOLE = {(path, special): Tokenizer.from_file(path) for path in PATHS for special in (True, False)}
for (_, special_), whole in WHOLE.items():
    if not special_:
        whole.encode_special_tokens = True
EITHER = pytest.mark.parametrize("path", PATHS, ids=["byte", "word"])


def same(path, text, special=True):
    ids = WHOLE[path, special].encode(text, add_special_tokens=False).ids
    assert ENCODERS[path, special].ids(text) == np.array(ids, "<u4").tobytes(), repr(text)


@EITHER
@settings(max_examples=600, deadline=None)
@given(
    text=st.text(alphabet="abZ é ß İ\n\t'st 12٣,.#<|>漢\x1c\x85\x00́ñΣς×ǅ😀 ", max_size=40),
    special=st.booleans(),
)
def test_ids_are_those_of_the_whole_text(path, text, special):
    same(path, text, special)


@EITHER
@settings(max_examples=600, deadline=None)
@given(words=st.lists(st.sampled_from("I'll don't 'S '' !'s x'd. straße ÉTÉ  \n \n\n a1b22 ,, the <|endoftext|> <|ENDOFTEXT|> _x_".split(" "))))
def test_plain_words(path, words):
    same(path, " ".join(words))


@EITHER
def test_every_token_of_the_vocabulary(path):
    """Each as a text: its merges by rank are the merges of the file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    assert ENCODERS[path, True].merger is not None
    whole = WHOLE[path, True]
    texts = [whole.decode([i]) for i in vocabulary.values()]
    for text, ids in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ENCODERS[path, True].ids(text) == np.array(ids.ids, "<u4").tobytes(), repr(text)


@EITHER
@pytest.mark.parametrize("special", [True, False], ids=["tokens", "text"])
def test_strings_of_special_tokens(path, special):
    for text in ("a <|endoftext|> b", "<|startoftext|><|endoftext|>", "x<|EndOfText|>", "<|endoftext", "é <|endoftext|>\n\n b c"):
        same(path, text, special)
    n = len(ENCODERS[path, special].ids("a <|endoftext|> b")) // 4
    assert n == ({BYTE_BPE: 4, WORD_BPE: 3} if special else {BYTE_BPE: 9, WORD_BPE: 8})[path]


@EITHER
def test_long_texts(path):
    for text in (
        "Some words, élan. <|endoftext|> it's\n\n12 " * 40_000, "Some words, élan. it's\n\n12 " * 40_000,
        "x" * 20_000, "=" * 20_000, " " * 20_000 + "a", "a\n" * 20_000, "7" * 5_000 + " b", "漢字" * 3_000,
    ):
        same(path, text)
    assert ENCODERS[path, True].ids(None) == b""


@EITHER
def test_given_documents(spark, path):
    for r in read(spark, f"{DATA}/sf0.01", "documents").select("text").collect():
        same(path, r.text or "")
