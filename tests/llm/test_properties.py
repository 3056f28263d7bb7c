"""Random texts: encoders against their libraries, chunking and folding against their definitions."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import attribution, chunks, grace, pieces, toxicity, wordpieces
from tarn.llm.common import vocabulary

WORD, PIECE = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
#: Any characters, and those that encoders treat in special ways: white space of all kinds, marks, signs, cases.
texts = st.one_of(
    st.text(max_size=60),
    st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0 ​　abAB01'’.,!-_▁²½ªµ×÷ßÀéÉñÿİǅΣςﬁǻ̈🙂日本<|>/\x00﻿", max_size=40),
    st.lists(st.sampled_from(["the", "don't", "it's", "'S", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "▁", "́", "é", "Ａ", "12", "...", "thing", "Straße"]), max_size=12).map("".join),
)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_word_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    library = Tokenizer.from_file(WORD) if not hasattr(test_word_ids, "library") else test_word_ids.library
    test_word_ids.library = library
    assert wordpieces.word_ids(WORD).encode(pa.array([text, None, text], pa.string()).slice(0, 1))[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(texts)
def test_piece_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    own = pieces.encoder(PIECE)
    assert own.encode(text)[1] == own.library.encode(text)
    own.check()


@settings(max_examples=200, deadline=None)
@given(texts)
def test_token_spans_cover_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    starts, ends = attribution.token_spans(text, vocabulary("byte_bpe_50k.tiktoken"))
    covered = np.zeros(len(text), dtype=bool)
    for a, b in zip(starts, ends, strict=True):
        assert a < b
        covered[a:b] = True
    assert covered.all() and (np.diff(starts) >= 0).all()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200).map(lambda b: b * 150))
def test_chunks_join_to_the_payload(raw):
    parts = chunks.chunks_of(raw)
    assert b"".join(p for _, p in parts) == raw
    assert all(len(p) <= chunks.MOST for _, p in parts) and all(len(p) >= chunks.LEAST for _, p in parts[:-1])


@settings(max_examples=200, deadline=None)
@given(texts)
def test_folding_and_contents(text):
    text = text.encode("utf-8", "ignore").decode()
    places = list(toxicity._places(text))
    assert len(toxicity.fold(text)) == len(places) - 1 == len(text) - len(toxicity.UNSEEN.findall(text)) and places == sorted(set(places))
    assert all(toxicity.fold(text[i]) == ch for i, ch in zip(places, toxicity.fold(text), strict=False))
    assert grace.content_of(text.encode()).decode() == "".join(c for c in text if c not in " \t\n\v\f\r")
    assert 0 <= toxicity.score_text(text, toxicity.Lexicon()) <= 1
