import hashlib

import pytest
import sentencepiece

from tarn.llm.common import vocabulary
from tarn.llm.pieces import encoder, piece_ids


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def test_agrees_with_the_library(docs, corpus, texts, empty, library):
    def wanted(text):
        ids = library.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    for df in (docs, corpus):
        given = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
        found = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_ids(df).collect()), key=str)
        assert sorted(((i, *wanted(t)) for i, t in given), key=str) == found
    assert piece_ids(empty).count() == 0


@pytest.mark.parametrize("text", ["  a  b", "a\n\n b\n", "\n", " ", "▁x▁ y", "a\x00b", "12345 3.14 ...---!!", "ab " * 300 + "x" * 900, "é" * 100, "²." * 40, "don't", "<0x41>"])
def test_odd_texts(text, library):
    own = encoder(vocabulary("piece_bpe_32k.model"))
    assert own.encode(text)[1] == library.encode(text)
    own.check()


def test_heap_and_list_agree():
    own = encoder(vocabulary("piece_bpe_32k.model"))
    for segment in ("▁international", "▁aaaaaaaaaaaaaaaaaaaa", "▁▁▁▁▁", "thereinafter", "---....---"):
        assert own._joined_by_list(segment) == own._joined_by_heap(segment)


def test_a_difference_is_an_error():
    own = encoder(vocabulary("piece_bpe_32k.model"))
    own.unchecked[" word"] = [1]
    with pytest.raises(ValueError, match="differ"):
        own.check()
    own.unchecked.clear()
