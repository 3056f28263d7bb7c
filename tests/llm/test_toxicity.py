import math
import zlib

import pytest

from tarn.llm.toxicity import BASE, UNSEEN, Lexicon, fold, held_out, hits, learn, learned_lexicon, op6_toxicity, score_text, toxicity

from .conftest import SF


def test_fold_keeps_places():
    text = "Stupіd 1D10T, Ünïcode ＬＯＳＥＲ €uro 日本"
    assert len(fold(text)) == len(text)
    assert fold(text).split()[:2] == ["stupid", "idiot"] and "unicode" in fold(text) and "loser" in fold(text)


@pytest.mark.parametrize("text", ["i\u0301diot", "id\u200biot", "ïdiót", "i\u00addi\u0301ot\ufeff", "1d\u20601o\u03087", "\u200bidiot"])
def test_accents_and_unseen_marks(text):
    found = hits(f"you {text} x", Lexicon())
    assert [(a, b) for a, b, _ in found] == [(4 + (text[0] == "\u200b"), 4 + len(text.rstrip("\ufeff")))]


def plain_score(text, lexicon):
    """Every entry and phrase tried at every place, without an automaton."""
    kept = [i for i, ch in enumerate(text) if not UNSEEN.match(ch)]
    line = " " + "".join(fold(text[i]) for i in kept)
    at = [i for i in range(len(line)) if line[i] == " "]
    spared = [(i, i + len(p)) for i in at for p in lexicon.exceptions if line.startswith(" " + fold(p), i)]
    total = 0.0
    for i in at:
        own = [(w, -len(e)) for e, w in lexicon.entries if line.startswith(e, i + 1)]
        if own:
            weight, length = max(own)
            if not any(a <= i and i - length <= b for a, b in spared):
                total += weight
    x, y = math.log1p(total), min(10.0, 100.0 * total / max(20, len(text.split()))) if total else 0.0
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * x + c * y)))


def test_corpus_against_plain_matching(spark, corpus, texts):
    own = learned_lexicon(corpus, SF)
    assert dict(own.entries) != BASE
    for r in op6_toxicity(spark, SF).collect():
        assert r["score"] == pytest.approx(plain_score(texts[r["doc_id"]] or "", own), abs=1e-12)
        assert r["predicted"] == (r["score"] >= 0.5)


def test_hits_and_exceptions():
    own = Lexicon()
    text = "the clаss clown met an 1d10t; idiotic!! un-moron"
    assert [text[a:b] for a, b, _ in sorted(hits(text, own))] == ["1d10t", "idiot", "moron"]
    assert hits("trash can, trash", own) == [(11, 16, 1.0)]
    assert hits("", own) == [] and hits("antitrash", own) == []


def test_longer_texts_score_lower_for_the_same_hit():
    own = Lexicon()
    assert score_text("you idiot", own) > score_text("you idiot " + "fine words " * 500, own) > score_text("fine words", own) == score_text("", own)


def test_all_kinds_of_rows(docs, empty):
    scored = toxicity(docs, Lexicon())
    assert scored.columns == [*docs.columns, "toxicity"] and scored.count() == docs.count()
    assert [r["doc_id"] for r in scored.where("toxicity >= 0.5").collect()] == [13]
    assert toxicity(empty, Lexicon()).count() == 0
    with pytest.raises(ValueError, match="already"):
        toxicity(docs, Lexicon(), out="ID")


def test_learning_without_labels(docs):
    none = docs.sparkSession.createDataFrame([], "doc_id long, toxic int")
    assert dict(learn(docs, none).entries) == BASE
    one = docs.sparkSession.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert dict(learn(docs, one).entries) == BASE


def test_learns_new_words(spark):
    rows = [(i, f"texte sans rien {i}" if i % 3 else f"encore un zorgable {i} texte") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    own = learn(docs, labels)
    assert any("zorgable".startswith(e) for e, _ in own.entries)
    assert score_text("zorgables partout", own) > 0.5 > score_text("rien partout", own)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = op6_toxicity(spark, sf)
    ids = {r["doc_id"]: r for r in scored.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in ids.items())
    labels = [(r["toxic"], ids[r["doc_id"]]["score"]) for r in spark.read.parquet(f"{sf}/labels.parquet").where(held_out()).collect()]
    toxic, clean = [s for t, s in labels if t], [s for t, s in labels if not t]
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.9
    assert sum(s < 0.5 for s in clean) / len(clean) > 0.995
