"""Every operator on texts of a megabyte, with and without white space, among columns named like its own."""

import hashlib
import random
import string
import zlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import attribution, chosen_path, chunks, grace, packing, pieces, toxicity
from tarn.llm.common import vocabulary, written

from .test_chosen_path import plain as near_plain
from .test_chunks import COLUMNS, wanted
from .test_packing import check as check_packing
from .test_shards import check as check_shards

CLASHES = "id long, part int, key binary, label string, group string, block int, node long, score double, _toxicity double, _gone long, _secret_spans string, slots string, digest binary, base long, nth long, out string"


@pytest.fixture(scope="module")
def long_texts():
    own = random.Random(3)
    words = ["".join(own.choices(string.ascii_lowercase, k=own.randint(2, 9))) for _ in range(5000)]
    prose = " ".join(own.choices(words, k=170_000))
    return [(1, prose), (2, prose + " more"), (3, "".join(own.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))), (4, "z" * 1_000_000), (5, " \n" * 500_000), (6, "é🙂 \n" * 250_000), (7, "short"), (None, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    df = spark.createDataFrame(long_texts, "doc_id long, text string")
    return written(df.selectExpr("*", *[f"cast(null AS {c.split()[1]}) AS {n}" for n, c in zip(names, CLASHES.split(", "), strict=True)]), "long")


def test_near_duplicates(long_docs, long_texts):
    rows = chosen_path.near_duplicates(long_docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == sorted(near_plain(long_texts), key=str)
    assert chosen_path.keep_one_of_each(long_docs).columns == long_docs.columns


def test_exact_groups(long_docs):
    kept = grace.keep_first_copies(long_docs)
    assert kept.columns == long_docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_shards(long_docs):
    check_shards(long_docs, 3)


def test_packing(long_docs, long_texts):
    check_packing(packing.pack(long_docs).collect(), long_texts)


def test_attribution(long_docs, long_texts):
    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    counts = {r["doc_id"]: r["n"] for r in attribution.section_tokens(long_docs).groupBy("doc_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert counts == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in long_texts}


def test_pieces(long_docs, long_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in pieces.piece_ids(long_docs, ids=False).collect()}
    for i, text in long_texts:
        ids = library.encode(text or "")
        assert found[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_media(spark, long_docs, long_texts, tmp_path):
    long_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = chunks.op9_media(spark, str(tmp_path)).collect()
    assert sorted((wanted(*g) for g in long_texts), key=str) == sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)


def test_toxicity(long_docs, long_texts):
    own = toxicity.Lexicon()
    rows = toxicity.toxicity(long_docs, own, out="found").collect()
    assert {r["doc_id"]: r["found"] for r in rows} == {i: toxicity.score_text(t or "", own) for i, t in long_texts}
    many = ("class clown, idiot and moron. ") * 30_000
    assert len(toxicity.hits(many, own)) == 60_000


def test_pipeline_stages(spark, long_docs, long_texts, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = long_docs.withColumn("n_chars", long_docs.id)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == [*long_docs.columns, "n_chars"]
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    # Of the two long proses the one with the smaller id stays, of the white and the null text the longer one.
    assert set(texts) == {1, 3, 4, 5, 6, 7} and texts[3] == "[SECRET]" and texts[4] == "z" * 1_000_000
    ids = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode("short", add_special_tokens=False).ids, 0]))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert [r["ids_crc32"] for r in packed if r["doc_id"] == 7] == [ids] and max(r["length"] for r in packed) == packing.CAPACITY
