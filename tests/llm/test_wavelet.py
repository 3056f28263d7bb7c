import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm.common import fresh_path, vocabulary, written
from tarn.llm.wavelet import BLOCK, Shard, counts, occurrences, op13_wavelet, pack_shard, read_documents, with_starts, write_shards

SF = "/root/testdata/sf0.001"


def listed(*tokens):
    return pa.RecordBatch.from_arrays([pa.array(range(len(tokens)), pa.int64()), pa.array(tokens, pa.int64())], names=["id", "tokens"])


@pytest.mark.parametrize(("n", "most", "seed"), [(0, 1, 0), (1, 1, 1), (1, 50000, 2), (700, 3, 3), (3000, 49408, 4), (3 * BLOCK + 5, 300, 5), (2 * BLOCK, 70000, 6)])
def test_shard_answers_as_the_sequence_does(n, most, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, n) - 1, most - 1).astype("<u4")
    shard = Shard(pack_shard(ids, listed(n), 7, 3))
    assert (shard.part, shard.nth, shard.length) == (7, 3, n) and (shard.ids() == ids).all()
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert shard[i] == ids[i]
    for token in {0, 1, most - 1, most + 5, *(ids[:5].tolist() if n else [])}:
        places = np.flatnonzero(ids == token)
        assert shard.occurrences(token).tolist() == places.tolist() and shard.count(token) == len(places)
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n)):
            assert shard.count(token, a, b) == (ids[a:b] == token).sum()
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert shard.select(token, k) == places[k]
        with pytest.raises(IndexError):
            shard.select(token, len(places))


def test_ids_of_zero_bits_and_damage():
    content = pack_shard(np.zeros(100, "<u4"), listed(60, 40))
    shard = Shard(content)
    assert shard.planes == [] and shard.ids().tolist() == [0] * 100 and shard.occurrences(0).tolist() == list(range(100)) and shard.count(1) == 0
    for bad in (content[:-1], b"X" + content[1:], content[:-1] + b"\1"):
        with pytest.raises(ValueError):
            Shard(bad)


def expected(rows):
    """Plain: every row's ids with the library, in order."""
    own, start, out = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0, []
    for i, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 20])
def test_all_kinds_of_rows(spark, docs, shard_tokens):
    path = write_shards(docs, fresh_path(spark, "test"), shard_tokens=shard_tokens)
    rows = with_starts(written(read_documents(spark, path), "test")).orderBy("start").collect()
    given = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == expected(given)
    files = spark.read.format("binaryFile").load(path).count()
    assert files >= (len(given) if shard_tokens == 1 else 1)
    wanted = {}
    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i, text in given:
        for place, t in enumerate([*own.encode(text or "", add_special_tokens=False).ids, 1]):
            wanted.setdefault(t, []).append((i is None, i or 0, place))
    tokens = [1, *sorted(wanted, key=lambda t: -len(wanted[t]))[:5], 49405, 60000]
    found = {}
    for r in occurrences(spark, path, tokens).collect():
        found.setdefault(r["token"], []).append((r["id"] is None, r["id"] or 0, r["place"]))
    assert {t: sorted(p) for t, p in found.items()} == {t: sorted(wanted[t]) for t in tokens if t in wanted}
    assert {r["token"]: r["n"] for r in counts(spark, path, tokens).collect()} == {t: len(wanted.get(t, ())) for t in tokens}


def test_empty_table_and_ids_of_text(spark, docs, empty):
    path = write_shards(empty, fresh_path(spark, "test"))
    assert with_starts(written(read_documents(spark, path), "test")).count() == 0
    named = docs.select(F.format_string("d%s", "doc_id").alias("name"), "text")
    path = write_shards(named, fresh_path(spark, "test"), id_col="name")
    rows = with_starts(written(read_documents(spark, path, named.schema["name"].dataType), "test")).orderBy("start").collect()
    assert [r["id"] for r in rows] == sorted(r["name"] for r in named.collect())
    assert sorted((r["id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((i, n, crc) for i, _, n, crc in expected((r["name"], r["text"]) for r in named.collect()))


def test_query_agrees_with_the_library(spark, texts):
    rows = op13_wavelet(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == expected(sorted(texts.items()))


def test_a_document_longer_than_a_shard(spark):
    long = spark.createDataFrame([(1, "some words and others " * 50_000), (2, None), (3, "end")], "doc_id long, text string")
    path = write_shards(long, fresh_path(spark, "test"), shard_tokens=1000)
    rows = with_starts(written(read_documents(spark, path), "test")).orderBy("start").collect()
    assert [(r["id"], r["start"], r["n_tokens"]) for r in rows] == [(1, 0, 200_001), (2, 200_001, 1), (3, 200_002, 2)]
