import hashlib
import io
import random
import wave
import zlib

from pyspark.sql import functions as F

from tarn.llm import chunks


def wanted(i, text):
    raw = (text or "").encode()
    data = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(data)
    media = out.getvalue()
    return i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest()


COLUMNS = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def check(rows, given):
    assert sorted((wanted(*g) for g in given), key=str) == sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str)
    assert len({(r["media_sha256"], r["feature"]) for r in rows}) == len({r["media_sha256"] for r in rows})


def test_all_kinds_of_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(chunks.op9_media(spark, str(tmp_path)).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_corpus(spark, texts):
    check(chunks.op9_media(spark, "/root/testdata/sf0.001").collect(), list(texts.items()))


def test_shared_chunks_are_stored_once(spark):
    rng = random.Random(5)
    passage = rng.randbytes(60_000)
    rows = [(i, rng.randbytes(3000) + passage + rng.randbytes(2000)) for i in range(8)] + [(8, rng.randbytes(5000)), (9, b""), (10, None), (11, b"")]
    df = spark.createDataFrame(rows, "id long, media binary")
    store = chunks.store_media(df, "id", "media")
    stored = store.whole.select(F.sum(F.octet_length("data"))).first()[0] + store.chunks.select(F.sum(F.octet_length("data"))).first()[0]
    assert stored < 60_000 + 8 * (5000 + 4 * chunks.MOST)
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    got = {bytes(r["media_id"]): bytes(r["data"]) for r in chunks.load_media(store).collect()}
    assert got == {hashlib.sha256(m or b"").digest(): m or b"" for _, m in rows}
    assert store.manifest.count() == len(rows)


def test_empty_table(spark):
    store = chunks.store_media(spark.createDataFrame([], "id long, media binary"), "id", "media")
    assert chunks.load_media(store).count() == 0


def test_cuts_follow_content():
    rng = random.Random(1)
    body = rng.randbytes(50_000)
    ends = chunks.cuts(body)
    assert ends[-1] == len(body) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) <= chunks.MOST and all(s >= chunks.LEAST for s in sizes[:-1])
    moved = chunks.cuts(rng.randbytes(700) + body)
    assert len({e - 700 for e in moved} & set(ends)) > len(ends) * 0.7
    assert chunks.cuts(b"") == [0] and chunks.cuts(b"a" * 20_000)[-1] == 20_000
    hash_at = 0
    for byte in body[100:132]:
        hash_at = ((hash_at << 1) + int(chunks._GEAR[byte])) & 0xFFFFFFFF
    gear = chunks._GEAR[list(body[:200])]
    for k in (1, 2, 4, 8, 16):
        gear[k:] = gear[k:] + (gear[:-k] << k)
    assert int(gear[131]) == hash_at


def test_the_field_grows_with_what_repeats_up_to_its_bound():
    assert [chunks.field_bits(n) for n in (0, 1, 1000, 100_000, 10**9)] == [16, 16, 18, 25, 27]
    assert chunks._slot(b"\xff" * 20) == (1 << 27) - 1 and chunks._slot(bytes(20)) == 0
