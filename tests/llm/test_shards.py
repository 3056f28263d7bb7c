import zlib

from tarn.llm.shards import balanced_shards


def check(df, shards):
    rows = balanced_shards(df, shards).collect()
    given = sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in df.select("doc_id", "text").collect())
    found = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in found] == given
    total, before, slots = sum(g[3] for g in given), 0, {}
    for r in found:
        assert r["shard"] == min(shards - 1, (2 * before + r["size"]) * shards // (2 * total))
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        before += r["size"]
    return found


def test_against_a_running_sum(docs, corpus, empty):
    check(docs, 3)
    found = check(corpus, 8)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    largest = max(r["size"] for r in found)
    assert max(sizes) - min(sizes) <= 2 * largest
    assert balanced_shards(empty).count() == 0


def test_one_id_for_all_rows(spark):
    df = spark.range(500).selectExpr("1L AS doc_id", "repeat('ab', cast(id % 7 AS int)) AS text")
    check(df, 8)
