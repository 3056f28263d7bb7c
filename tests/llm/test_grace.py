import hashlib
import random

import pytest

from tarn.llm import grace


def plain(rows):
    """(doc_id, keep_id, group_size, sha) by a dictionary."""
    groups = {}
    for i, t in rows:
        key = "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for key, own in groups.items():
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(x[3], min(own)[3], len(own), sha) for x in own]
    return sorted(out, key=str)


def test_query_against_a_dictionary(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = grace.op4_exact_dedup(spark, str(tmp_path)).collect()
    assert plain([(r["doc_id"], r["text"]) for r in docs.collect()]) == sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in rows})
    eight = [r["kept"] for r in rows if r["doc_id"] == 8]
    assert len(eight) == 2 and not any(eight)


def test_rows_that_stay_keep_their_columns(docs, empty):
    kept = grace.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "6", "7", "None", "9", "10", "11", "12", "13"])
    assert grace.keep_first_copies(empty).count() == 0


def test_spilling_gives_what_a_table_gives():
    rng = random.Random(1)
    words = [rng.randbytes(50) for _ in range(400)] + [b"hot"]
    records = []
    for i in range(3000):
        content = words[-1] if i % 3 == 0 else rng.choice(words)
        records.append((hashlib.sha256(content).digest(), content, (0, False, i), 1, i))
    whole = sorted((e[0], e[3], e[4]) for e in grace.fold_all(iter(records), 1 << 30))
    spilled = sorted((e[0], e[3], e[4]) for e in grace.fold_all(iter(records), 3000))
    assert whole == spilled and sum(e[1] for e in whole) == 3000


def test_contents_are_compared():
    table = grace.ContentTable()
    table.fold(b"k" * 32, b"one", (0,), 1, None)
    with pytest.raises(ValueError, match="two contents"):
        table.fold(b"k" * 32, b"two", (0,), 1, None)
