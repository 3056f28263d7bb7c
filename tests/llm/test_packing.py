import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarn.llm.common import vocabulary
from tarn.llm.packing import match_large, pack, plan_bins, slots_of


def check(rows, texts, capacity=2048):
    """rows of pack(): every document's ids in pieces, bins full without gaps. texts: (id, text) in any order."""
    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    wanted = []
    for i, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(wanted, key=key) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_bin in bins.values():
        at = 0
        for offset, length in sorted(own_bin):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in wanted)


def test_all_kinds_of_rows(docs, empty):
    rows = pack(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pack(empty).count() == 0


def test_corpus_needs_hardly_more_bins_than_tokens(corpus, texts):
    bins, tokens = check(pack(corpus).collect(), texts.items())
    assert bins <= -(-tokens // 2048) + 3


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = bisect_left(gaps, n)
            insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_length(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 500, 40), strict=True)}
    bins = plan_bins(counts, 100)
    placed = defaultdict(int)
    for contents, n in bins:
        assert sum(length * k for length, k in contents) <= 100
        assert sum(k for length, k in contents if 3 * length > 100) <= 2
        for length, k in contents:
            placed[length] += n * k
    assert placed == counts
    assert sum(n for _, n in bins) <= best_fit_decreasing(counts, 100)
    slots = slots_of(bins)
    assert all(len(v) == len(slots["low"]) for v in slots.values())


def test_large_items_are_paired():
    assert match_large({60: 2, 40: 3}, 100) == [(((60, 1), (40, 1)), 0, 2), (((40, 1),), 60, 1)]
    assert plan_bins({50: 3}, 100) == [(((50, 2),), 1), (((50, 1),), 1)]
