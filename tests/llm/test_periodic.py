import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm.periodic import factors, op12_periodic_runs, periodic_runs, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(w, exponent=4, least=6):
    """Every period over the whole sequence: begin, length, period."""
    n, out = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda x: (x[0], x[2]))


def plain_factors(w):
    begin, out = 0, []
    while begin < len(w):
        most = 0
        for at in range(begin):
            k = 0
            while begin + k < len(w) and w[at + k] == w[begin + k]:
                k += 1
            most = max(most, k)
        out.append((begin, begin + max(1, most)))
        begin = out[-1][1]
    return out


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 7)), max_size=5)
sequences = st.one_of(st.lists(st.integers(0, 2), max_size=50), pieces.map(lambda parts: [x for part, n in parts for x in part * n]))


@settings(max_examples=500, deadline=None)
@given(sequences)
def test_factors_and_runs_of_any_sequence(w):
    found = list(factors(w))
    assert [x[:2] for x in found] == plain_factors(w)
    assert all(earlier < begin and (earlier < 0 or w[earlier : earlier + end - begin] == w[begin:end]) for begin, end, earlier in found)
    for exponent, least in ((2, 2), (3, 1), (4, 6), (2, 9)):
        assert runs_of(w, exponent, least) == plain_runs(w, exponent, least)


def test_long_sequences():
    rng = random.Random(5)
    block = [rng.randrange(900) for _ in range(300)]
    w = block * 5 + [1] * 2000 + block * 4 + [7, 8] * 900
    assert runs_of(w) == plain_runs(w)
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)] and runs_of(list(range(50_000))) == [] and runs_of([]) == []
    with pytest.raises(ValueError):
        runs_of([0], 1)


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_all_kinds_of_rows(docs, empty):
    rows = periodic_runs(docs).collect()
    assert len(rows) == docs.count() and periodic_runs(empty).count() == 0
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    wanted = []
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = plain_runs(words)
        wanted.append((r["doc_id"], len(words), runs, collapsed(words, runs)))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert next(r for r in found if r[0] == 11)[2] == [(1, 3000, 1)]


def test_very_long_text(spark):
    text = "one two three " * 60_000 + "end"
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 180_000, 3)] and row["collapsed"] == "one two three end"


def test_query_agrees_with_every_period_tried(spark, texts):
    wanted = []
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if at < a else words[a + (at - a) % p] for at, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(collapsed(words, runs))))
    rows = [tuple(r) for r in op12_periodic_runs(spark, SF).collect()]
    assert sorted(rows) == sorted(wanted) and sum(r[1] for r in rows) > 5
