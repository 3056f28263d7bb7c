import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm.spelling import lower_ascii, near_words, op11_spelling, planted_words, spelling_forms

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    """Exactly one letter inserted, deleted or replaced, by walking both words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_forms(counts, factor=2):
    """All words against all of lengths within one."""
    by_length, near = defaultdict(list), {}
    for w in counts:
        by_length[len(w)].append(w)
    for w in counts:
        near[w] = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_apart(w, v)]
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def test_random_words_and_anagrams(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(500)} | {"", "ballll", "balll", "ball", "bally", "x" * 3000, "x" * 3001, "日本語", "日本", "日本誤", "🙂a", "a🙂", "🙂"}
    # A class of anagrams with very many words, all of them a letter from one another's neighbours.
    words |= {"".join(rng.sample("stonehearted", 12)) for _ in range(400)}
    counts = {w: rng.choice([1, 2, 3, 5, 9, 20, 41, 100]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling_forms(df).collect()) == plain_forms(counts)


def test_pairs_come_once_in_each_direction(spark):
    words = spark.createDataFrame([(w, i) for i, w in enumerate(["aab", "ab", "abb", "b", "bb", "ba", "aaab", "c"])], "word string, n long")
    pairs = [(r["word"], r["near"]) for r in near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) and {(b, a) for a, b in pairs} == set(pairs)
    own = [r["word"] for r in words.collect()]
    assert set(pairs) == {(a, b) for a in own for b in own if one_apart(a, b)}


def test_nulls_repeats_chains_and_no_rows(spark):
    rows = [(None, 5, "x"), ("abcde", 1, "x"), ("abcde", 2, "y"), ("abcd", 6, None), ("abc", 12, "x"), ("ab", 24, "x"), ("a", 48, "x"), ("zzzzz", 7, "x"), ("zzzzy", 13, "x"), ("zzzzx", 14, "a"), ("zzzzw", 14, "a")]
    df = spark.createDataFrame(rows, "word string, n long, key string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_forms(df).collect()}
    assert got["abcde"] == ("abcd", "a", 3, 1, 6) and got["a"] == (None, "a", 48, 1, None) and got["ab"] == ("a", "a", 24, 2, 48)
    assert got["zzzzz"] == ("zzzzw", "zzzzw", 7, 3, 14) and got["zzzzy"] == (None, "zzzzy", 13, 3, None) and len(got) == 9
    assert spelling_forms(df.limit(0)).count() == 0


def planted(rows):
    out = []
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            at = h % len(run)
            out.append(run[:at] + run[at + 1 :] if h % 97 == 0 else run)
    return [w for w in out if len(w) >= 5]


def test_planted_words_of_all_kinds_of_rows(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, "ÀÉÎõÿ×÷ßtraße K\u212aelvin İstanbul ſharp " + "Wörter " * 200) for i in range(20, 40)], "doc_id long, text string"))
    found = Counter(r["word"] for r in planted_words(more).collect() if len(r["word"]) >= 5)
    assert found == Counter(planted((r["doc_id"], r["text"]) for r in more.collect()))
    assert spark.createDataFrame([("ÀBÉ\u212aK",)], "t string").select(lower_ascii(F.col("t")).alias("t")).first()["t"] == "ÀbÉ\u212ak"


@pytest.mark.parametrize("folder", [SF])
def test_query_agrees_with_all_pairs(spark, folder, texts):
    counts = {w: n for w, n in Counter(planted(texts.items())).items() if n >= 3}
    assert sorted(tuple(r) for r in op11_spelling(spark, folder).collect()) == plain_forms(counts)


def test_a_text_of_a_megabyte(spark):
    df = spark.createDataFrame([(1, "Thanks " * 150_000 + "x" * 100_000)], "doc_id long, text string")
    found = {r["word"]: r["n"] for r in planted_words(df).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == Counter(planted([(1, "Thanks " * 150_000 + "x" * 100_000)]))
