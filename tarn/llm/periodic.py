"""Runs of a text: stretches of words that repeat with a period and can't be extended, found in linear time.

A suffix automaton, built word by word, cuts the text into factors: each is the longest stretch that also begins earlier,
or a word that is new. A run that meets the border of two factors is found there from the longest common extensions on
either side, for every period that fits; a run inside of a factor stands in the factor's earlier occurrence as well, and is
copied from it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches
from tarn.llm.crc_sql import crc32_sql

#: Periods that a run holds at least, and its words.
EXPONENT, LEAST = 4, 6


def factors(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """The factors of a sequence: begin, end, and where an earlier occurrence begins (-1: the word is new). It may overlap the factor.

    A state of the automaton keeps its first transition in two lists and only further ones in a dict: most have one.
    """
    symbol, target, more = [-1], [0], {}
    link, length, first = [-1], [0], [-1]
    last = begin = seen_until = 0
    for i, c in enumerate(words):
        own = len(symbol)
        symbol.append(-1)
        target.append(0)
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p, q = last, -1
        while p >= 0:
            s = symbol[p]
            if s == c:
                q = target[p]
                break
            if s < 0:
                symbol[p], target[p] = c, own
            elif p not in more:
                more[p] = {c: own}
            elif c in more[p]:
                q = more[p][c]
                break
            else:
                more[p][c] = own
            p = link[p]
        if q >= 0:
            if length[p] + 1 != length[q]:
                copy = len(symbol)
                symbol.append(symbol[q])
                target.append(target[q])
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = copy
                while p >= 0:
                    if symbol[p] == c and target[p] == q:
                        target[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                q = copy
            link[own] = q
        last = own
        seen = length[link[own]]  # of the text so far, the longest end that also ends earlier
        if seen <= i - begin:
            if begin < i:
                yield begin, i, seen_until - (i - begin)
            begin = i
            if not seen:
                yield i, i + 1, -1
                begin = i + 1
        seen_until = first[link[own]] + 1
    if begin < len(words):
        yield begin, len(words), seen_until - (len(words) - begin)


def _common(pattern: list[int], text: list[int]) -> list[int]:
    """How much of ``pattern`` stands at each place of ``text``."""
    s = [*pattern, -1, *text]
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[len(pattern) + 1 :]


def _meeting(w: list[int], a: int, b: int, c: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Runs that meet the border b of the factors [a, b) and [b, c) and end before c: begin, end, period, in order of their periods.

    A run that begins a period or more before a would let [a, b) go on to the run's end: it meets a border before b that
    it belongs to. So a run here is shorter than both factors and a period, and its period is bounded by them.
    """
    most = (c - a - 1) // (exponent - 1)
    before, after = min(most, b), min(most, c - b)
    v, low, far = w[b:c], b - before, max(0, b - before - (b - a))
    forward = _common(v, w[low:c])
    backward = _common(w[a:b][::-1], w[far:b][::-1])
    ahead = _common(v, v)
    behind = _common(w[low:b][::-1], w[low : b + after][::-1])
    for p in range(1, most + 1):
        enough = max(least, exponent * p)
        if p <= before:
            back = backward[p] if p < len(backward) else 0
            begin, end = b - p - back, b + forward[before - p]
            if end - begin >= enough and back < b - a and (end < c or c == len(w) or w[c] != w[c - p]):
                yield begin, end, p
        if p <= after:
            back = behind[after - p]
            begin, end = b - back, b + p + (ahead[p] if p < len(ahead) else 0)
            if back < p and end - begin >= enough and (end < c or c == len(w) or w[c] != w[c - p]):
                yield begin, end, p


def runs_of(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a sequence: begin, length and smallest period, by begin and period. A run has ``exponent`` periods and ``least`` words or more.

    exponent is 2 or more. Words are numbers from 0.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    found: dict[int, dict[int, int]] = {}
    begins: list[int] = []

    def add(begin: int, end: int, period: int) -> None:
        if begin not in found:
            found[begin] = {}
            insort(begins, begin)
        found[begin][end] = min(period, found[begin].get(end, period))

    shortest = min(max(least, exponent * p) - p + 1 for p in range(1, least + 2))
    a = b = 0
    for begin, end, earlier in factors(words):
        a, b = b, begin
        if b and end - a >= shortest:
            for run in _meeting(words, a, b, end, exponent, least):
                add(*run)
        if earlier >= 0 and begins:
            moved, until, at = begin - earlier, earlier + end - begin, bisect_right(begins, earlier)
            while at < len(begins) and begins[at] < until:  # where the two overlap, what is copied is met again
                for stop, period in list(found[begins[at]].items()):
                    if stop < until:
                        add(begins[at] + moved, stop + moved, period)
                at += 1
    if len(words) - b >= shortest:
        for run in _meeting(words, b, len(words), len(words), exponent, least):
            add(*run)
    return [(begin, end - begin, p) for begin in begins for end, p in sorted(found[begin].items(), key=lambda x: x[1])]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The runs of each row's text and the text without them: id, n_words, runs (start, length, period, in words from 0), collapsed.

    Words are what stands between ASCII white space. Runs are in order of start, then period; of each run the first
    period stays in ``collapsed``, whose words are joined by single spaces. Runs may overlap: a word goes if any run has it
    after its first period.
    A null or empty text, and one of white space, has no words, no runs and collapses to the empty text. Rows that repeat
    are treated alike, null ids are ids like others, an empty table gives no rows, and further columns play no part. A very
    long text is taken apart as a whole, in one task, in time and memory in proportion to its words.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, runs, kept = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                number: dict[bytes, int] = {}
                own = runs_of([number.setdefault(x, len(number)) for x in words], exponent, least)
                if own:
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, length, period in own:
                        steps[start + period] += 1
                        steps[start + length] -= 1
                    words_kept = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                else:
                    words_kept = words
                sizes.append(len(words))
                runs += own
                ends.append(len(runs))
                kept.append(b" ".join(words_kept))
            columns = [pa.array(c, pa.int64()) for c in (zip(*runs, strict=True) if runs else ((), (), ()))]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), listed.cast(arrow.field("runs").type), pa.array(kept, pa.binary()).cast(arrow.field("collapsed").type)], schema=arrow)

    return slim.mapInArrow(take_apart, schema).withColumnRenamed("id", id_col)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The documents of ``op12_periodic_runs``: one in ten, by a hash of its id, has a part of its words in place of those behind it, again and again."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The words are the one element of an array: a lambda's variable is computed once, a column in it once for each word.
    return docs.select("doc_id", F.when(crc % 10 == 0, F.get(F.transform(F.array(words), planted), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, one in ten with planted repeats: the longest run, and digests of all and of what they leave."""
    found = periodic_runs(with_planted_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A run of words has five words at least that stand there again a period later, so words are joined by five in a row.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
f AS (SELECT doc_id, w, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p, h % 10 = 0 AND n > 0 AS planted FROM e),
v AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM f),
k AS (SELECT doc_id, i, w[i + 1] AS word, array_to_string(w[i + 1:i + 5], ' ') AS gram, len(w) AS n FROM v, unnest(range(len(w))) u(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND y.i + 5 <= y.n AND x.i + 5 <= x.n AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY doc_id, q, island) WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(lines.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM e LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
