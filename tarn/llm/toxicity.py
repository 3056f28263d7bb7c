"""Toxicity of texts by a weighted lexicon.

Texts are folded first: lower case, look-alike letters and digits to plain Latin letters; accents of their own and marks
without width go. Offsets are of the text as it was. An Aho-Corasick automaton then finds the lexicon's entries at the beginnings of words; entries inside
an exception phrase don't count. Weighted hits, and hits for the length of the text, give the score by a logistic curve.
Entries, weights and the curve are learned from labelled rows; a short base lexicon stands where there are too few.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, written

#: Labelled rows that learning reads at most, the first by a hash of their ids. A fit needs no more at any size of input.
LABELLED_ROWS = 20_000
#: Entries of a learned lexicon at most.
ENTRIES = 2_000
#: An entry occurs in so many toxic texts at least, and in this part of them: one text's copies make no entry.
LEAST_TEXTS, SUPPORT = 3, 0.02
#: Beginnings of words that are tried as entries, in characters.
SHORTEST, LONGEST = 4, 9

BASE = {w: 1.0 for w in ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "asshole", "bitch")}
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("class clown", "clown fish", "clownfish", "trash can", "trash bin", "trash bag", "idiot proof", "stupid simple", "moron mountain", "pond scum")

#: Cyrillic and Greek letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухівкмнтіјѕԁɡαβεικνορτυχ", "aeopcyxibkmhtijsdgabeiknoptux", strict=False))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


@functools.cache
def _table() -> dict[int, str]:
    """Each character's folded form; what folds to no letter of a to z becomes a space."""
    table = {}
    for point in (*range(0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(point))[:1].lower()
        plain = SIGNS.get(plain, plain)
        special = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ł": "l"}.get(chr(point).lower(), plain)
        table[point] = special if "a" <= special <= "z" else " "
    table |= {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1} | {ord(k): v for k, v in LOOKALIKES.items()}
    return table | {ord(k): v for k, v in SIGNS.items()}


#: Characters that folding leaves out: soft hyphens, combining accents, marks without width, variation selectors.
UNSEEN = re.compile("[\u00ad\u0300-\u036f\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def fold(text: str) -> str:
    """The text with one folded character for each of its own but the unseen ones. Letters of other scripts stay as they are."""
    return UNSEEN.sub("", text).translate(_table())


def _places(text: str) -> Sequence[int]:
    """Where each folded character stands in ``text``; and, for the end, its length."""
    if UNSEEN.search(text) is None:
        return range(len(text) + 1)
    return [i for i, ch in enumerate(text) if UNSEEN.match(ch) is None] + [len(text)]


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, and the curve: bias, weight of log hits, weight of hits for each hundred words."""

    entries: tuple[tuple[str, float], ...] = tuple(BASE.items())
    curve: tuple[float, float, float] = (-2.0, 4.0, 0.5)
    exceptions: tuple[str, ...] = EXCEPTIONS


@functools.lru_cache(maxsize=4)
def _automaton(entries: tuple, exceptions: tuple):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in exceptions:
        automaton.add_word(f" {fold(phrase)}", (len(phrase), None))
    for entry, weight in entries:
        automaton.add_word(f" {entry}", (len(entry), weight))
    automaton.make_automaton()
    return automaton


def hits(text: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon's entries, one for each word, the heaviest; offsets are of the text."""
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in _automaton(lexicon.entries, lexicon.exceptions).iter(" " + fold(text)):
        start = end - length
        if weight is None:
            spared.append((start, end))
        elif start not in found or found[start][1] < weight:
            found[start] = end, weight
    if not found:
        return []
    spared.sort()
    reach = list(accumulate((e for _, e in spared), max))  # the furthest end of the phrases up to each
    place = _places(text)
    out = []
    for start, (end, weight) in found.items():
        before = bisect_right(spared, (start, len(text))) - 1
        if before < 0 or reach[before] < end:
            out.append((place[start], place[end - 1] + 1, weight))
    return out


def features(text: str, lexicon: Lexicon) -> tuple[float, float]:
    """log(1 + weighted hits), and weighted hits for each hundred words, ten at most."""
    total = sum(h[2] for h in hits(text, lexicon))
    if not total:
        return 0.0, 0.0
    return math.log1p(total), min(10.0, 100.0 * total / max(20, len(text.split())))


def score_text(text: str, lexicon: Lexicon) -> float:
    x, y = features(text, lexicon)
    a, b, c = lexicon.curve
    z = a + b * x + c * y
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _fit_curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(3), x.T @ (toxic - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS, entries: int = ENTRIES) -> Lexicon:
    """Learns a lexicon from ``labels`` (id, toxic 0 or 1) of ``docs``; ``rows`` and ``entries`` bound what it reads and keeps.

    Rows with a null id, label or text teach nothing. Without rows of both labels the base lexicon is returned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # so many rows at most are broadcast
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = written(text.join(F.broadcast(known), "id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "toxicity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w[:LONGEST] for w in fold(text).split() if len(w) >= SHORTEST}
                seen[bool(toxic)].update({w[:n] for w in words for n in range(SHORTEST, len(w) + 1)})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "clean": pa.array([seen[0][t] for t in terms], pa.int64()), "toxic": pa.array([seen[1][t] for t in terms], pa.int64())})

    sizes = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    terms = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    # A term has to be likelier in toxic texts by far more than the best of a million useless terms would be by chance.
    least = max(LEAST_TEXTS, round(SUPPORT * n_toxic))
    best = terms.where(F.col("toxic") >= least).withColumn("odds", odds).where((F.col("odds") > 2.5) & (F.col("toxic") * F.col("odds") > 14)).orderBy(F.col("toxic").desc(), "term").limit(entries)
    learned: dict[str, float] = {}
    seen = {}
    for row in sorted(best.collect(), key=lambda r: (len(r["term"]), r["term"])):  # ``entries`` rows at most
        term, weight = row["term"], float(row["odds"]) / 3
        seen[term] = row["toxic"]
        shorter = next((term[:n] for n in range(SHORTEST, len(term)) if term[:n] in learned), None)
        if shorter is None:
            learned[term] = weight
        elif weight > learned[shorter] + 0.2 and row["toxic"] >= 0.6 * seen[shorter]:  # the shorter one also begins harmless words
            del learned[shorter]
            learned[term] = weight
    merged = {w: 1.0 for w in BASE if not any(w.startswith(t) for t in learned)} | learned
    lexicon = Lexicon(tuple(sorted(merged.items())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0).cast(pa.int64()), "x": pa.array([v[0] for v in values], pa.float64()), "y": pa.array([v[1] for v in values], pa.float64())})

    got = np.array(sorted(tuple(r) for r in sample.mapInArrow(measure, "toxic long, x double, y double").collect()))  # ``rows`` rows at most
    return Lexicon(lexicon.entries, _fit_curve(got[:, 1:], got[:, 0]))


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out``: a score from 0 to 1.

    A null or empty text has no hits, and so the score of a text without any. Rows are scored one by one: repeated rows
    and null ids change nothing, and an empty table stays empty. A very long text is scored as a whole, in time linear in
    its length. Of entries that begin at one place the heaviest counts. ``out`` must not be a column of ``docs``.
    """
    if out.lower() in map(str.lower, docs.columns):
        raise ValueError(f"{out} is a column already")
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(t or "", lexicon) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=arrow)

    return docs.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learned from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learned_lexicon(docs: DataFrame, sf_dir: str) -> Lexicon:
    """The lexicon of the labels in ``sf_dir`` that may be learned from."""
    return learn(docs, docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, learned_lexicon(docs, sf_dir), out="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
