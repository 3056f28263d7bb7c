"""Best-fit packing of tokenized documents into sequences.

The plan is made on the histogram of lengths alone, which has at most ``capacity`` rows at any size of input: lengths
above a third of the capacity are matched greedily, two a bin at most; shorter ones go, longest first, to the smallest
gap that holds them. Documents then find their place by their rank among documents of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, vocabulary, written
from tarn.llm.wordpieces import Encoder

CAPACITY = 2048


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int, int]]:
    """Bins of one or two large items: (contents, gap, bins), contents as (length, copies) pairs.

    The longest unmatched length takes the longest partner that still fits beside it.
    """
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    lengths = sorted(left)
    bins = []
    while lengths:
        n = lengths[-1]
        at = bisect_left(lengths, capacity - n + 1) - 1
        if at < 0:
            bins.append((((n, 1),), capacity - n, left[n]))
            lengths.pop()
            continue
        p = lengths[at]
        pairs = left[n] // 2 if p == n else min(left[n], left[p])
        if not pairs:  # a single one is left of n, and n was its own longest partner
            if at == 0:
                bins.append((((n, 1),), capacity - n, left[n]))
                lengths.pop()
                continue
            p, pairs = lengths[at - 1], 1
        bins.append((((n, 2),) if p == n else ((n, 1), (p, 1)), capacity - n - p, pairs))
        for x in (n, p):
            left[x] -= pairs
        lengths = [x for x in lengths if left[x]]
    return bins


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """(contents, bins) for all items of the histogram; contents as (length, copies) pairs in the order of placement."""
    by_gap: dict[int, list] = defaultdict(list)
    gaps: list[int] = []

    def put(contents: tuple, gap: int, bins: int) -> None:
        if not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append((contents, bins))

    for contents, gap, bins in match_large(counts, capacity):
        put(contents, gap, bins)
    for n in sorted((n for n, c in counts.items() if 3 * n <= capacity and c), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                k = capacity // n
                if left // k:
                    put(((n, k),), capacity - k * n, left // k)
                if left % k:
                    put(((n, left % k),), capacity - (left % k) * n, 1)
                break
            gap = gaps.pop(at)
            k = gap // n
            held, by_gap[gap] = by_gap[gap], []
            for contents, bins in held:
                full = min(bins, left // k)
                if full:
                    put((*contents, (n, k)), gap - k * n, full)
                left, bins = left - full * k, bins - full
                if bins and left:  # fewer than k are left
                    put((*contents, (n, left)), gap - left * n, 1)
                    left, bins = 0, bins - 1
                if bins:
                    put(contents, gap, bins)
    return [x for held in by_gap.values() for x in held]


def slots_of(bins: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """The places for each length: items ranked from ``low`` fill ``bins`` sequences from ``sequence``, ``copies`` in each from ``offset``."""
    rows, taken, sequence = [], defaultdict(int), 0
    for contents, n_bins in bins:
        offset = 0
        for n, copies in contents:
            rows.append((n, taken[n], copies, sequence, offset))
            taken[n] += n_bins * copies
            offset += n * copies
        sequence += n_bins
    rows.sort()
    return dict(zip(("length", "low", "copies", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


PIECES = T.StructType(
    [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())]
)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """Each document's ids and a closing 0, cut into pieces of ``capacity``; ``local`` ranks a piece in its partition among those of its length."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], *PIECES.fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), defaultdict(int), Encoder(vocabulary(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for row, ids in enumerate(encode(batch.column(1))):
                ids += bytes(4)
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    n = len(own) // 4
                    rows.append((row, piece, start // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, arrow[i + 1].type) for i, c in enumerate(columns[1:]))], schema=arrow)

    return slim.mapInArrow(cut, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; only longer documents are cut.

    Returns a row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the closing id alone, one token. Rows that repeat, and null ids, are packed like any other.
    An empty table gives no rows. Further columns of the input play no part. A very long text is tokenized as a whole in
    one task and cut into as many pieces as it takes.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(slots_of(plan_bins(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        first = {int(n): int(i) for n, i in zip(*np.unique(s["length"], return_index=True), strict=True)}
        ends = np.unique(s["length"], return_index=True)[1].tolist()[1:] + [len(s["length"])]
        ends = dict(zip(first, ends, strict=True))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = first[n] + np.searchsorted(s["low"][first[n] : ends[n]], rank[own], side="right") - 1
            nth = rank - s["low"][at]
            copies = s["copies"][at]
            sequence, offset = s["sequence"][at] + nth // copies, s["offset"][at] + nth % copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
