"""A media column stored as content-defined chunks.

A rolling gear hash cuts payloads where their content says so, so that media which share passages share chunks. Chunk
digests are counted and deduplicated by Spark joins. A payload none of whose chunks occurs elsewhere is one row, with
its chunks side by side; chunks that occur more than once are stored once each, and ordered lists of digests say how the
other payloads are put together. Reading puts them together again and verifies each payload's digest.

Which digests occur more than once is handed to the writing tasks as a bit field of fixed size. A bit set by another
digest only sends a payload the longer way, so results don't depend on the field's size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, written

#: Bytes of a chunk: least, and most. A cut is where the hash's upper bits are zero, once in 2**CUT_BITS bytes.
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bits of the field of repeated digests: SPARSE for each, rounded up to a power of two between the powers given. It has 16 MiB at most, whatever the input.
SPARSE, FIELD_BITS = 256, (16, 27)
_GEAR = np.random.default_rng(1_013).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``, in order; the last is its length. The hash at a byte covers it and 31 before."""
    gear = _GEAR[np.frombuffer(raw, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(gear) > k:
            gear[k:] = gear[k:] + (gear[:-k] << np.uint32(k))
    places = np.flatnonzero(gear >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, start = [], 0
    while len(raw) - start > LEAST:
        at = np.searchsorted(places, start + LEAST)
        end = min(int(places[at]) if at < len(places) else len(raw), start + MOST, len(raw))
        ends.append(end)
        start = end
    if start < len(raw) or not ends:
        ends.append(len(raw))
    return ends


def chunks_of(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk."""
    ends = cuts(raw)
    parts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(hashlib.sha256(p).digest()[:20], p) for p in parts]


def _slot(digest: bytes) -> int:
    """A digest's place in the largest field; in a smaller one it is that of the upper bits."""
    return int.from_bytes(digest[:4], "big") >> (32 - FIELD_BITS[1])


def field_bits(repeated: int) -> int:
    """Bits of an address in a field for so many digests."""
    return min(max(math.ceil(math.log2(max(1, SPARSE * repeated))), FIELD_BITS[0]), FIELD_BITS[1])


@dataclass(frozen=True)
class MediaStore:
    """Where the tables of one stored column are: manifest (id, media_id, digests), whole payloads, shared chunks."""

    manifest: DataFrame
    whole: DataFrame
    chunks: DataFrame


def store_media(media: DataFrame, id_col: str, media_col: str) -> MediaStore:
    """Stores the binary column ``media_col``; a null is an empty payload.

    ``media`` is read three times; only chunks that may be repeated are shuffled. Equal payloads (ties) share their media_id
    (SHA-256) and everything that is stored of them. Repeated rows and null ids keep their rows in the manifest. An empty
    table gives empty tables. A very long payload is cut like any other: a task holds it, and four bytes for each of its own.
    """
    spark = media.sparkSession
    bound_batches(spark)
    slim = media.select(F.col(id_col).alias("id"), F.coalesce(F.col(media_col), F.lit(b"")).alias("media"))
    digests = T.ArrayType(T.BinaryType())
    manifest_schema = T.StructType([slim.schema["id"], T.StructField("media_id", T.BinaryType()), T.StructField("digests", digests), T.StructField("slots", T.ArrayType(T.IntegerType()))])
    manifest_arrow = to_arrow_schema(manifest_schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = [], []
            for raw in batch.column(1).to_pylist():
                ids.append(hashlib.sha256(raw).digest())
                lists.append([d for d, _ in chunks_of(raw)])
            slots = [[_slot(d) for d in x] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, manifest_arrow[i + 1].type) for i, c in enumerate((ids, lists, slots)))], schema=manifest_arrow)

    manifest = written(slim.mapInArrow(index, manifest_schema), "manifest")
    pairs = manifest.select(F.explode(F.arrays_zip("digests", "slots")).alias("c")).select("c.digests", "c.slots")
    repeated = written(pairs.groupBy("digests", "slots").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slots"), "repeated")
    bits = field_bits(repeated.count())
    left_out = FIELD_BITS[1] - bits
    words = repeated.select(F.shiftright("slots", left_out).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)  # and so many rows at most were gathered
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    field = spark.sparkContext.broadcast(table)

    def repeats(parts: list[tuple[bytes, bytes]]) -> bool:
        slots = np.array([_slot(d) for d, _ in parts]) >> left_out
        return bool(((field.value[slots >> 6] >> (slots & 63)) & 1).any())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hashlib.sha256(raw).digest(), raw) for raw in batch.column(1).to_pylist() if not repeats(chunks_of(raw))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["media_id", "data"])

    def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # what a task repeats itself needn't leave it twice
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                parts = chunks_of(raw)
                if repeats(parts):
                    rows += [part for part in parts if part[0] not in done]
                    done.update(d for d, _ in parts)
            if len(done) > 100_000:
                done.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["digest", "data"])

    whole = written(slim.mapInArrow(alone, "media_id binary, data binary"), "whole")
    chunks = written(slim.mapInArrow(in_chunks, "digest binary, data binary").groupBy("digest").agg(F.min("data").alias("data")), "chunks")
    return MediaStore(manifest.drop("slots"), whole, chunks)


def load_media(store: MediaStore) -> DataFrame:
    """(media_id, data) of every distinct payload, put together from its chunks and verified against its media_id."""
    spark = store.manifest.sparkSession
    bound_batches(spark)
    schema = T.StructType([T.StructField("media_id", T.BinaryType()), T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _verified(media_id, raw)
            yield batch

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, done = None, [], []
        for batch in batches:
            for media_id, _, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if media_id != now:
                    if parts:
                        done.append((now, _verified(now, b"".join(parts))))
                    now, parts = media_id, []
                parts.append(raw)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done, strict=True)], schema=arrow)
                done = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([_verified(now, b"".join(parts))], pa.binary())], schema=arrow)

    distinct = store.manifest.groupBy("media_id").agg(F.min("digests").alias("digests"))  # copies meet in the tasks first
    lists = distinct.join(store.whole.select("media_id"), "media_id", "left_anti")
    ordered = lists.select("media_id", F.posexplode("digests").alias("place", "digest")).join(store.chunks, "digest").select("media_id", "place", "data")
    joined = ordered.repartition("media_id").sortWithinPartitions("media_id", "place").mapInArrow(put_together, schema)
    return store.whole.mapInArrow(verify, schema).unionByName(joined)


def _verified(media_id: bytes, raw: bytes) -> bytes:
    if hashlib.sha256(raw).digest() != media_id:
        raise ValueError(f"the chunks of {media_id.hex()} don't give its payload")
    return raw


def _hex_le32(n: Column) -> Column:
    """Eight hexadecimal digits of a number, its lowest byte first."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])


def wav_of(text: Column) -> tuple[Column, Column]:
    """A WAV file of 8-bit samples at 8 kHz whose data are the text's bytes, filled with spaces to a multiple of 192; and the bytes before that."""
    text = F.coalesce(text, F.lit(""))
    n = F.octet_length(text)
    size = F.greatest(F.ceil(n / 192), F.lit(1)).cast("int") * 192
    # Fixed values of the format: PCM, one channel, 8000 samples and bytes a second, a byte a sample, 8 bits each.
    header = F.unhex(F.concat(F.lit("52494646"), _hex_le32(size + 36), F.lit("57415645666d74201000000001000100401f0000401f00000100080064617461"), _hex_le32(size)))
    return F.concat(header, text.cast("binary"), F.repeat(F.lit(" "), size - n).cast("binary")), n.cast("long")


HEADER = 44


def sample_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored WAV files (media_id, data); the features are whole numbers over the samples.

    feature: sum, sum of squares, changes of side around the middle level, least and greatest sample.
    """
    target = T.StructType.fromDDL("media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    arrow = to_arrow_schema(target)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = raw[HEADER:]
                x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
                turns = int(np.count_nonzero(np.diff(x >= 128)))
                rows.append((media_id, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{x.sum()}:{(x * x).sum()}:{turns}:{x.min()}:{x.max()}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[i].type) for i, c in enumerate(zip(*rows, strict=True))], schema=arrow)

    return media.mapInArrow(measure, target)


def op9_media(spark, sf_dir: str) -> DataFrame:
    """All documents as WAV files, chunked, stored, read back and measured."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wav, n_bytes = wav_of(F.col("text"))
    media = docs.select(F.struct("doc_id", n_bytes.alias("n_bytes")).alias("id"), wav.alias("media"))
    store = store_media(media, "id", "media")
    found = sample_features(load_media(store))
    rows = store.manifest.select(F.col("id.doc_id").alias("doc_id"), F.col("id.n_bytes").alias("n_bytes"), "media_id")
    return rows.join(found, "media_id").drop("media_id")
