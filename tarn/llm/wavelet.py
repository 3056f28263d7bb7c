"""Token ids of a corpus in shards that are wavelet matrices: one compressed file each, searchable as it is.

A shard holds the ids of whole documents in a row. Each bit of the ids, from the highest, is a plane; below each plane the
sequence goes on with the ids whose bit is 0 before those whose bit is 1. Planes are cut into blocks that are compressed
one by one, and each block's entry says how many ones come before it, so rank and select need one block of a plane: an id
at a place, how often an id occurs before it, and the places of an id are read without unpacking the other blocks.

File: a header, the documents (ids and numbers of tokens, an Arrow stream), and for each plane its zeros, the sizes and ones
of its blocks, and the blocks. The last byte is 0.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import blobs, bound_batches, fresh_path, vocabulary, write_blobs, written
from tarn.llm.wordpieces import Encoder
from tarn.operators.lookup import joinable

#: Tokens from which on a shard is closed, and bytes of text for which a range of documents is planned.
SHARD_TOKENS, RANGE_BYTES = 4 << 20, 64 << 20
#: Rows of an Arrow batch: the more texts, the fewer different words for each.
ROWS = 2048
#: Bits of a block of a plane.
BLOCK = 1 << 16
#: magic, planes, part, nth, tokens, bytes of the documents' stream.
HEAD = struct.Struct("<4sIIIQQ")
MAGIC = b"TWM1"


def planes_of(ids: np.ndarray) -> Iterator[np.ndarray]:
    """The planes of a sequence of ids, from the highest bit of its largest id, as arrays of booleans."""
    ids = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
    for bit in range(int(ids.max()).bit_length() - 1 if len(ids) else -1, -1, -1):
        ones = ids & ids.dtype.type(1 << bit) != 0
        yield ones
        ids = np.concatenate((np.compress(~ones, ids), np.compress(ones, ids)))


def pack_shard(ids: np.ndarray, documents: pa.RecordBatch, part: int = 0, nth: int = 0) -> bytes:
    """The file of a shard. documents: their ids, and how many of the ids in the sequence are theirs."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(documents)
    listed = sink.getvalue().to_pybytes()
    out, planes = [b"", listed], 0
    for ones in planes_of(ids):
        planes += 1
        bits = np.packbits(ones, bitorder="little")
        blocks = [squeeze(bits[at : at + BLOCK // 8].tobytes()) for at in range(0, len(bits), BLOCK // 8)]
        held = np.add.reduceat(np.bitwise_count(bits), range(0, len(bits), BLOCK // 8), dtype="<u8")
        out += [struct.pack("<QI", len(ones) - int(held.sum()), len(blocks)), np.array([len(b) for b in blocks], "<u4").tobytes(), (np.cumsum(held) - held).astype("<u8").tobytes(), *blocks]
    out[0] = HEAD.pack(MAGIC, planes, part, nth, len(ids), len(listed))
    return b"".join(out) + b"\0"


class _Plane:
    """One plane: its zeros, and blocks that are unpacked when they are asked for."""

    def __init__(self, raw: memoryview, at: int, length: int):
        self.length = length
        self.zeros, blocks = struct.unpack_from("<QI", raw, at)
        sizes = np.frombuffer(raw, "<u4", blocks, at + 12).astype(np.int64)
        self.ones_before = np.frombuffer(raw, "<u8", blocks, at + 12 + 4 * blocks).astype(np.int64)
        self.ends = at + 12 + 12 * blocks + np.cumsum(sizes)
        self.starts, self.raw, self.held = self.ends - sizes, raw, {}
        self.end = int(self.ends[-1]) if blocks else at + 12

    def block(self, k: int) -> np.ndarray:
        if k not in self.held:
            self.held[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[self.starts[k] : self.ends[k]], BLOCK // 8), np.uint8)
        return self.held[k]

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.concatenate([self.block(k) for k in range(len(self.starts))]), count=self.length, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK // 8]) >> i % 8 & 1

    def rank(self, i: int) -> int:
        """Ones before place i."""
        k, at = divmod(i, BLOCK)
        if k == len(self.starts):
            return self.length - self.zeros
        block = self.block(k)
        ones = int(self.ones_before[k]) + int(np.bitwise_count(block[: at // 8]).sum())
        return ones + (int(block[at // 8]) & (1 << at % 8) - 1).bit_count() if at % 8 else ones

    def select(self, bit: int, n: int) -> int:
        """The place of the n-th one or zero, from 0."""
        before = self.ones_before if bit else np.arange(len(self.starts)) * BLOCK - self.ones_before
        k = int(np.searchsorted(before, n, side="right")) - 1
        counts = np.bitwise_count(self.block(k)).astype(np.int64)
        until = np.cumsum(counts if bit else 8 - counts)
        n -= int(before[k])
        byte = int(np.searchsorted(until, n, side="right"))
        n -= int(until[byte - 1]) if byte else 0
        own = np.flatnonzero(np.unpackbits(self.block(k)[byte : byte + 1], bitorder="little") == bit)
        return k * BLOCK + 8 * byte + int(own[n])


class Shard:
    """A shard's file, opened: access, counting and occurrences of ids without unpacking what they don't touch."""

    def __init__(self, content: bytes):
        raw = memoryview(content)
        magic, planes, self.part, self.nth, self.length, listed = HEAD.unpack_from(raw)
        if magic != MAGIC or raw[-1] != 0:
            raise ValueError("this is no shard, or it is cut off")
        self.documents = pa.ipc.open_stream(raw[HEAD.size : HEAD.size + listed]).read_all().combine_chunks()
        at, self.planes = HEAD.size + listed, []
        for _ in range(planes):
            self.planes.append(_Plane(raw, at, self.length))
            at = self.planes[-1].end
        if at != len(raw) - 1:
            raise ValueError("this is no shard, or it is cut off")

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        token = 0
        for plane in self.planes:
            bit, ones = plane.get(i), plane.rank(i)
            token, i = token << 1 | bit, plane.zeros + ones if bit else i - ones
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id between two places stand below the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            a, b = plane.rank(start), plane.rank(end)
            start, end = (plane.zeros + a, plane.zeros + b) if token >> len(self.planes) - 1 - k & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs from place ``start`` to before ``end``."""
        a, b = self._range(token, start, self.length if end is None else end)
        return b - a

    def select(self, token: int, n: int) -> int:
        """The place of an id's n-th occurrence, from 0."""
        a, b = self._range(token, 0, self.length)
        if not 0 <= n < b - a:
            raise IndexError(n)
        i = a + n
        for k, plane in enumerate(reversed(self.planes)):
            bit = token >> k & 1
            i = plane.select(bit, i - plane.zeros if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, in order."""
        a, b = self._range(token, 0, self.length)
        places = np.arange(a, b)
        if len(places) <= 16:
            return np.array([self.select(token, n) for n in range(b - a)], dtype=np.int64)
        for k, plane in enumerate(reversed(self.planes)):
            places = np.flatnonzero(plane.bits())[places - plane.zeros] if token >> k & 1 else np.flatnonzero(~plane.bits())[places]
        return places

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        ids = np.zeros(self.length, dtype="<u2" if len(self.planes) <= 16 else "<u4")
        for k, plane in enumerate(reversed(self.planes)):
            ones = plane.bits()
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[: plane.zeros]
            above[np.flatnonzero(ones)] = ids[plane.zeros :] | ids.dtype.type(1 << k)
            ids = above
        return ids


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> str:
    """Writes the ids of all documents, each closed by ``end_id``, in the order of their ids, as shards below ``path``.

    A document is whole in one shard; a shard is closed at ``shard_tokens`` and is larger only by what its last document has.
    A null or empty text is its end id alone. Null ids come first; repeated ids are ordered by a hash of their texts, and
    wholly equal rows are interchangeable. Further columns of the input play no part. An empty table gives no shards.
    """
    spark = docs.sparkSession
    bound_batches(spark, ROWS)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    # Ranges over three columns: no run of equal ids can fill one of them.
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    listed = pa.schema([to_arrow_schema(T.StructType([ranged.schema["id"]])).field(0), pa.field("tokens", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, encode, end = TaskContext.get().partitionId(), 0, Encoder(vocabulary(tokenizer)), struct.pack("<I", end_id)
        ids: list[bytes] = []
        rows: list[pa.Array] = []
        held = 0

        def closed() -> pa.RecordBatch:
            documents = pa.RecordBatch.from_arrays([pa.concat_arrays(rows), pa.array([len(x) // 4 for x in ids], pa.int64())], schema=listed)
            content = pack_shard(np.frombuffer(b"".join(ids), "<u4"), documents, part, nth)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            begun = 0
            for row, own in enumerate(encode(batch.column(1))):
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    rows.append(batch.column(0).slice(begun, row + 1 - begun))
                    yield closed()
                    ids, rows, held, nth, begun = [], [], 0, nth + 1, row + 1
            if begun < batch.num_rows:
                rows.append(batch.column(0).slice(begun))
        if ids:
            yield closed()

    write_blobs(ranged.mapInArrow(shards, "content binary"), path)
    return path


def read_documents(spark, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """A row for each document of all shards below ``path``: id, part, nth (the shard, in order), local (tokens before it in its shard), n_tokens, ids_crc32.

    ``id_type`` is the type of the ids, long by default. Each shard is read whole by one task and unpacked once.
    """
    schema = T.StructType(
        [T.StructField("id", id_type or T.LongType()), T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )
    bound_batches(spark, 1)
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                raw = shard.ids().astype("<u4").view(np.uint8)
                tokens = shard.documents.column("tokens").to_numpy()
                ends = np.cumsum(tokens)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - tokens).tolist(), ends.tolist(), strict=True)]
                n = len(tokens)
                columns = [np.full(n, shard.part), np.full(n, shard.nth), ends - tokens, tokens, np.array(crcs, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([shard.documents.column(0).combine_chunks(), *(pa.array(c, pa.int64()) for c in columns)], schema=arrow)

    return blobs(spark, path).mapInArrow(parse, schema)


def occurrences(spark, path: str, tokens: list[int], id_type: T.DataType | None = None) -> DataFrame:
    """A row for each occurrence of the given ids in all shards: token, id (the document), place (in the document). No unpacking but of planes.

    Ids that don't occur give no rows; an id that is given twice counts once. Places are counted from 0.
    """
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("id", id_type or T.LongType()), T.StructField("place", T.LongType())])
    bound_batches(spark, 1)
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                ends = np.cumsum(shard.documents.column("tokens").to_numpy())
                starts = np.concatenate(([0], ends))
                for token in sorted(set(tokens)):
                    places = shard.occurrences(token)
                    own = np.searchsorted(ends, places, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), token), pa.int64()), shard.documents.column(0).combine_chunks().take(pa.array(own)), pa.array(places - starts[own], pa.int64())], schema=arrow)

    return blobs(spark, path).mapInArrow(find, schema)


def counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """How often each of the given ids occurs in all shards: token, n. Two blocks of each plane of a shard are unpacked for each."""
    bound_batches(spark, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                yield pa.RecordBatch.from_pydict({"token": sorted(set(tokens)), "n": [shard.count(t) for t in sorted(set(tokens))]})

    return blobs(spark, path).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def with_starts(rows: DataFrame) -> DataFrame:
    """The rows of ``read_documents`` with start: the tokens of all documents before each. ``rows`` is read twice: pass a written table.

    Shards are summed within their part first; the order over parts has a row for each of them, one for RANGE_BYTES of text.
    """
    shards = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("tokens"))
    before = lambda window: F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(shards.groupBy("part").agg(F.sum("tokens").alias("tokens")), "parts")
    bases = parts.select("part", before(Window.orderBy("part")).alias("ahead"))
    within = shards.withColumn("within", before(Window.partitionBy("part").orderBy("nth"))).join(joinable(bases), "part").select("part", "nth", (F.col("ahead") + F.col("within")).alias("base"))
    return rows.join(joinable(within), ["part", "nth"]).withColumn("start", F.col("base") + F.col("local")).drop("base")


def op13_wavelet(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, written in shards and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_shards(docs, fresh_path(spark, "shards"))
    rows = with_starts(written(read_documents(spark, path, docs.schema["doc_id"].dataType), "shard-documents"))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
