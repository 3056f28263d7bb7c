"""Exact deduplication by Grace hashing.

Copies met by one task collapse before the shuffle, so a text that a third of all rows repeat sends a few rows a task.
After the shuffle by content hash each task folds its rows into an open-addressing table that compares whole contents.
A table that outgrows its memory is dealt, with the rest of its rows, into spill files by the next bits of the hash,
and each file is treated in the same way. A table holds one copy of each content, so a bucket of copies always fits.
Spill files are unnamed scratch of the running task: they end with it, and a task that is lost starts over.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches

#: The characters that equality ignores, as bytes; all are ASCII, so UTF-8 sequences stay whole.
IGNORED = b" \t\n\x0b\x0c\r"
#: Bytes of contents and rows that a table holds before it is dealt into spill files.
TABLE_BYTES = 48 << 20
#: Spill files of one level; each level uses four further bits of the hash.
FAN_OUT = 16


def content_of(text: bytes | None) -> bytes:
    """What is compared: the text's bytes without ASCII white space; null is empty."""
    return (text or b"").translate(None, IGNORED)


class ContentTable:
    """Open addressing with linear probing. An entry: [key, content, rank, copies, row]; the best-ranked row stays.

    Two different contents under one key raise an error: membership is by key, so it has to stand for the content.
    """

    def __init__(self):
        self.slots: list = [None] * 1024
        self.used = 0
        self.bytes = 0

    def fold(self, key: bytes, content: bytes, rank: tuple, copies: int, row: object) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(key[-8:], "little") & mask
        while (entry := self.slots[at]) is not None:
            if entry[0] == key:
                if entry[1] != content:
                    raise ValueError(f"two contents have the hash {key.hex()}")
                entry[3] += copies
                if rank < entry[2]:
                    entry[2], entry[4] = rank, row
                return
            at = (at + 1) & mask
        self.slots[at] = [key, content, rank, copies, row]
        self.used += 1
        self.bytes += 2 * len(content) + 400
        if 2 * self.used > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        old, self.slots = self.slots, [None] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry in filter(None, old):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] is not None:
                at = (at + 1) & mask
            self.slots[at] = entry

    def __iter__(self) -> Iterator[list]:
        return filter(None, self.slots)


def fold_all(records: Iterator[tuple], limit: int, level: int = 0) -> Iterator[list]:
    """Entries of distinct contents of (key, content, rank, copies, row), however many there are."""
    table = ContentTable()
    for record in records:
        table.fold(*record)
        if table.bytes > limit and table.used > 1 and level < 64:
            break
    else:
        yield from table
        return
    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    dump = lambda record: pickle.dump(record, files[(record[0][level // 2] >> (4 * (level % 2))) & 15], 5)
    for entry in table:
        dump(tuple(entry))
    del table
    for record in records:
        dump(record)
    for file in files:
        with file:
            file.seek(0)
            yield from fold_all(_read(file), limit, level + 1)


def _read(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _rank(length: int, doc_id: int | None) -> tuple:
    """Most code points first, then the smallest id; a null id comes last."""
    return (-length, doc_id is None, doc_id or 0)


def _texts(column: pa.Array) -> tuple[list, list]:
    """Bytes and code points of each text; null is empty."""
    return column.cast(pa.binary()).to_pylist(), pc.fill_null(pc.utf8_length(column), 0).to_pylist()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct content: ``key`` (SHA-256 of the content), ``group_size``, ``row`` (the whole row that stays).

    Texts are equal when they are identical without ASCII white space; null is empty, and empty texts are one group.
    The row with the most code points stays, then the one with the smallest id (null last); of wholly equal rows any one.
    An empty table gives no rows. All columns of the input travel in the struct ``row``, so their names can't clash.
    A very long text is compared as a whole; a table that it fills alone goes on to spill files like any other.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("group_size", T.LongType()), *rows.schema.fields])
    arrow = to_arrow_schema(schema)

    def emit(entries: Iterator[list], size: int = 256) -> Iterator[pa.RecordBatch]:
        part: list = []
        for entry in entries:
            part.append(entry)
            if len(part) == size:
                yield _batch(part)
                part = []
        if part:
            yield _batch(part)

    def _batch(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], arrow[0].type), pa.array([e[3] for e in part], arrow[1].type), pa.array([e[4] for e in part], arrow[2].type)], schema=arrow)

    def records(batches: Iterator[pa.RecordBatch], keyed: bool) -> Iterator[tuple]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            texts, lengths = _texts(pc.struct_field(held, text_col))
            ids = pc.struct_field(held, id_col).to_pylist()
            keys = batch.column(0).to_pylist() if keyed else None
            copies = batch.column(1).to_pylist() if keyed else None
            for i, row in enumerate(held.to_pylist()):
                content = content_of(texts[i])
                key = keys[i] if keyed else hashlib.sha256(content).digest()
                yield key, content, _rank(lengths[i], ids[i]), copies[i] if keyed else 1, row

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for record in records(batches, False):
            table.fold(*record)
            if table.bytes > table_bytes:
                yield from emit(table)
                table = ContentTable()
        yield from emit(table)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(fold_all(records(batches, True), table_bytes))

    return rows.mapInArrow(collapse, schema).repartition("key").mapInArrow(fold, schema)


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (SHA-256 of the content) and n_points (code points of the text) of each row."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("n_points", T.LongType())])
    arrow = to_arrow_schema(schema)

    def key_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = _texts(batch.column(1))
            keys = [hashlib.sha256(content_of(t)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, arrow[1].type), pa.array(lengths, arrow[2].type)], schema=arrow)

    return slim.mapInArrow(key_all, schema)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one for each distinct content, as in ``exact_groups``."""
    names = docs.columns
    return exact_groups(docs, id_col, text_col).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays in its stead.

    Wholly equal rows (same id, same text) are counted first and told apart by number: the first of them can stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = exact_groups(docs).select(
        "key", "group_size", F.col("row.doc_id").alias("keep_id"), F.coalesce(F.char_length("row.text"), F.lit(0)).alias("keep_points")
    )
    members = membership(docs).groupBy("id", "key", "n_points").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return (
        members.join(groups, "key")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("key")).alias("text_sha256"),
        )
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
