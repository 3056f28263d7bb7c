"""Digests of files of any size: whole in Spark for small ones, streamed for large ones, and by ranges in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are one value; larger ones are read piece by piece. Bytes of a range.
WHOLE, PIECE, RANGE = 512 << 20, 8 << 20, 64 << 20


def _opened(path: str):
    """A file of any store that Arrow reaches (local, HDFS, S3, GCS), for reading at any place."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, colon, name = path.partition(":")
    if scheme == "file" or not colon:
        return LocalFileSystem().open_input_file(f"/{name.lstrip('/')}" if colon else path)
    store, name = FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(name)


def _sha256(path: str, start: int, size: int) -> str:
    """The digest of a range of a file, in the memory of one piece."""
    digest = hashlib.sha256()
    with _opened(path) as file:
        file.seek(start)
        while size > 0:
            piece = file.read(min(PIECE, size))
            if not piece:
                raise OSError(f"{path} is shorter than it was")
            digest.update(piece)
            size -= len(piece)
    return digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_sha256(*row) for row in rows], pa.string())], names=["path", "start", "bytes", "sha256"])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """path, bytes and sha256 of a file, or of every file below a folder.

    A file of ``whole`` bytes at most is read by Spark, from wherever Spark can read; a larger one is streamed by one task,
    which holds a piece of it, through Arrow's file systems. Spark lists no empty files, so they have no row.
    """
    files = _listed(spark, path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("bytes"))
    return small.unionByName(large.mapInArrow(_hashed, "path string, start long, bytes long, sha256 string").select("path", "bytes", "sha256"))


def range_digests(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, start, bytes and sha256 of every range of ``size`` bytes of every file: a large file is hashed by many tasks. An empty file has none."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = _listed(spark, path).where(F.col("length") > 0).select("path", "length", at.alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("path", "start", F.least(F.lit(size), F.col("length") - F.col("start")).cast("long").alias("bytes")).repartition(parts, "path", "start")
    return dealt.mapInArrow(_hashed, "path string, start long, bytes long, sha256 string")


def tree_digests(ranges: DataFrame) -> DataFrame:
    """path, bytes, ranges and root: the digest of each file's range digests in order. Two files agree if their roots do, made with one size of range."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "sha256")))
    return ranges.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("ranges"), F.sha2(F.array_join(F.transform(ordered, lambda r: r["sha256"]), "").cast("binary"), 256).alias("root"))


def damaged(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and start of the ranges that two tables of range digests disagree on, or that only one of them has."""
    a, b = (df.select("path", "start", F.col("sha256").alias(name)) for df, name in ((before, "a"), (now, "b")))
    return a.join(b, ["path", "start"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", "start")
