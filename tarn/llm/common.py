"""What the operators share: written tables, Arrow batch bounds, free names, tokenizer files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.storage import fresh_path
from tarn.storage import stored as written

__all__ = ["blobs", "bound_batches", "fresh_path", "free_name", "vocabulary", "write_blobs", "written"]

#: Rows and bytes of an Arrow batch at most (a batch has one row at least): with whole documents these bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores behind it as it takes to be none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: The session's own Arrow batch size and the one that was set here last, by application.
_batches: dict[str, tuple[int, int]] = {}


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Holds the session's Arrow batches to at most ``rows`` rows and BATCH_BYTES; larger batches of whole documents fill a worker.

    The sizes are read when a plan runs, so they stay set. They are never above what the session itself had asked for.
    """
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark.conf.get(most, None)
    if asked is None or not asked.isdigit() or int(asked) > BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    key, app = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.applicationId
    now = int(spark.conf.get(key, "10000"))
    own, last = _batches.get(app, (now, now))
    if now != last:
        own = now
    size = min(own, rows) if own > 0 else rows
    _batches[app] = own, size
    spark.conf.set(key, str(size))


def write_blobs(files: DataFrame, path: str) -> None:
    """Writes each row's ``content`` as a file of its own, wherever Spark can write. The last byte of each has to be 0.

    Spark's text writer puts bytes down as they are and ends each row with a line end, which here is that 0; it commits a
    task's files together, so a task that is run again leaves nothing behind.
    """
    files.select(F.expr("substring(content, 1, octet_length(content) - 1)").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path``, a row of ``content`` each."""
    return spark.read.format("binaryFile").load(path).select("content")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, on whichever machine this runs; TARN_TOKENIZERS names another folder."""
    if folder := os.environ.get("TARN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
