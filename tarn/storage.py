"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master gets a temporary folder where neither is set; on a cluster, where no executor could read another's
    files there, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        named = context.getCheckpointDir().get()
    return named.rstrip("/")


#: Paths handed out within each scope that is open, by application; the innermost scope is last.
_scopes: dict[str, list[list[str]]] = {}


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, when it is left, all tables and files that were written to the shared folder within it.

    What an operator returns reads such tables: write or collect it before the scope is left. A long session that doesn't
    open scopes keeps the intermediate tables of all its calls until it ends. Scopes may be nested; threads share them.
    """
    open_ = _scopes.setdefault(spark.sparkContext.applicationId, [])
    own: list[str] = []
    open_.append(own)
    try:
        yield
    finally:
        open_[:] = [x for x in open_ if x is not own]
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. All of an application's are removed when it ends, those of a scope when that is left."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/tarn-{context.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    fresh = f"{folder}/{name}-{uuid.uuid4().hex}"
    if open_ := _scopes.get(context.applicationId):
        open_[-1].append(fresh)
    return fresh


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read from then on: lineage ends here, and rows and their partitions stay what they are, whatever is lost or run again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
