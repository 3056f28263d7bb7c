"""Lookup releases: a file taken over under its known size and digest, with a receipt that later checks compare with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sinks.package import Place
from tarn.sources.files import digests

RECEIPT = "receipt.json"
ASSET = "asset"


def _facts(spark: SparkSession, path: str) -> DataFrame:
    """bytes and sha256 of one file, of any size."""
    return digests(spark, path).select("bytes", "sha256")


def install(spark: SparkSession, source: str, target: str, release: str, size: int, sha256: str) -> None:
    """Copies the file ``source`` to the folder ``target`` with a receipt, if it is of that size and digest; nothing is there otherwise."""
    place = Place(spark, target)
    if place.exists():
        raise FileExistsError(target)
    found = _facts(spark, source).first()
    if found is None or (found["bytes"], found["sha256"]) != (size, sha256):
        raise ValueError(f"the file isn't the release {release}")
    try:
        place.copy_from(source, ASSET)
        place.write_text(RECEIPT, json.dumps({"release": release, "bytes": size, "sha256": sha256}, sort_keys=True))
        if not checks(spark, target).where("NOT fine").isEmpty():
            raise OSError("what was installed isn't what was meant")
    except BaseException:
        place.remove()
        raise


def info(spark: SparkSession, target: str) -> DataFrame:
    """One row: release, bytes and sha256 of the receipt; none where nothing is installed."""
    schema = "release string, bytes long, sha256 string"
    if not Place(spark, target).exists():
        return spark.createDataFrame([], schema)
    receipt = json.loads(Place(spark, target).read_text(RECEIPT))
    return spark.createDataFrame([(receipt["release"], receipt["bytes"], receipt["sha256"])], schema)


def checks(spark: SparkSession, target: str) -> DataFrame:
    """rule (size, sha256) and whether the installed file is as its receipt says."""
    receipt = info(spark, target).select(F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    both = F.broadcast(receipt).join(_facts(spark, f"{target}/{ASSET}"), F.lit(True), "left")  # one row each
    rule = lambda name, test: F.struct(F.lit(name).alias("rule"), F.coalesce(test, F.lit(False)).alias("fine"))
    return both.select(F.explode(F.array(rule("size", F.col("bytes") == F.col("_bytes")), rule("sha256", F.col("sha256") == F.col("_sha256")))).alias("r")).select("r.*")


def lookup(spark: SparkSession, target: str) -> DataFrame:
    """The installed file as CSV, all columns text, once its checks hold."""
    from tarn.sources.delimited import read_strict

    if not checks(spark, target).where("NOT fine").isEmpty():
        raise ValueError("the installed file is not the release of its receipt")
    rows, problems = read_strict(spark, f"{target}/{ASSET}")
    if not problems.isEmpty():
        raise ValueError("the installed file has malformed records")
    return rows
