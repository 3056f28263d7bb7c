"""Contiguous shards of nearly equal bytes, from global prefix sums over per-partition totals.

DataFrame functions only. The text never leaves the scan: what is ordered, shuffled and written is
(id, size, crc) for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import written
from tarn.llm.crc_sql import crc32_sql


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows, in the order of their ids, into ``shards`` contiguous runs of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1. A row belongs to the shard in whose equal share of the total
    the middle of its bytes falls, so a shard differs from its target by one row at most at either end.

    Returns id, size, text_crc32, shard, slot (gapless from 0 within a shard, in order).
    Null text: no bytes, size 1, CRC 0. Null ids come first. Repeated ids are ordered by CRC and size; wholly equal
    rows are interchangeable. An empty table gives no rows. Further columns of the input play no part. A very long text
    stays whole in its shard, which may then be larger than the others by that text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Ranges on four columns: no run of equal ids can fill one partition. Written, so that the ranges stay as they are.
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size"), F.col("tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shards")

    # One row for each partition: bounded by their number, so one task and a broadcast hold them at any size of input.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("local_bytes", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("local_row", F.row_number().over(within))
        .join(F.broadcast(bases), "part")
        .withColumn("before", F.col("bytes_before") + F.coalesce("local_bytes", F.lit(0)))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * total)) as int)"))
        .withColumn("place", F.col("rows_before") + F.col("local_row") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """Eight shards of all documents under the law ``bytes``."""
    dealt = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS crc FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, crc, size) AS place FROM d),
s AS (SELECT *, CAST(least(7, ((2 * ahead + size) * 8) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
