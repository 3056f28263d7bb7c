"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import written


def _to_least(links: DataFrame, larger: bool) -> DataFrame:
    """Links every node's neighbours (the larger, or the others) to the least of the node and its neighbours.

    The least neighbour of each node is found with minima in the tasks first, and written: the join that hands it to the
    neighbours then reads two plain tables, and Spark can split the partition of a node with very many links.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where("a > b")
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).select("a", "least"), "least")
    handed = both.join(least, "a")
    if larger:
        pairs = handed.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        pairs = handed.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return pairs.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that can be reached. No links give no rows.

    Repeated links and links of a node with itself change nothing. Both columns must be of one type that has an order.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(links)
    while before[0]:
        links = written(_to_least(_to_least(links, True), False), "links")
        now = print_of(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
