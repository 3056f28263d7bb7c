"""Aggregations: collapsing rows to identities, conflicts, counts with zeros, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.lookup import joinable, small
from tarn.storage import stored

#: Fragments of a node up to which they are gathered as they are; of nodes with more only the values that are kept.
GATHERED = 10_000


def collapsed(rows: DataFrame, key: str | list[str], order: Sequence[str], facts: Sequence[str], count: str = "variable_count") -> DataFrame:
    """One row for each key, with the facts of its first row by ``order``, and the number of its rows."""
    keys = [key] if isinstance(key, str) else list(key)
    first = F.min_by(F.struct(*facts), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first, F.count(F.lit(1)).alias(count)).select(*keys, *[F.col(f"_first.{f}").alias(f) for f in facts], count)


def group_conflicts(rows: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """Keys with rows that differ in any fact; nulls are values like any other. Equal to counting distinct facts, without a distinct."""
    fact = F.struct(*facts)
    return rows.groupBy(key).agg(F.min(fact).alias("_low"), F.max(fact).alias("_high")).where(~F.col("_low").eqNullSafe(F.col("_high"))).select(key)


def counts_by_value(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row with a count for each value that may occur, zero for those that don't."""
    return rows.agg(*[F.count_if(F.col(column) == v).alias(f"{v}_count") for v in values])


def counts_with_zeros(parents: DataFrame, key: str, rows: DataFrame, rows_key: str, out: str = "row_count") -> DataFrame:
    """Every parent with the number of its rows, zero where it has none."""
    counted = rows.groupBy(F.col(rows_key).alias("_key")).agg(F.count(F.lit(1)).alias(out))
    return parents.join(joinable(counted), F.col(key) == F.col("_key"), "left").drop("_key").withColumn(out, F.coalesce(out, F.lit(0)))


def distinct_coverage(rows: DataFrame, key: str, **columns: str) -> DataFrame:
    """For each key the number of distinct values of several columns.

    A task keeps each value that it meets, once for each column. Rows are dealt out to all tasks first, equal ones to one:
    what comes out of a join may be in few tasks, by the small size of its shuffled bytes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*dict.fromkeys([key, *columns.values()])).repartition(tasks, key, *columns.values())
    return dealt.groupBy(key).agg(*[F.count_distinct(c).alias(out) for out, c in columns.items()])


def completeness(stages: DataFrame) -> DataFrame:
    """Counts of attempts for each stage, with its status: complete, partial, failed, or not_attempted."""
    counted = stages.groupBy("stage").agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if("attempted").alias("attempted_count"), F.count_if("succeeded").alias("succeeded_count"),
        F.count_if(F.col("attempted") & ~F.col("succeeded")).alias("failed_count"), F.count_if(~F.col("attempted")).alias("skipped_count"),
    )
    done, asked = F.col("succeeded_count"), F.col("attempted_count")
    status = F.when(asked == 0, F.lit("not_attempted")).when(done == 0, F.lit("failed")).when(done < F.col("input_count"), F.lit("partial")).otherwise(F.lit("complete"))
    return counted.withColumn("status", status)


def merged_fragments(nodes: DataFrame, node_id: str, order: str, values: Sequence[str]) -> DataFrame:
    """Fragments of one node in one row: array properties joined in the order of the fragments, each value once, at its first place.

    The arrays ``values`` have elements of one type. A node's fragments meet in one shuffle of the rows as they are. Nodes
    with more than ``GATHERED`` of them go another way: see ``_merged_by_value``. A node without values has empty arrays.
    """
    counted = nodes.groupBy(F.col(node_id).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(counted.where(F.col("_n") > GATHERED).select("_hot"), "hot")
    if hot.isEmpty():
        return _merged_whole(nodes, node_id, order, values)
    same = F.col(node_id).eqNullSafe(F.col("_hot"))
    rest, large = (nodes.join(small(hot), same, how) for how in ("left_anti", "left_semi"))
    return _merged_whole(rest, node_id, order, values).unionByName(_merged_by_value(large, node_id, order, values))


def _merged_whole(nodes: DataFrame, node_id: str, order: str, values: Sequence[str]) -> DataFrame:
    """Each node with all of its fragments in one row, dealt out before they are collected: few fragments of a node are in one task before that."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select(node_id, order, *values).repartition(tasks, node_id)
    gathered = dealt.groupBy(node_id).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_all"))
    joined = lambda c: F.flatten(F.transform("_all", lambda x: F.coalesce(x[c], F.array().cast(nodes.schema[c].dataType))))
    return gathered.select(node_id, *[F.array_distinct(joined(c)).alias(c) for c in values])


def _merged_by_value(nodes: DataFrame, node_id: str, order: str, values: Sequence[str]) -> DataFrame:
    """The same where nodes have very many fragments: values are made distinct in the tasks, each with its first place, so a node gathers what it keeps."""

    def parts_of(k: int, c: str) -> Column:
        none = F.array().cast(nodes.schema[c].dataType)
        return F.transform(F.coalesce(F.col(c), none), lambda v, i: F.struct(F.lit(k).alias("column"), i.alias("place"), v.alias("value")))

    def kept_of(k: int) -> Column:
        return F.transform(F.filter("_all", lambda x: x["column"] == k), lambda x: x["value"])

    parts = F.flatten(F.array(*[parts_of(k, c) for k, c in enumerate(values)]))
    flat = nodes.select(node_id, F.struct(order, *values).alias("_fragment"), F.explode_outer(parts).alias("_v"))
    first = flat.groupBy(node_id, F.col("_v.column").alias("column"), F.col("_v.value").alias("value")).agg(F.min(F.struct("_fragment", "_v.place")).alias("at"))
    kept = first.groupBy(node_id).agg(F.array_sort(F.collect_list(F.struct("at", "column", "value"))).alias("_all"))
    return kept.select(node_id, *[kept_of(k).alias(c) for k, c in enumerate(values)])


def complete_products(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """For each key whether its rows are all pairs of its distinct lefts and rights; nulls are values."""
    left_key, right_key = (F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (left, right))
    counted = rows.groupBy(key).agg(F.count_distinct(left_key).alias("lefts"), F.count_distinct(right_key).alias("rights"), F.count_distinct(left_key, right_key).alias("pairs"))
    return counted.withColumn("complete", F.col("pairs") == F.col("lefts") * F.col("rights"))


def first_values(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """For each key its first value by ``order`` (of ties the least) that isn't null, and whether others differ from it. Combined in the tasks first."""
    known = F.col(value).isNotNull()
    first = F.min_by(value, F.when(known, F.struct(*order, value)))
    return rows.groupBy(key).agg(F.when(F.count(value) > 0, first).alias("value"), F.coalesce(F.min(value) != F.max(value), F.lit(False)).alias("contradictory"))


def first_value_and_conflict(values: Column) -> Column:
    """The same of an array: struct<value, contradictory>."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.struct(F.try_element_at(known, F.lit(1)).alias("value"), (F.size(F.array_distinct(known)) > 1).alias("contradictory"))


def diagnostics(*items: Column) -> Column:
    """array<struct<severity, code, path, message, recoverable>> of the items that aren't null, each once."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def diagnostic(when: Column, severity: str, code: str, path: str, message: str, recoverable: bool = True) -> Column:
    fields = {"severity": severity, "code": code, "path": path, "message": message, "recoverable": recoverable}
    return F.when(when, F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))


def budget_totals(requests: DataFrame, by: str, size: str) -> DataFrame:
    """For each key: requests, total and largest size."""
    return requests.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.sum(size).alias("total"), F.max(size).alias("peak"))


def semi_counts(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """For each wanted key whether all rows with it are valid, and how many there are."""
    return small(wanted.select(F.col(wanted_key).alias(key)).distinct()).join(rows, key, "left").groupBy(key).agg(F.count("valid").alias("rows"), F.coalesce(F.bool_and("valid"), F.lit(True)).alias("all_valid"))
