"""Total orders, numbering, caps, limits and sequential admission."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.numbers import even_share
from tarn.operators.lookup import BROADCAST_BYTES, estimated_bytes, numbered_by_ranges
from tarn.storage import stored


def nulls_last(*columns: str) -> list[Column]:
    """Ascending by bytes, nulls last: the order of every table and list here."""
    return [F.col(c).asc_nulls_last() for c in columns]


def numbered(rows: DataFrame, order: Sequence[Column | str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Numbers rows from 1 by ``order`` within ``by``; without ``by`` over the whole table, in parallel (see ``global_number``).

    A table that is too large for one task isn't gathered by key either: see ``numbered_by_ranges``.
    """
    if not by:
        return global_number(rows, order, out)
    if estimated_bytes(rows) > BROADCAST_BYTES:
        return numbered_by_ranges(rows, by, [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order], out)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def global_number(rows: DataFrame, order: Sequence[Column | str], out: str, running: dict[str, Column] | None = None) -> DataFrame:
    """Numbers all rows from 1 by a total order without moving them to one task.

    Rows are dealt to ranges of the order, ranges are counted, and each row's number is its place in its range and what
    comes before it. The ranges come from a sample, which differs from run to run, so the dealt rows are stored: counts
    and places are then of the same ranges. ``order`` must be total for the numbers to be reproducible. ``running`` adds
    columns that number, along the same order, the rows for which a condition holds; null for the others.
    """
    spark, running = rows.sparkSession, running or {}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    flags = {name: F.coalesce(holds, F.lit(False)).cast("long") for name, holds in running.items()}
    ranged = stored(rows.withColumns({f"_f_{n}": c for n, c in flags.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    totals = {"_n": F.count(F.lit(1)), **{f"_n_{n}": F.sum(f"_f_{n}") for n in flags}}
    counts = ranged.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()])  # as many rows as there are ranges
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_base{n}") for n in totals])
    here = Window.partitionBy("_part").orderBy(*order)
    numbers = {out: F.col("_base_n") + F.row_number().over(here)}
    for n in flags:
        numbers[n] = F.when(F.col(f"_f_{n}") == 1, F.col(f"_base_n_{n}") + F.sum(f"_f_{n}").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    done = ranged.join(F.broadcast(bases), "_part").withColumns(numbers)
    return done.drop("_part", *[f"_base{n}" for n in totals], *[f"_f_{n}" for n in flags])


def ordered_admission(rows: DataFrame, order: Sequence[Column | str], candidate: Column, cap: int, number: str = "selection_order", out: str = "fetch_order") -> DataFrame:
    """Numbers all rows (``number``) and, along the same order, the first ``cap`` candidates (``out``, null for all others)."""
    numbered_rows = global_number(rows, order, number, {out: candidate})
    return numbered_rows.withColumn(out, F.when(F.col(out) <= cap, F.col(out).cast("int")))


def partitioned_evenly(rows: DataFrame, order: Sequence[str], by: Sequence[str], total: Column, ceiling: Column, out: str = "share") -> DataFrame:
    """Each row's share of its group's total: equal whole shares, at most ``ceiling``, the remainder to the first rows."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(*nulls_last(*order)))
    return rows.withColumn(out, even_share(total, F.count(F.lit(1)).over(group), ceiling, place))


def admitted(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, max_count: int, max_total: int, out: str = "admitted") -> DataFrame:
    """Sequential admission within each group: an item is admitted if count and total still allow it; one too large is skipped and later ones may fit.

    What an item may do depends on all before it, so a group is folded in order, in one task. The fold streams: a task holds
    a batch of rows and the group's count and total, however many items a group has. An item without a size isn't admitted.
    """
    target = T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())])
    keys, at = [rows.columns.index(c) for c in by], rows.columns.index(size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count, total = None, 0, 0
        for batch in batches:
            flags = []
            for own, n in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(at).to_pylist(), strict=True):
                if own != group:
                    group, count, total = own, 0, 0
                fits = n is not None and count < max_count and n <= max_total - total
                if fits:
                    count, total = count + 1, total + n
                flags.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=target.names)

    return rows.repartition(*by).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*by, *order)]).mapInArrow(fold, target)


def page(rows: DataFrame, order: Sequence[str], limit: int | None, offset: int = 0) -> DataFrame:
    """A page of the total order; 1 to 1000 rows, no more than 10,000 from the beginning. Without a limit (null) all rows, in order."""
    if limit is None:
        if offset:
            raise ValueError("an offset is a page's")
        return export_order(rows, *order)
    if not (1 <= limit <= 1000 and 0 <= offset and limit + offset <= 10_000):
        raise ValueError("limit is from 1 to 1000, and limit and offset together at most 10000")
    return rows.orderBy(*nulls_last(*order)).offset(offset).limit(limit)


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` for each key; nulls are keys like any other. Sums in the tasks come first, so a hot key is cheap."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def export_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*nulls_last(*(columns or rows.columns)))


def intersection_rank(rows: DataFrame, by: str, current: Column, outlet: Column, length: Column, drainage: Column, uri: str, out: str = "match_index") -> DataFrame:
    """Rank of intersecting lines: current before others, outlet matches, longest, largest drainage, then URI by bytes."""
    order = [F.coalesce(current, F.lit(False)).desc(), F.coalesce(outlet, F.lit(False)).desc(), length.desc_nulls_last(), drainage.desc_nulls_last(), F.col(uri).asc()]
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
