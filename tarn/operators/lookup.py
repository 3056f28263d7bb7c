"""Keyed lookups that keep every input row, in its place, and say how it fared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.storage import stored

#: Bytes of a lookup's side that may be broadcast, by Spark's own estimate: for a file that is its size as compressed.
BROADCAST_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if Spark estimates it within ``limit`` bytes; otherwise as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def joinable(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A grouped or ranked side of a join: broadcast if it is small, else stored.

    A grouped side keeps the partitions of its key, and a join that takes these over can't be split where the other side
    has a hot key. A stored side is dealt out for the join like the other, and Spark splits such partitions.
    """
    hinted = small(df, BROADCAST_BYTES if limit is None else limit)
    return hinted if hinted is not df else stored(df, "side")


def numbered_by_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """Numbers rows from 1 within ``by``, and counts them (``total``), without gathering a key's rows in one task.

    Rows are dealt to ranges of key and order, numbered within a key's part of a range, and moved up by what the key has
    in the ranges before: a key has as many parts as there are ranges at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*by)
    ahead = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"), F.sum("_n").over(of_key).alias("_total"))
    numbered = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    placed = numbered.join(joinable(bases), same)
    return placed.select(*rows.columns, (F.col("_base") + F.col("_own")).cast("int").alias(out), *([F.col("_total").alias(total)] if total else []))


def lookup_with_status(inputs: DataFrame, key: str, reference: DataFrame, reference_key: str, order: Sequence[str], index: str = "input_index", ambiguous: bool = True) -> DataFrame:
    """Every row of ``inputs`` with every match in ``reference``: status, match_index and the reference's columns.

    status is matched (one match, or any number where ``ambiguous`` is false), ambiguous (several) or not_found: then one
    row, whose match_index and reference columns are null. Matches are numbered by ``order``, by bytes, nulls last.
    ``index`` identifies an input row; repeated keys are looked up for each of their rows. The reference is ranked by key
    before the join, so inputs are never gathered by key.
    """
    known, by_bytes = reference.where(F.col(reference_key).isNotNull()), [F.col(c).asc_nulls_last() for c in order]
    if estimated_bytes(reference) <= BROADCAST_BYTES:
        by_key = Window.partitionBy(reference_key)
        ranked = known.withColumn("match_index", F.row_number().over(by_key.orderBy(*by_bytes))).withColumn("_matches", F.count(F.lit(1)).over(by_key))
    else:
        ranked = numbered_by_ranges(known, [reference_key], by_bytes, "match_index", "_matches")
    ranked = joinable(ranked)
    joined = inputs.join(ranked, inputs[key] == ranked[reference_key], "left")
    several = F.lit("ambiguous" if ambiguous else "matched")
    status = F.when(F.col("_matches").isNull(), F.lit("not_found")).when(F.col("_matches") == 1, F.lit("matched")).otherwise(several)
    return joined.withColumn("status", status).drop("_matches")


def lookup_metadata(result: DataFrame, index: str, key: str) -> DataFrame:
    """One row of counts: inputs, unique keys, and inputs by status; and matches."""
    of = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col(index))).alias(f"{s}_count")
    return result.agg(F.count_distinct(index).alias("input_count"), F.count_distinct(key).alias("unique_count"), F.count("match_index").alias("match_count"), of("matched"), of("ambiguous"), of("not_found"))


def fallback_lookup(inputs: DataFrame, key: str, advertised: str, reference: DataFrame, reference_key: str, value: str) -> DataFrame:
    """The advertised value where there is one, else the value that the key maps to: adds value, match_source and status."""
    counted = reference.groupBy(reference_key).agg(F.min(value).alias("_mapped"), F.count(F.lit(1)).alias("_n"))
    counted = joinable(counted)
    joined = inputs.join(counted, inputs[key] == counted[reference_key], "left").drop(counted[reference_key])
    given = F.col(advertised).isNotNull()
    return joined.select(
        *inputs.columns,
        F.when(given, F.col(advertised)).otherwise(F.when(F.col("_n") == 1, F.col("_mapped"))).alias("mapped"),
        F.when(given, F.lit("advertised")).when(F.col("_n").isNotNull(), F.lit("mapping")).alias("match_source"),
        F.when(given | (F.col("_n") == 1), F.lit("matched")).when(F.col("_n") > 1, F.lit("ambiguous")).otherwise(F.lit("not_found")).alias("status"),
    )


def with_currentness(rows: DataFrame, uri: str, current: DataFrame, current_uri: str, columns: dict[str, str]) -> DataFrame:
    """Overwrites ``columns`` (of rows: of current) where the row's URI has a current entry; rows without a URI stay as they are.

    Of several current entries of a URI the first counts, by the values of ``columns`` in their order, nulls last.
    """
    values = F.struct(*[F.col(c).alias(f"_{k}") for k, c in columns.items()])
    first = F.min_by(values, F.struct(*[x for c in columns.values() for x in (F.col(c).isNull(), F.col(c))]))
    fresh = current.groupBy(F.col(current_uri).alias("_uri")).agg(first.alias("_first")).select("_uri", "_first.*")
    joined = rows.join(joinable(fresh), F.col(uri) == F.col("_uri"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def replacements(rows: DataFrame, text: str, out: str = "replacement_uri") -> DataFrame:
    """One row for each URI listed in a text such as ``['a', 'b']``, with its place; rows without any keep one, with nulls."""
    listed = F.regexp_extract_all(F.col(text), F.lit(r"'([^']*)'"), F.lit(1))
    return rows.select("*", F.posexplode_outer(listed).alias("replacement_place", out))


def currentness_status(superseded: Column, replacement: Column) -> Column:
    return F.when(~F.coalesce(superseded, F.lit(False)), F.lit("current")).when(replacement.isNotNull(), F.lit("superseded")).otherwise(F.lit("superseded_unresolved"))


def uncovered(rows: DataFrame, key: str, covering: DataFrame, covering_key: str) -> DataFrame:
    """Rows whose key nothing covers."""
    return rows.join(joinable(covering.select(F.col(covering_key).alias("_key")).distinct()), F.col(key) == F.col("_key"), "left_anti")


def restricted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows whose keys are among those wanted; each row once, however often it is wanted."""
    return rows.join(joinable(wanted.select(*keys).distinct()), keys, "left_semi")


def single_item(matches: DataFrame, order: Sequence[str], fallback: DataFrame | None = None) -> DataFrame:
    """One item out of what matches, with status: matched, or ambiguous (the first two rows by ``order``), or not_found (one row of nulls).

    Where nothing matches, the one row of ``fallback`` (the same columns) is taken instead, as matched_by_fallback.
    """
    two = matches.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(2).withColumn("_one", F.lit(1))
    found = two.withColumn("status", F.when(F.count(F.lit(1)).over(Window.partitionBy("_one")) == 1, F.lit("matched")).otherwise(F.lit("ambiguous")))  # two rows at most
    if fallback is not None:
        other = fallback.select(*matches.columns, F.lit(1).alias("_one"), F.lit("matched_by_fallback").alias("status")).limit(1)
        found = found.unionByName(other.join(F.broadcast(two.select("_one").distinct()), "_one", "left_anti"))
    one = matches.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(F.broadcast(found), "_one", "left").select(*matches.columns, F.coalesce("status", F.lit("not_found")).alias("status"))


def positional(status: DataFrame, *others: DataFrame, key: str = "distribution_id") -> DataFrame:
    """A chain of left joins on one key that is unique in every other table; columns after the key are taken over."""
    for other in others:
        status = status.join(small(other), key, "left")
    return status


def convert_by_dimension(rows: DataFrame, unit: str, units: DataFrame, targets: DataFrame, rules: DataFrame) -> DataFrame:
    """unit -> dimension -> target unit -> the one rule that leads there directly; nothing is chained.

    units (unit_uri, dimension), targets (dimension, target_uri, target_label), rules (from_unit_uri, to_unit_uri, rule_id,
    scale, offset); all three are small vocabularies.
    """
    with_dimension = rows.join(small(units.withColumnRenamed("unit_uri", unit)), unit, "left")
    with_target = with_dimension.join(small(targets), "dimension", "left")
    return with_target.join(small(rules), (F.col(unit) == F.col("from_unit_uri")) & (F.col("target_uri") == F.col("to_unit_uri")), "left").drop("from_unit_uri", "to_unit_uri")


def product_of_parts(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Each element of array ``left`` with each of array ``right``; an empty side counts as one null."""
    return rows.withColumn(left, F.explode_outer(left)).withColumn(right, F.explode_outer(right))


def dereferenced(nodes: DataFrame, node_id: str, reference: str) -> DataFrame:
    """Nodes with the node they refer to, as the struct ``target``; null if there is none. Ids are unique."""
    index = nodes.select(F.col(node_id).alias("_id"), F.struct(*nodes.columns).alias("target"))
    return nodes.join(index, F.col(reference) == F.col("_id"), "left").drop("_id")


def resolved_redirects(edges: DataFrame, starts: DataFrame, limit: int = 10) -> DataFrame:
    """Follows redirects (url -> location) from each start: start, final, hops, problem (null, redirect_loop or too_many_redirects).

    One equi-join for each hop, ``limit`` at most. Of several locations of a URL the least counts. Many starts may meet at
    one URL.
    """
    steps = joinable(edges.groupBy(F.col("url").alias("_from")).agg(F.min("location").alias("_to")))
    now = starts.select(F.col("url").alias("start"), F.col("url").alias("final"), F.lit(0).alias("hops"), F.array("url").alias("seen"))
    for _ in range(limit):
        open_ = ~F.array_contains(F.slice("seen", 1, F.greatest(F.size("seen") - 1, F.lit(0))), F.col("final"))
        moved = now.join(steps, (F.col("final") == F.col("_from")) & open_, "left")
        go = F.col("_to").isNotNull()
        now = moved.select("start", F.coalesce("_to", "final").alias("final"), (F.col("hops") + go.cast("int")).alias("hops"), F.when(go, F.concat("seen", F.array("_to"))).otherwise(F.col("seen")).alias("seen"))
    last = now.join(steps, F.col("final") == F.col("_from"), "left")
    loop = F.size("seen") > F.size(F.array_distinct("seen"))
    return last.select("start", "final", "hops", F.when(loop, F.lit("redirect_loop")).when(F.col("_to").isNotNull(), F.lit("too_many_redirects")).alias("problem"))


def release_violations(reference: DataFrame, key: str, value: str, rows: int, known: dict[str, str], absent: Sequence[str] = ()) -> DataFrame:
    """Checks of a lookup release: rule and violations, for its number of rows, answers that are known, and keys it must not have."""
    spark = reference.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in known.items()] + [(k, None) for k in absent], "_key string, _value string")
    found = F.broadcast(wanted).join(reference.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col("_key") == F.col("_k"), "left")
    judged = found.groupBy("_key", "_value").agg(F.count("_v").alias("n"), F.count_if(F.col("_v") == F.col("_value")).alias("right"))
    answers = judged.agg(F.count_if(F.col("_value").isNotNull() & (F.col("right") == 0)).alias("known_answer"), F.count_if(F.col("_value").isNull() & (F.col("n") > 0)).alias("absent_key"))
    size = reference.agg(F.abs(F.count(F.lit(1)) - rows).alias("row_count"))
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col(name).alias("violations"))
    return rule(size, "row_count").unionByName(rule(answers, "known_answer")).unionByName(rule(answers, "absent_key"))
