"""Harmonized observations: reviewed target units and UTC, with a status on every row and no row dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.numbers import admitted_number, affine
from tarn.functions.temporal import local_to_utc, strict_utc
from tarn.functions.text import query_value
from tarn.operators.lookup import convert_by_dimension, joinable
from tarn.operators.ordering import global_number
from tarn.operators.predicates import RoleMapping, mapped_missing
from tarn.sources import vocabularies

STATUSES = ("variable_ambiguous", "unit_conflict", "invalid_value", "unit_unmapped", "harmonized_identity", "harmonized_missing", "conversion_unavailable", "harmonized_converted")


def parameter_of(parameters: DataFrame) -> DataFrame:
    """For each distribution its one variable, if it has exactly one with id and URI, and that variable's unit.

    distribution_id, variable_mapped, unit_known, variable_id, variable_uri, catalog_variable_name, source_unit_uri, source_unit_label.
    """
    one = F.count(F.lit(1)) == 1
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    p = parameters.groupBy("distribution_id").agg(one.alias("one"), *[F.min(c).alias(c) for c in ("variable_id", "variable_uri", "variable_name", "unit_uri", "unit_label")])
    mapped = F.col("one") & present("variable_id") & present("variable_uri")
    return p.select(
        "distribution_id",
        mapped.alias("variable_mapped"),
        (mapped & present("unit_uri") & present("unit_label")).alias("unit_known"),
        F.when(mapped, F.col("variable_id")).alias("variable_id"),
        F.when(mapped, F.col("variable_uri")).alias("variable_uri"),
        F.when(mapped & present("variable_name"), F.col("variable_name")).alias("catalog_variable_name"),
        F.when(F.col("one"), F.col("unit_uri")).alias("source_unit_uri"),
        F.when(F.col("one"), F.col("unit_label")).alias("source_unit_label"),
    )


def harmonized_values(rows: DataFrame, overrides: dict[str, str] | None = None, text: bool = True) -> DataFrame:
    """Converts native values. rows: value, unit_label, variable_mapped, unit_known, source_unit_uri, source_unit_label, and others, which stay.

    Adds harmonized_value, unit_uri, harmonized_label, original_unit_uri, harmonized, conversion_rule_id, status. The cascade:
    a variable that isn't one variable; a native label that isn't the catalog's; a value that is no number; a unit that
    no rule knows; the target unit itself; a unit with no direct rule to the target; conversion. Two broadcast joins with
    vocabularies and one CASE; no shuffle.
    """
    spark = rows.sparkSession
    known = vocabularies.units(spark).select("dimension", "unit_uri")
    joined = convert_by_dimension(rows, "source_unit_uri", known, vocabularies.target_units(spark, overrides), vocabularies.rules(spark).drop("dimension"))
    number = admitted_number(F.col("value"), text)
    corroborated = F.col("unit_known") & F.coalesce(F.col("unit_label") == F.col("source_unit_label"), F.lit(False))
    joined = joined.withColumn("_number", number).withColumn("_same", corroborated)
    missing = F.col("_number.missing")
    status = (
        F.when(~F.col("variable_mapped"), F.lit("variable_ambiguous"))
        .when(~F.col("_same"), F.lit("unit_conflict"))
        .when(~F.col("_number.valid"), F.lit("invalid_value"))
        .when(F.col("dimension").isNull(), F.lit("unit_unmapped"))
        .when(F.col("source_unit_uri") == F.col("target_uri"), F.when(missing, F.lit("harmonized_missing")).otherwise(F.lit("harmonized_identity")))
        .when(F.col("rule_id").isNull(), F.lit("conversion_unavailable"))
        .otherwise(F.when(missing, F.lit("harmonized_missing")).otherwise(F.lit("harmonized_converted")))
    )
    done = F.col("status").startswith("harmonized")
    converted = done & F.col("rule_id").isNotNull()
    original = F.when(F.col("_same") & F.col("variable_mapped"), F.col("source_unit_uri"))
    return joined.withColumn("status", status).select(
        *rows.columns,
        F.when(converted, affine(F.col("_number.value"), F.col("scale"), F.col("offset"))).otherwise(F.col("_number.value")).alias("harmonized_value"),
        F.when(done, F.col("target_uri")).otherwise(original).alias("unit_uri"),
        F.when(done, F.col("target_label")).otherwise(F.col("unit_label")).alias("harmonized_label"),
        original.alias("original_unit_uri"),
        done.alias("harmonized"),
        F.when(converted, F.col("rule_id")).alias("conversion_rule_id"),
        "status",
    )


def csv_native(rows: DataFrame, result: str = "result_id") -> DataFrame:
    """Mapped CSV rows (see RoleMapping) with instants. One malformed time leaves its whole resource native: no rows of it."""
    timed = rows.withColumn("_instant", strict_utc(F.col("datetime")))
    return _gated(timed, result, F.col("_instant").isNotNull()).withColumn("datetime", F.col("_instant")).drop("_instant")


def wqp_native(rows: DataFrame, result: str = "result_id") -> DataFrame:
    """Water quality results (all texts) with instants in UTC; adds datetime, value, unit_label, qualifier, variable_name.

    Columns are those of the service, with dots for slashes, and distribution_url and catalog_variable_name. Every row
    of a resource must be of the URL's site and characteristic, and have a known zone and a proper local time; otherwise
    the whole resource stays native.
    """
    spark = rows.sparkSession
    column = lambda name: F.col(f"`{name}`")
    zoned = rows.join(F.broadcast(vocabularies.zones(spark)), column("ActivityStartTime.TimeZoneCode") == F.col("code"), "left")
    instant = local_to_utc(column("ActivityStartDate"), column("ActivityStartTime.Time"), F.col("offset_minutes"))
    site, characteristic = query_value(F.col("distribution_url"), "siteid"), query_value(F.col("distribution_url"), "characteristicName")
    fine = (
        (column("MonitoringLocationIdentifier") == site) & (column("CharacteristicName") == characteristic) & (F.col("catalog_variable_name") == characteristic) & F.col("datetime").isNotNull()
    )
    gone = lambda c: F.when(~c.isin("", "NA"), c)
    qualifier = gone(F.col("MeasureQualifierCode")) if "MeasureQualifierCode" in rows.columns else F.lit(None).cast("string")
    timed = zoned.withColumn("datetime", instant)
    return _gated(timed, result, F.coalesce(fine, F.lit(False))).select(
        *[column(c) for c in rows.columns], "datetime", gone(F.col("ResultMeasureValue")).alias("value"), column("ResultMeasure.MeasureUnitCode").alias("unit_label"), qualifier.alias("qualifier"), F.col("CharacteristicName").alias("variable_name")
    )


def _gated(rows: DataFrame, result: str, fine: Column) -> DataFrame:
    """Rows of the resources all of whose rows are fine. Bad resources are found with sums in the tasks, so size doesn't matter."""
    bad = rows.where(~fine).select(F.col(result).alias("_bad")).distinct()
    return rows.join(joinable(bad), F.col(result) == F.col("_bad"), "left_anti")


#: For each handler family: id column of its native table, value, unit and time expressions.
FAMILIES = {
    "edr": ("coverage_id", "value", "unit", "datetime"),
    "usgs_waterdata_daily": ("daily_id", "value", "unit_of_measure", "to_timestamp(time)"),  # local days at midnight UTC
    "usgs_waterdata_continuous": ("continuous_id", "value", "unit_of_measure", "time"),
}


def native_fields(family: str, native: DataFrame, *keep: str) -> DataFrame:
    """datetime, value (text), unit_label, qualifier and variable_name of a family's native table."""
    _, value, unit, when = FAMILIES[family]
    qualifier = F.col("qualifier") if "qualifier" in native.columns else F.lit(None).cast("string")
    name = F.col("parameter_label") if "parameter_label" in native.columns else F.lit(None).cast("string")
    return native.select(*keep, F.expr(when).alias("datetime"), F.col(value).cast("string").alias("value"), F.col(value).cast("string").alias("original_value"), F.col(unit).alias("unit_label"), qualifier.alias("qualifier"), name.alias("variable_name"))


def feature_native(rows: DataFrame, mapping: RoleMapping, result: str = "result_id") -> DataFrame:
    """Native fields of features, whose ``properties`` are JSON text, under a mapping of roles to properties; other columns stay.

    Properties are judged by their JSON types: times and units are texts, values are texts, numbers or null, qualifiers
    texts or null. One feature that lacks a property, or has another type or no strict time, leaves its whole resource native.
    """
    wanted = [mapping.datetime, mapping.value, mapping.unit, *([mapping.qualifier] if mapping.qualifier else [])]
    if len(set(wanted)) != len(wanted) or {"feature_id", "geometry"} & set(wanted):
        raise ValueError("each role has a property of its own")
    parsed = rows.withColumn("_v", F.try_parse_json("properties"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("_v", f"$['{name}']", "variant"))
    text = lambda name: F.try_variant_get("_v", f"$['{name}']", "string")
    here = F.forall(F.array(*map(F.lit, wanted)), lambda name: F.array_contains(F.json_object_keys("properties"), name))
    number = kind(mapping.value).rlike("^(STRING|VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    fine = here & (kind(mapping.datetime) == "STRING") & (kind(mapping.unit) == "STRING") & number & strict_utc(text(mapping.datetime)).isNotNull()
    if mapping.qualifier:
        fine = fine & kind(mapping.qualifier).isin("STRING", "VOID")
    whole = _gated(parsed, result, F.coalesce(fine, F.lit(False)))
    roles = mapped_missing({"value": text(mapping.value), "qualifier": text(mapping.qualifier) if mapping.qualifier else F.lit(None).cast("string")}, mapping.missing)
    keep = [c for c in rows.columns if c != "properties"]
    return whole.select(*keep, strict_utc(text(mapping.datetime)).alias("datetime"), roles["value"].alias("value"), text(mapping.value).alias("original_value"), text(mapping.unit).alias("unit_label"), roles["qualifier"].alias("qualifier"), F.lit(None).cast("string").alias("variable_name"))


def observations(native: DataFrame, results: DataFrame, parameters: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """The observation table. native: result_id, native_row and native fields; results: result_id, result_index, distribution facts.

    Source order and repeated rows are kept; observation_index numbers all rows by result and native row.
    """
    joined = native.join(results, "result_id").join(joinable(parameter_of(parameters)), "distribution_id", "left")
    flags = joined.fillna(False, ["variable_mapped", "unit_known"])
    done = harmonized_values(flags, overrides)
    numbered = global_number(done, ["result_index", "native_row"], "observation_index")
    return numbered.select(
        F.lit("0.1.0").alias("contract_version"), "observation_index", "result_id", "native_row", "site_uri", "dataset_id", "distribution_id", "handler_id", "variable_id", "variable_uri",
        F.coalesce("catalog_variable_name", "variable_name").alias("variable_name"), "datetime", F.col("harmonized_value").alias("value"), "unit_uri", F.col("harmonized_label").alias("unit_label"), "original_value",
        "original_unit_uri", F.col("unit_label").alias("original_unit_label"), "qualifier", "harmonized", "conversion_rule_id", "status",
    )


def resources(results: DataFrame, observed: DataFrame) -> DataFrame:
    """Every result with its number of observations (zero too) and status: observations, or native_only."""
    counted = observed.groupBy("result_id").agg(F.count(F.lit(1)).alias("observation_count"))
    joined = results.join(joinable(counted), "result_id", "left").withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    return joined.withColumn("timeseries", F.col("observation_count") > 0).withColumn("status", F.when(F.col("timeseries"), F.lit("observations")).otherwise(F.lit("native_only")))


def harmonized_metadata(resource: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: resources, native_only, observations, harmonized and unchanged."""
    left = resource.agg(F.count(F.lit(1)).alias("resources"), F.count_if(F.col("status") == "native_only").alias("native_only"))
    right = observed.agg(F.count(F.lit(1)).alias("observations"), F.count_if("harmonized").alias("harmonized"), F.count_if(~F.col("harmonized")).alias("unchanged"))
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(right.select("*", one), "_one").drop("_one")
