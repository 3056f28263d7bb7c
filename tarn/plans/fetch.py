"""Fetch plans: from catalog rows to distributions in order, decisions, parameters, requests, budgets and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.temporal import intersection
from tarn.functions.text import url_is_safe
from tarn.operators.grouping import counts_by_value
from tarn.operators.ordering import numbered, ordered_admission, partitioned_evenly
from tarn.operators.predicates import HANDLERS, Handler, first_match
from tarn.storage import stored

VARIABLE = ["variable_id", "variable_uri", "variable_name", "unit_uri", "unit_label", "measurement_technique"]
FACTS = ["site_uri", "dataset_id", "provider_uri", "provider_name", "distribution_url", "media_type", "conforms_to", "handler_id", "fetchable", "temporal_start", "temporal_end"]
ORDER = ["provider_uri", "provider_name", "site_uri", "distribution_id"]
DECISIONS = ("selected_unplanned", "reference_only", "not_fetchable", "outside_time", "skipped_max_datasets")


def plannable(datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be planned, and one row with the number of those that can't."""
    fine = F.col("dataset_id").isNotNull() & F.col("distribution_id").isNotNull() & F.col("distribution_url").isNotNull()
    return datasets.where(fine), datasets.agg(F.count_if(~fine).alias("unplannable_rows"))


def decision(outcome: Column, fetchable: Column, outside: Column) -> Column:
    """The first reason not to fetch, in this order; else candidate."""
    return (
        F.when(outcome == "reference_only", F.lit("reference_only")).when(~F.coalesce(fetchable, F.lit(False)), F.lit("not_fetchable")).when(outside, F.lit("outside_time")).otherwise(F.lit("candidate"))
    )


@dataclass(frozen=True)
class FetchPlan:
    distributions: DataFrame
    parameters: DataFrame
    conflicts: DataFrame
    unsafe: DataFrame
    unplannable: DataFrame


def fetch_plan(datasets: DataFrame, start: Column | None = None, end: Column | None = None, max_datasets: int = 100, handlers: tuple[Handler, ...] = HANDLERS) -> FetchPlan:
    """Plans all distributions of a catalog. Distributions whose rows disagree, and unsafe URLs, are reported, not planned."""
    rows, unplannable = plannable(datasets)
    # Rows of one distribution collapse by their facts, in hash aggregates; it agrees if one row is left. The URL is judged
    # once for each distribution. Stored, as conflicts, plan and parameters all read it.
    versions = rows.groupBy("distribution_id", *FACTS).agg(F.count(F.lit(1)).alias("n"))
    grouped = versions.groupBy("distribution_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("n").alias("variable_count"), F.min(F.struct(*FACTS)).alias("low"))
    judged = grouped.select("distribution_id", "low.*", "variable_count", (F.col("versions") == 1).alias("_agree"), url_is_safe(F.col("low.distribution_url")).alias("_safe"))
    groups = stored(judged, "distributions")
    conflicts, unsafe = groups.where("NOT _agree").select("distribution_id"), groups.where("NOT _safe").select("distribution_id")
    rows = rows.join(groups.where("NOT (_agree AND _safe)").select("distribution_id"), "distribution_id", "left_anti")
    one = groups.where("_agree AND _safe").drop("_agree", "_safe")
    one = one.withColumn("access_url", F.col("distribution_url")).withColumn("handler_id", first_match(handlers)).drop("access_url")
    outcomes = F.create_map(*[F.lit(x) for h in handlers for x in (h.name, h.outcome)])
    none = F.lit(None).cast("timestamp")
    window = intersection(start if start is not None else none, end if end is not None else none, F.col("temporal_start"), F.col("temporal_end"))
    decided = one.withColumn("_window", window).withColumn("decision", decision(outcomes[F.col("handler_id")], F.col("fetchable"), F.col("_window.outside")))
    capped = ordered_admission(decided, ORDER, F.col("decision") == "candidate", max_datasets)
    chosen = F.col("fetch_order").isNotNull()
    final = F.when(F.col("decision") != "candidate", F.col("decision")).when(chosen, F.lit("selected_unplanned")).otherwise(F.lit("skipped_max_datasets"))
    distributions = capped.select(
        F.lit("0.1.0").alias("contract_version"), "selection_order", "fetch_order", *FACTS[:2], "distribution_id", *FACTS[2:],
        F.col("_window.start").alias("time_start"), F.col("_window.end").alias("time_end"), "variable_count", chosen.alias("selected"), final.alias("decision"),
    )
    parameters = numbered(rows.select("distribution_id", *VARIABLE), [F.col(c).asc_nulls_last() for c in VARIABLE], "parameter_order", by=["distribution_id"])
    return FetchPlan(distributions, parameters, conflicts, unsafe, unplannable)


def plan_counts(plan: FetchPlan) -> DataFrame:
    """One row: distributions by decision, zeros included."""
    return counts_by_value(plan.distributions, "decision", DECISIONS)


def request_plan(distributions: DataFrame, max_requests: int, max_bytes: int, per_request: int) -> DataFrame:
    """Requests for the selected distributions, first in fetch order, each with its even share of the bytes."""
    picked = distributions.where(F.col("selected") & (F.col("fetch_order") <= max_requests)).withColumn("_all", F.lit(1))
    return partitioned_evenly(picked, ["fetch_order"], ["_all"], F.lit(max_bytes), F.lit(per_request), "response_byte_limit").drop("_all")


def coverage(distributions: DataFrame, requests: DataFrame) -> DataFrame:
    """Every distribution with its request, if it has one, and why not otherwise."""
    planned = requests.select("distribution_id", "response_byte_limit")
    status = (
        F.when(F.col("response_byte_limit").isNotNull(), F.lit("request_planned"))
        .when(F.col("selected"), F.lit("budget_deferred"))
        .when(F.col("decision") == "reference_only", F.lit("reference_only"))
        .otherwise(F.lit("not_selected"))
    )
    return distributions.join(planned, "distribution_id", "left").withColumn("request_status", status)


def orchestration_status(covered: DataFrame, admissions: DataFrame, dry_run: bool = True, supported: tuple[str, ...] = ()) -> DataFrame:
    """What becomes of every distribution in a run. admissions: distribution_id, admitted."""
    reserved = F.col("handler_id").isin(*supported) if supported else F.lit(True)
    status = (
        F.when(F.col("admitted") & F.lit(dry_run), F.lit("dry_run_planned"))
        .when(F.col("admitted"), F.lit("execution_pending"))
        .when(~F.col("admitted"), F.lit("batch_limit_deferred"))
        .when((F.col("request_status") == "request_planned") & ~reserved, F.lit("handler_plan_unsupported"))
        .when(F.col("request_status") == "request_planned", F.lit("handler_unimplemented"))
        .when(F.col("request_status") == "budget_deferred", F.when(F.col("handler_id") == "csv", F.lit("csv_budget_deferred")).otherwise(F.lit("handler_budget_deferred")))
        .otherwise(F.col("request_status"))
    )
    return covered.join(admissions.select("distribution_id", "admitted"), "distribution_id", "left").withColumn("orchestration_status", status)
