"""Running a plan over payloads: every request fares on its own, and none is lost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.ordering import admitted
from tarn.sources import delimited, documents

MIB = 1 << 20
#: Handlers with a parser here, and how many columns their tables have where this doesn't depend on the payload.
PARSERS = {"csv": None, "wqp": None, "ogc_api_features": None, "edr": 9, "usgs_waterdata_daily": 11, "usgs_waterdata_continuous": 11}


@dataclass(frozen=True)
class Limits:
    """Ceilings of a fetch (fixed values): of one response, and of all of a run."""

    response_bytes: int = 8 * MIB
    rows: int = 100_000
    columns: int = 1000
    fields: int = 1_000_000
    executions: int = 32
    total_bytes: int = 64 * MIB
    page: int = 10_000


def parsed_sizes(payloads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, problem, rows and columns of every payload (see ``run_status``) whose handler has a parser."""
    keyed = payloads.withColumn("doc_id", F.col("request_id")).where("body IS NOT NULL")
    of = lambda handler: keyed.where(F.col("handler_id") == handler)
    sized = lambda df, handler: df.select("doc_id", "problem", F.col("rows").cast("long").alias("rows"), F.lit(PARSERS[handler]).cast("int").alias("columns"))
    parts = [sized(documents.coverage_sizes(of("edr")), "edr")]
    for handler, kind in (("usgs_waterdata_daily", "daily"), ("usgs_waterdata_continuous", "continuous")):
        parts.append(sized(documents.page_status(of(handler), kind), handler))
    parts.append(sized(documents.feature_page_status(of("ogc_api_features"), limits.page), "ogc_api_features"))
    for handler, required in (("csv", ()), ("wqp", delimited.WATER_QUALITY)):
        found = delimited.csv_documents(of(handler).select("doc_id", "body"), required, dots=handler == "wqp")
        parts.append(found.select("doc_id", "problem", F.col("rows").cast("long").alias("rows"), "columns"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_status(payloads: DataFrame, limits: Limits = Limits(), unavailable: Sequence[str] = ()) -> DataFrame:
    """The status of each request. payloads: request_id, handler_id, body (null if transport failed), and what its parser needs.

    Statuses: succeeded; transport_failed (nothing came, or more than a response may hold); parse_failed (the payload breaks
    its format, or has more rows, columns or fields than it may); capability_failed for a handler without a parser, or
    one of ``unavailable``, whose packages ``preflight`` misses. problem says what was wrong. Each request fares alone.
    """
    heavy = F.octet_length("body") > limits.response_bytes
    sizes = parsed_sizes(payloads.where(~F.coalesce(heavy, F.lit(False))), limits).withColumnRenamed("problem", "_problem")
    known = F.col("handler_id").isin(*(h for h in PARSERS if h not in unavailable))
    over = F.when(F.col("rows") > limits.rows, F.lit("row_limit")).when(F.col("columns") > limits.columns, F.lit("column_limit")).when(F.col("rows") * F.col("columns") > limits.fields, F.lit("field_limit"))
    broken = F.coalesce(F.col("_problem"), over)
    status = F.when(~known, F.lit("capability_failed")).when(F.col("body").isNull() | heavy, F.lit("transport_failed")).when(broken.isNotNull(), F.lit("parse_failed")).otherwise(F.lit("succeeded"))
    problem = F.when(known, F.when(heavy, F.lit("response_bytes")).otherwise(broken))
    joined = payloads.join(sizes, F.col("request_id") == F.col("doc_id"), "left")
    return joined.select("request_id", "handler_id", status.alias("status"), problem.alias("problem"), F.when(status == "succeeded", F.col("rows")).alias("rows"))


def admitted_requests(requests: DataFrame, run: str = "run_id", order: str = "fetch_order", size: str = "response_byte_limit", limits: Limits = Limits()) -> DataFrame:
    """Requests with ``admitted``: the first of a run, in order, that stay within its executions and bytes; the others are deferred."""
    return admitted(requests, [run], [order], size, limits.executions, limits.total_bytes)


def overall_status(statuses: DataFrame) -> DataFrame:
    """One row: requests, succeeded, failed, and the run's status (nothing_to_do, complete, partial or failed)."""
    counted = statuses.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") != "succeeded").alias("failed"))
    status = F.when(F.col("requests") == 0, F.lit("nothing_to_do")).when(F.col("failed") == 0, F.lit("complete")).when(F.col("succeeded") == 0, F.lit("failed")).otherwise(F.lit("partial"))
    return counted.withColumn("status", status)


def preflight(requirements: dict[str, dict[str, str]]) -> list[tuple[str, str, str | None]]:
    """(handler, package, problem) for the packages that handlers need: missing, or older than required; null if neither."""
    out = []
    for handler, packages in sorted(requirements.items()):
        for package, least in sorted(packages.items()):
            try:
                have = tuple(int(x) for x in metadata.version(package).split(".")[:3] if x.isdigit())
                problem = None if have >= tuple(map(int, least.split("."))) else "outdated"
            except metadata.PackageNotFoundError:
                problem = "missing"
            out.append((handler, package, problem))
    return out
