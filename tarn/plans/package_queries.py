"""Packages, runs and registries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import predicates
from tarn.operators.lookup import small
from tarn.plans import run
from tarn.plans.registry import Tables, query
from tarn.plans.source_queries import _coverages, _pages
from tarn.sinks import package
from tarn.sinks import text as sink
from tarn.sources import delimited
from tarn.storage import fresh_path

# ruff: noqa: D103

#: Addresses by the key's remainder, and which handler takes them.
_ADDRESSES = (
    "https://e.org/collections/x/position?a=1", "https://api.waterdata.usgs.gov/ogcapi/v0/collections/continuous/items", "http://api.waterdata.usgs.gov/ogcapi/v0/collections/latest-daily/items?f=json",
    "https://waterservices.usgs.gov/nwis/iv/?sites=1", "https://waterservices.usgs.gov/nwis/dv?sites=1", "https://www.waterqualitydata.us/data/Result/search?x", "https://e.org/collections/lakes/items", "https://e.org/a.csv?x=1", "https://e.org/a.html",
)


@query(
    "OP36_handlers",
    """SELECT page_id, h.* FROM pages JOIN (VALUES (0, 1, 'edr', 'fetch', 'active'), (1, 2, 'usgs_waterdata_continuous', 'fetch', 'active'), (2, 3, 'usgs_waterdata_daily', 'fetch', 'active'), (3, 4, 'nwis_legacy_iv', 'fetch', 'deprecated'), (4, 5, 'nwis_legacy_dv', 'fetch', 'deprecated'),
(5, 6, 'wqp', 'fetch', 'active'), (6, 7, 'ogc_api_features', 'fetch', 'active'), (7, 8, 'csv', 'fetch', 'active'), (8, 9, 'unknown', 'reference_only', 'active')) k(r, precedence, handler_id, outcome, lifecycle) ON page_id % 9 = r
CROSS JOIN LATERAL (SELECT k.precedence, k.handler_id, k.outcome, k.lifecycle) h""",
)
def op36(t):
    """What the registry says of the handler that takes each page's address."""
    address = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (F.col("page_id") % len(_ADDRESSES) + 1).cast("int"))
    facts = t.pages.select("page_id", address.alias("access_url"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("array<string>").alias("conforms_to"))
    return predicates.classified(facts).join(small(predicates.handler_table(t.spark)), "handler_id").select("page_id", "precedence", "handler_id", "outcome", "lifecycle")


def _written(t: Tables) -> str:
    path = fresh_path(t.spark, "package")
    package.write_package(t.spark, path, {"sites": t.nation, "datasets": t.supplier}, {"source": "tables"})
    return path


@query("OP24_parquet_round_trip", "SELECT * FROM supplier")
def op24(t):
    return package.load_package(t.spark, _written(t))["datasets"]


@query("OP25_package_files", "SELECT 'datasets' AS part, 'verified' AS status, s_suppkey AS key FROM supplier UNION ALL SELECT 'sites', 'verified', n_nationkey FROM nation")
def op25(t):
    """The keys that each file of a package holds, and the file's status."""
    path = _written(t)
    part = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    status = package.verify_package(t.spark, path).select("path", "status")
    held = lambda name, key: t.spark.read.parquet(f"{path}/{name}").select(F.concat(F.lit(f"{name}/"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)).alias("path"), F.col(key).alias("key"))
    rows = held("datasets", "s_suppkey").unionByName(held("sites", "n_nationkey"))
    return rows.join(small(status), "path").select(part(F.col("path")).alias("part"), "status", "key")


@query("OP26_replaced_package", "SELECT r_regionkey, r_name FROM region")
def op26(t):
    path = _written(t)
    package.write_package(t.spark, path, {"sites": t.region}, replace=True)
    return package.load_package(t.spark, path)["sites"]


@query("OP116_canonical_tables", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def op116(t):
    """Rows to canonical text and back: only what is its own canonical form is taken over."""
    texts = delimited.scan_lines(sink.csv_records(t.customer), len(t.customer.columns)).where("problem IS NULL").select("fields")
    return package.hydrated(delimited.with_names(texts, t.customer.columns), t.customer.schema)


def _payloads(t: Tables):
    """Coverages of users and daily pages of customers; every eleventh customer's transport failed, nations have no parser."""
    named = lambda df, handler: df.withColumn("request_id", F.concat(F.lit(f"{handler}-"), F.col("doc_id").cast("string"))).withColumn("handler_id", F.lit(handler)).drop("doc_id")
    pages = named(_pages(t, "daily"), "usgs_waterdata_daily")
    pages = pages.withColumn("body", F.when(F.split_part("request_id", F.lit("-"), F.lit(2)).cast("int") % 11 != 0, F.col("body")))
    key = F.col("p_partkey")
    of = lambda handler, body: t.part.select(F.concat(F.lit(f"{handler}-"), key.cast("string")).alias("request_id"), F.lit(handler).alias("handler_id"), body.alias("body"))
    pick = lambda *bodies: F.element_at(F.array(*map(F.lit, bodies)), (key % len(bodies) + 1).cast("int"))
    out = named(_coverages(t), "edr").unionByName(pages, allowMissingColumns=True)
    for more in (of("csv", pick(*_CSV)), of("wqp", pick(*_WQP)), of("ogc_api_features", pick(*_FEATURES)), of("nwis_legacy_dv", F.lit("x"))):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


#: Bodies by the key's remainder: fine, two columns of one name, a short row, a quote in the middle.
_CSV = ("a,b\r\n1,2\r\n", "a,a\n1,2\n", "a,b\n1\n", 'a,b\n1,x"\n')
#: Fine; without a required column; nothing came.
_WQP = ("/".join(("ActivityStartTime", "Time")) + "," + ",".join(n.replace("ActivityStartTime.", "ActivityStartTime/").replace("Measure.", "Measure/") for n in delimited.WATER_QUALITY if n != "ActivityStartTime.Time") + "\n1,2,3,4,5,6,7\n", "MonitoringLocationIdentifier\n1\n", None)
#: Fine, with a next page, no page, more than it says, and not what it says.
_PAGE = '{{"type": "{0}", "numberReturned": {1}, "features": [{{"type": "Feature", "id": "1", "properties": {{}}}}], "links": [{{"rel": "{2}", "href": "x"}}]}}'
_FEATURES = (_PAGE.format("FeatureCollection", 1, "self"), _PAGE.format("FeatureCollection", 1, "next"), _PAGE.format("Feature", 1, "self"), _PAGE.format("FeatureCollection", 2, "self"))


_STATUS_SQL = """s AS (SELECT DISTINCT 'edr-' || CAST(user_id AS VARCHAR) AS request_id, CASE WHEN user_id % 10 IN (1, 3, 5) THEN 'parse_failed' ELSE 'succeeded' END AS status FROM events
UNION ALL SELECT DISTINCT 'usgs_waterdata_daily-' || CAST(o_custkey AS VARCHAR), CASE WHEN o_custkey % 11 = 0 THEN 'transport_failed' WHEN o_custkey % 10 IN (2, 7) THEN 'parse_failed' ELSE 'succeeded' END FROM orders
UNION ALL SELECT 'csv-' || CAST(p_partkey AS VARCHAR), CASE p_partkey % 4 WHEN 0 THEN 'succeeded' ELSE 'parse_failed' END FROM part
UNION ALL SELECT 'wqp-' || CAST(p_partkey AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'parse_failed' ELSE 'transport_failed' END FROM part
UNION ALL SELECT 'ogc_api_features-' || CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 4 < 2 THEN 'succeeded' ELSE 'parse_failed' END FROM part
UNION ALL SELECT 'nwis_legacy_dv-' || CAST(p_partkey AS VARCHAR), 'capability_failed' FROM part)"""


@query("OP103_run_status", f"WITH {_STATUS_SQL} SELECT request_id, status FROM s")
def op103(t):
    return run.run_status(_payloads(t)).select("request_id", "status")


@query(
    "OP104_response_limits",
    """WITH b AS (SELECT p_partkey, p_size % 9 AS n, CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 2 END AS c FROM part), s AS (SELECT *, 2 * c * (n + 1) AS bytes FROM b),
q AS (SELECT *, CASE WHEN bytes > 60 THEN 'response_bytes' WHEN n > 6 THEN 'row_limit' WHEN c > 4 THEN 'column_limit' WHEN n * c > 12 THEN 'field_limit' END AS problem FROM s)
SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN problem = 'response_bytes' THEN 'transport_failed' WHEN problem IS NOT NULL THEN 'parse_failed' ELSE 'succeeded' END AS status, problem, CASE WHEN problem IS NULL THEN n END AS rows FROM q""",
)
def op104_limits(t):
    wide = F.col("p_partkey") % 4 == 0
    line = lambda a, b: F.when(wide, F.lit(a)).otherwise(F.lit(b))
    body = F.concat(line("a,b,c,d\n", "a,b\n"), F.repeat(line("1,2,3,4\n", "1,2\n"), F.col("p_size") % 9))
    payloads = t.part.select(F.col("p_partkey").cast("string").alias("request_id"), F.lit("csv").alias("handler_id"), body.alias("body"))
    for name, kind in {"parameter": "string", "lon": "double", "lat": "double", "site": "string", "parameter_code": "string", "statistic_id": "string", "time_start": "string", "time_end": "string", "page_limit": "int"}.items():
        payloads = payloads.withColumn(name, F.lit(None).cast(kind))
    return run.run_status(payloads, run.Limits(response_bytes=60, rows=6, columns=4, fields=12)).drop("handler_id")


@query(
    "OP104_admitted_requests",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
a(o_custkey, p, o_orderkey, size, ok, n, total) AS (SELECT o_custkey, p, o_orderkey, size, size <= 400000, CASE WHEN size <= 400000 THEN 1 ELSE 0 END, CASE WHEN size <= 400000 THEN size ELSE 0 END FROM o WHERE p = 1
UNION ALL SELECT o.o_custkey, o.p, o.o_orderkey, o.size, n < 3 AND o.size <= 400000 - total, n + CASE WHEN n < 3 AND o.size <= 400000 - total THEN 1 ELSE 0 END, total + CASE WHEN n < 3 AND o.size <= 400000 - total THEN o.size ELSE 0 END FROM a JOIN o ON a.o_custkey = o.o_custkey AND o.p = a.p + 1)
SELECT o_custkey AS run_id, o_orderkey AS fetch_order, ok AS admitted FROM a""",
)
def op104_admitted(t):
    requests = t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("fetch_order"), F.floor("o_totalprice").alias("response_byte_limit"))
    return run.admitted_requests(requests, limits=run.Limits(executions=3, total_bytes=400_000)).drop("response_byte_limit")


@query("OP104_overall_status", f"WITH {_STATUS_SQL} SELECT count(*) AS requests, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status <> 'succeeded') AS failed, 'partial' AS status FROM s")
def op104(t):
    return run.overall_status(run.run_status(_payloads(t)))
