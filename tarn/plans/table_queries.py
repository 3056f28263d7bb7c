"""Filters, aggregations, orders and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import numbers, temporal, text
from tarn.functions.identity import contract_hash
from tarn.operators import grouping, ordering, predicates, sets
from tarn.plans.registry import query

# ruff: noqa: D103

@query("OP28_redacted_urls", r"SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE WHEN regexp_extract(url, '^[^#]*') LIKE '%?%' THEN '?[redacted]' ELSE '' END || CASE WHEN url LIKE '%#%' THEN '#[redacted]' ELSE '' END AS url FROM pages")
def op28(t):
    return t.pages.select("page_id", text.redacted_url(F.col("url")).alias("url"))


@query("OP32_sitemap_urls", "SELECT DISTINCT regexp_replace(url, '#.*$', '') AS loc FROM pages WHERE url LIKE 'http%'")
def op32(t):
    return t.pages.select(text.canonical_url(F.col("url")).alias("loc")).where("loc IS NOT NULL").distinct().orderBy("loc")


@query(
    "OP33_predicates",
    """SELECT page_id, url LIKE 'https:%' AS secure, regexp_matches(url, '/(en|fr)/') AS english_or_french, len(list_intersect(string_split(url, '/'), ['de', 'es'])) > 0 AS german_or_spanish FROM pages""",
)
def op33(t):
    pages = t.pages.withColumn("parts", F.split("url", "/"))
    tests = {"secure": predicates.Test("url", "scheme_in", ("https",)), "english_or_french": predicates.Test("url", "regex", ("/(en|fr)/",)), "german_or_spanish": predicates.Test("parts", "contains_any", ("de", "es"))}
    return pages.select("page_id", *[test.column().alias(name) for name, test in tests.items()])


_FACTS = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://api.waterdata.usgs.gov/ogcapi/v0/collections/daily/items?f=json' WHEN 1 THEN 'https://www.waterqualitydata.us/data/Result/search?x=1'
WHEN 2 THEN 'https://waterservices.usgs.gov/nwis/iv/?sites=1' WHEN 3 THEN url || '.csv' WHEN 4 THEN 'https://example.org/collections/a/position?x' ELSE url END AS access_url, CASE WHEN page_id % 5 = 0 THEN 'text/csv' END AS media_type FROM pages)"""


@query(
    "OP35_classified",
    f"""SELECT page_id, CASE WHEN access_url LIKE '%/collections/a/position?%' THEN 'edr' WHEN access_url LIKE '%/collections/daily/items?%' THEN 'usgs_waterdata_daily' WHEN access_url LIKE '%/nwis/iv/%' THEN 'nwis_legacy_iv'
WHEN access_url LIKE '%waterqualitydata.us/data/%' THEN 'wqp' WHEN media_type = 'text/csv' OR regexp_matches(access_url, '\\.csv([?#].*)?$') THEN 'csv' ELSE 'unknown' END AS handler_id FROM {_FACTS}""",
)
def op35(t):
    url = (
        F.when(F.col("page_id") % 7 == 0, F.lit("https://api.waterdata.usgs.gov/ogcapi/v0/collections/daily/items?f=json"))
        .when(F.col("page_id") % 7 == 1, F.lit("https://www.waterqualitydata.us/data/Result/search?x=1"))
        .when(F.col("page_id") % 7 == 2, F.lit("https://waterservices.usgs.gov/nwis/iv/?sites=1"))
        .when(F.col("page_id") % 7 == 3, F.concat("url", F.lit(".csv")))
        .when(F.col("page_id") % 7 == 4, F.lit("https://example.org/collections/a/position?x"))
        .otherwise(F.col("url"))
    )
    facts = t.pages.select("page_id", url.alias("access_url"), F.when(F.col("page_id") % 5 == 0, F.lit("text/csv")).alias("media_type"), F.lit(None).cast("array<string>").alias("conforms_to"))
    return predicates.classified(facts).select("page_id", "handler_id")


_LONLAT = "CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, CAST(c_nationkey * 7 % 180 - 90 AS DOUBLE) AS lat"


@query(
    "OP38_bbox",
    f"SELECT c_custkey, lon BETWEEN -20 AND 40 AND lat BETWEEN -30 AND 30 AS inside, (lon >= 170 OR lon <= -170) AND lat BETWEEN -30 AND 30 AS across FROM (SELECT c_custkey, {_LONLAT} FROM customer)",
)
def op38(t):
    lon, lat = (F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_nationkey") * 7 % 180 - 90).cast("double")
    return t.customer.select("c_custkey", predicates.in_bbox(lon, lat, (-20, -30, 40, 30)).alias("inside"), predicates.in_bbox(lon, lat, (170, -30, -170, 30)).alias("across"))


@query("OP39_valid_identifiers", r"SELECT o_orderkey, regexp_full_match(CAST(o_orderkey AS VARCHAR), '(\d{2}|\d{4}|\d{6}|\d{8}|\d{10}|\d{12})') AS huc, regexp_full_match(CAST(o_orderkey AS VARCHAR), '[1-9][0-9]*') AS comid FROM orders")
def op39(t):
    key = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", predicates.valid_identifier(key, predicates.HUC).alias("huc"), predicates.valid_identifier(key, predicates.COMID).alias("comid"))


#: Places in the list that may be requested: the even ones.
_URLS = (
    "http://example.org/a", "http://10.1.2.3/a", "https://8.8.8.8/?q", "https://user@example.org/", "http://172.32.0.1/", "http://172.16.5.4/", "http://169.253.1.1/", "http://169.254.169.254/latest", "http://100.128.0.1/", "http://100.64.0.1/",
    "http://192.169.0.1/", "http://192.168.0.1:8080/", "HTTPS://Example.ORG:443", "http://[::1]/", "https://example.org./", "http://[fe80::1]:80/", "http://223.1.1.1/", "http://224.0.0.1/", "http://localhost.example.org/", "http://api.localhost/",
    "http://192.0.3.1/", "http://192.0.2.1/", "http://a.b/#localhost", "ftp://example.org/", "http://11.0.0.1/", "http://0.0.0.0/", "http://126.0.0.1/", "http://127.1.2.3/",
)


@query("OP42_safe_urls", f"SELECT event_id, event_id % {len(_URLS)} % 2 = 0 AS safe FROM events")
def op42(t):
    url = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("event_id") % len(_URLS) + 1).cast("int"))
    return t.events.select("event_id", text.url_is_safe(url).alias("safe"))


@query("OP43_safe_texts", r"SELECT doc_id, NOT regexp_matches(text, '[\x00-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{feff}]') AND strlen(text) <= 4000 AS safe FROM documents")
def op43(t):
    return t.documents.select("doc_id", text.text_is_safe(F.col("text"), 4000).alias("safe"))


@query("OP44_missing_tokens", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'error') THEN event_type END AS value FROM events")
def op44(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in predicates.mapped_missing({"value": F.col("event_type")}, ("view", "error")).items()])


@query("OP45_role_mapping", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS datetime, event_type AS original_value, CASE WHEN event_type <> 'error' THEN event_type END AS value, props AS unit_label, CASE WHEN props <> 'error' THEN props END AS qualifier FROM events")
def op45(t):
    native = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.col("props").alias("unit"), F.col("props").alias("flag"))
    return predicates.RoleMapping("day", "event_type", "unit", "flag", ("error",)).select(native, "event_id")


@query(
    "OP61_collapsed",
    "SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS l_suppkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS l_returnflag, count(*) AS variable_count FROM lineitem GROUP BY 1",
)
def op61(t):
    return grouping.collapsed(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], ["l_suppkey", "l_returnflag"])


@query("OP62_group_conflicts", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def op62(t):
    return grouping.group_conflicts(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("OP63_counts_by_value", "SELECT count(*) FILTER (o_orderstatus = 'O') AS \"O_count\", count(*) FILTER (o_orderstatus = 'F') AS \"F_count\", count(*) FILTER (o_orderstatus = 'X') AS \"X_count\" FROM orders")
def op63(t):
    return grouping.counts_by_value(t.orders, "o_orderstatus", ["O", "F", "X"])


@query("OP64_counts_with_zeros", "SELECT c_custkey, coalesce(n, 0) AS row_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey")
def op64(t):
    return grouping.counts_with_zeros(t.customer.select("c_custkey"), "c_custkey", t.orders.where("o_totalprice > 300000"), "o_custkey")


@query(
    "OP67_completeness",
    """SELECT event_type AS stage, count(*) AS input_count, count(*) FILTER (user_id % 5 <> 0) AS attempted_count, count(*) FILTER (user_id % 5 <> 0 AND value > 10) AS succeeded_count, count(*) FILTER (user_id % 5 <> 0 AND NOT value > 10) AS failed_count,
count(*) FILTER (user_id % 5 = 0) AS skipped_count, CASE WHEN count(*) FILTER (user_id % 5 <> 0) = 0 THEN 'not_attempted' WHEN count(*) FILTER (user_id % 5 <> 0 AND value > 10) = 0 THEN 'failed'
WHEN count(*) FILTER (user_id % 5 <> 0 AND value > 10) < count(*) THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY 1""",
)
def op67(t):
    tried = F.col("user_id") % 5 != 0
    return grouping.completeness(t.events.select(F.col("event_type").alias("stage"), tried.alias("attempted"), (tried & (F.col("value") > 10)).alias("succeeded")))


@query(
    "OP68_distinct_coverage",
    "SELECT s_nationkey, count(DISTINCT s_suppkey) AS site_count, count(DISTINCT l_partkey) AS dataset_count, count(DISTINCT l_orderkey) AS distribution_count FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1",
)
def op68(t):
    rows = t.supplier.join(t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return grouping.distinct_coverage(rows, "s_nationkey", site_count="s_suppkey", dataset_count="l_partkey", distribution_count="l_orderkey")


@query(
    "OP69_merged_fragments",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem),
f AS (SELECT l_orderkey, l_returnflag AS v, n * 2 AS p FROM r UNION ALL SELECT l_orderkey, l_linestatus, n * 2 + 1 FROM r), g AS (SELECT l_orderkey, v, min(p) AS p FROM f GROUP BY 1, 2), a AS (SELECT l_orderkey, string_agg(v, ',' ORDER BY p) AS flags FROM g GROUP BY 1),
s AS (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS v, min(n) AS p FROM r GROUP BY 1, 2), b AS (SELECT l_orderkey, string_agg(v, ',' ORDER BY p) AS suppliers FROM s GROUP BY 1) SELECT l_orderkey, flags, suppliers FROM a JOIN b USING (l_orderkey)""",
)
def op69(t):
    nodes = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("flags"), F.array(F.col("l_suppkey").cast("string")).alias("suppliers"))
    merged = grouping.merged_fragments(nodes, "l_orderkey", "l_linenumber", ["flags", "suppliers"])
    return merged.select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join("suppliers", ",").alias("suppliers"))


@query(
    "OP71_time_intersection",
    """WITH w AS (SELECT user_id, min(ts) AS s, CASE WHEN user_id % 3 <> 0 THEN max(ts) END AS e FROM events GROUP BY 1), q AS (SELECT *, TIMESTAMP '2024-01-10' AS rs, TIMESTAMP '2024-01-20' AS re FROM w),
x AS (SELECT user_id, greatest(rs, s) AS a, least(re, e) AS b FROM q) SELECT user_id, CASE WHEN NOT coalesce(a > b, false) THEN a END AS time_start, CASE WHEN NOT coalesce(a > b, false) THEN b END AS time_end, coalesce(a > b, false) AS outside FROM x""",
)
def op71(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e")).withColumn("e", F.when(F.col("user_id") % 3 != 0, F.col("e")))
    at = lambda d: F.lit(d).cast(spans.schema["s"].dataType)
    cut = spans.select("user_id", temporal.intersection(at("2024-01-10"), at("2024-01-20"), F.col("s"), F.col("e")).alias("w"))
    return cut.select("user_id", F.col("w.start").alias("time_start"), F.col("w.end").alias("time_end"), F.col("w.outside").alias("outside"))


@query("OP72_budget_totals", "SELECT o_custkey, count(*) AS requests, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total, max(CAST(floor(o_totalprice) AS BIGINT)) AS peak FROM orders GROUP BY 1")
def op72(t):
    return grouping.budget_totals(t.orders.select("o_custkey", F.floor("o_totalprice").alias("bytes")), "o_custkey", "bytes")


@query(
    "OP73_first_value_and_conflict",
    "SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag)[1] AS value, count(DISTINCT l_returnflag) > 1 AS contradictory FROM lineitem GROUP BY 1",
)
def op73(t):
    return grouping.first_values(t.lineitem, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey"])


@query(
    "OP74_intersection_rank",
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus = 'O') DESC, (l_returnflag = 'N') DESC, l_quantity DESC, l_extendedprice DESC, CAST(l_linenumber AS VARCHAR)) AS INTEGER) AS match_index FROM lineitem""",
)
def op74(t):
    rows = t.lineitem.withColumn("uri", F.col("l_linenumber").cast("string"))
    ranked = ordering.intersection_rank(rows, "l_orderkey", F.col("l_linestatus") == "O", F.col("l_returnflag") == "N", F.col("l_quantity"), F.col("l_extendedprice"), "uri")
    return ranked.select("l_orderkey", "l_linenumber", "match_index")


@query("OP75_match_index", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name) AS INTEGER) AS match_index FROM customer")
def op75(t):
    return ordering.numbered(t.customer, ordering.nulls_last("c_mktsegment", "c_name"), "match_index", by=["c_nationkey"]).select("c_custkey", "match_index")


_SEGMENT = "CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END"


@query("OP76_selection_order", f"SELECT c_custkey, row_number() OVER (ORDER BY {_SEGMENT} NULLS LAST, c_name, c_custkey) AS selection_order FROM customer")
def op76(t):
    rows = t.customer.withColumn("segment", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")))
    return ordering.global_number(rows, ["segment", "c_name", "c_custkey"], "selection_order").select("c_custkey", "selection_order")


@query(
    "OP77_running_admission",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders), c AS (SELECT *, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS f FROM o)
SELECT o_orderkey, n AS selection_order, CAST(CASE WHEN o_orderstatus = 'O' AND f <= 500 THEN f END AS INTEGER) AS fetch_order, CASE WHEN o_orderstatus <> 'O' THEN 'not_fetchable' WHEN f <= 500 THEN 'selected_unplanned' ELSE 'skipped_max_datasets' END AS decision FROM c""",
)
def op77(t):
    open_ = F.col("o_orderstatus") == "O"
    capped = ordering.ordered_admission(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderdate", "o_orderkey"], open_, 500)
    return capped.select("o_orderkey", "selection_order", "fetch_order", F.when(~open_, F.lit("not_fetchable")).when(F.col("fetch_order").isNotNull(), F.lit("selected_unplanned")).otherwise(F.lit("skipped_max_datasets")).alias("decision"))


@query(
    "OP78_parameter_order",
    "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'N' THEN l_returnflag END NULLS LAST, l_linestatus, l_partkey, l_linenumber) AS INTEGER) AS parameter_order FROM lineitem",
)
def op78(t):
    rows = t.lineitem.withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return ordering.numbered(rows, ordering.nulls_last("flag", "l_linestatus", "l_partkey", "l_linenumber"), "parameter_order", by=["l_orderkey"]).select("l_orderkey", "l_linenumber", "parameter_order")


@query("OP79_observation_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_index FROM lineitem")
def op79(t):
    return ordering.global_number(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "observation_index").select("l_orderkey", "l_linenumber", "observation_index")


@query(
    "OP80_even_shares",
    """SELECT o_orderkey, q + CASE WHEN p <= r - q * n THEN 1 ELSE 0 END AS share FROM (SELECT *, r // n AS q FROM (SELECT o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p,
least(10000, count(*) OVER w * 999) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)))""",
)
def op80(t):
    return ordering.partitioned_evenly(t.orders, ["o_orderkey"], ["o_custkey"], F.lit(10_000), F.lit(999)).select("o_orderkey", "share")


@query(
    "OP81_admitted",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
a(o_custkey, p, o_orderkey, size, ok, n, total) AS (SELECT o_custkey, p, o_orderkey, size, size <= 500000, CASE WHEN size <= 500000 THEN 1 ELSE 0 END, CASE WHEN size <= 500000 THEN size ELSE 0 END FROM o WHERE p = 1
UNION ALL SELECT o.o_custkey, o.p, o.o_orderkey, o.size, n < 4 AND o.size <= 500000 - total, n + CASE WHEN n < 4 AND o.size <= 500000 - total THEN 1 ELSE 0 END, total + CASE WHEN n < 4 AND o.size <= 500000 - total THEN o.size ELSE 0 END FROM a JOIN o ON a.o_custkey = o.o_custkey AND o.p = a.p + 1)
SELECT o_custkey, o_orderkey, size, ok AS admitted FROM a""",
)
def op81(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return ordering.admitted(rows, ["o_custkey"], ["o_orderkey"], "size", 4, 500_000)


@query("OP82_page", "SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 25")
def op82(t):
    return ordering.page(t.customer.select("c_name", "c_custkey"), ["c_name", "c_custkey"], 50, 25)


@query("OP83_first_by_key", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def op83(t):
    return ordering.first_by_key(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


@query("OP84_bound", "SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def op84(t):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.IntegerType())])
    return sets.bound(schema, sets.empty(t.spark, schema), t.nation.selectExpr("n_name AS name", "n_nationkey AS key"), t.region.selectExpr("r_name AS name", "r_regionkey AS key"))


@query("OP85_either", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def op85(t):
    return sets.either(t.customer.selectExpr("c_nationkey AS k"), t.supplier.selectExpr("s_nationkey AS k"))


@query("OP86_set_operations", "SELECT 'difference' AS kind, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'common', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 INTERSECT SELECT p_partkey FROM part WHERE p_size < 9)")
def op86(t):
    gone = sets.difference(t.customer.selectExpr("c_custkey AS k"), t.orders.selectExpr("o_custkey AS k"))
    shared = sets.common(t.lineitem.where("l_quantity < 3").selectExpr("l_partkey AS k"), t.part.where("p_size < 9").selectExpr("p_partkey AS k"))
    return gone.select(F.lit("difference").alias("kind"), "k").unionByName(shared.select(F.lit("common").alias("kind"), "k"))


@query("OP87_export_order", "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name FROM customer ORDER BY name NULLS LAST, c_custkey")
def op87(t):
    return ordering.export_order(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name")), "name", "c_custkey")


@query(
    "OP96_identities",
    """WITH v AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END AS t FROM part)
SELECT p_partkey, sha256('contract:0.1.0' || chr(10) || 'namespace:tarn.dataset-id.v1' || chr(10) || 'character:' || CAST(strlen(p_name) AS VARCHAR) || ':' || p_name || chr(10) || 'character:' || CAST(strlen(p_brand) AS VARCHAR) || ':' || p_brand
|| chr(10) || coalesce('character:' || CAST(strlen(t) AS VARCHAR) || ':' || t, 'character:NA:')) AS identity FROM v""",
)
def op96(t):
    from tarn.functions.identity import DATASET

    return t.part.select("p_partkey", contract_hash(DATASET, F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("identity"))


@query("OP98_validation", "SELECT 'site_missing' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'identity_repeated', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'interval_reversed', count(*) FROM events WHERE value < 0")
def op98(t):
    from tarn.plans.catalog import violations

    return violations(t.orders.selectExpr("o_custkey AS site_uri"), t.customer.selectExpr("c_custkey AS site_uri"), t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], t.events.selectExpr("0D AS temporal_start", "value AS temporal_end"))


@query("OP108_admitted_numbers", r"SELECT event_id, regexp_full_match(v, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') AS valid FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '01' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '-' || CAST(user_id AS VARCHAR) || '.5' WHEN 3 THEN 'NaN' WHEN 4 THEN '1e3' ELSE '+1' END AS v FROM events)")
def op108(t):
    user = F.col("user_id").cast("string")
    value = F.element_at(F.array(F.lit("01"), user, F.concat(F.lit("-"), user, F.lit(".5")), F.lit("NaN"), F.lit("1e3"), F.lit("+1")), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", numbers.admitted_number(value)["valid"].alias("valid"))


@query("OP109_strict_times", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) END AS at FROM events")
def op109(t):
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.lit("2024-02-30T00:00:00Z")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", temporal.strict_utc(shown).cast("timestamp_ntz").alias("at"))


@query("OP117_hydrated", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS whole, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus = 'O' END AS flag FROM orders")
def op117(t):
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("0"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    flag = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderstatus") == "O").cast("string")).otherwise(F.lit("TRUE"))
    return t.orders.select("o_orderkey", numbers.canonical_integer(key).alias("whole"), numbers.canonical_logical(flag).alias("flag"))
