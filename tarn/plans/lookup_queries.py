"""Lookup operators over the driver's tables: orders and customers stand for identifiers and reference features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import grouping, lookup, points, predicates
from tarn.operators.ordering import global_number
from tarn.plans.registry import Tables, query

# ruff: noqa: D103


def _gages(t: Tables):
    """Inputs: every order's customer key as text, some keys beyond all customers. Reference: customers by name."""
    inputs = t.orders.select(F.col("o_orderkey").alias("input_index"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1_000_000).otherwise(0)).cast("string").alias("requested_id"))
    reference = t.customer.select(F.col("c_custkey").cast("string").alias("provider_id"), F.col("c_name").alias("uri"))
    return inputs, reference


@query(
    "OP46_lookup_with_status",
    """WITH i AS (SELECT o_orderkey AS input_index, CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS requested_id FROM orders),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS provider_id, c_name AS uri FROM customer)
SELECT input_index, requested_id, provider_id, uri, CAST(CASE WHEN provider_id IS NOT NULL THEN row_number() OVER (PARTITION BY input_index ORDER BY uri) END AS INTEGER) AS match_index,
CASE WHEN provider_id IS NULL THEN 'not_found' WHEN count(*) OVER (PARTITION BY input_index) = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM i LEFT JOIN r ON requested_id = provider_id""",
)
def op46(t):
    inputs, reference = _gages(t)
    return lookup.lookup_with_status(inputs, "requested_id", reference, "provider_id", ["uri"])


_BRANDS = "(SELECT DISTINCT p_brand || '-' || CAST(p_size AS VARCHAR) AS requested FROM part UNION ALL SELECT 'Brand#none')"


@query(
    "OP47_comid_to_mainstem",
    f"""WITH i AS (SELECT CAST(row_number() OVER (ORDER BY requested) AS INTEGER) AS input_index, requested FROM {_BRANDS}),
r AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS comid, CAST(p_partkey AS VARCHAR) AS uri FROM part)
SELECT input_index, requested, uri, CAST(CASE WHEN uri IS NOT NULL THEN row_number() OVER (PARTITION BY input_index ORDER BY uri) END AS INTEGER) AS match_index,
CASE WHEN uri IS NULL THEN 'not_found' WHEN count(*) OVER (PARTITION BY input_index) = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
CASE WHEN uri IS NOT NULL THEN 'active_in_mapping_release' END AS mainstem_status
FROM i LEFT JOIN r ON requested = comid""",
)
def op47(t):
    key = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    keys = t.part.select(key.alias("requested")).distinct().unionByName(t.spark.createDataFrame([("Brand#none",)], "requested string"))
    inputs = global_number(keys, ["requested"], "input_index").withColumn("input_index", F.col("input_index").cast("int"))
    reference = t.part.select(key.alias("comid"), F.col("p_partkey").cast("string").alias("uri"))
    found = lookup.lookup_with_status(inputs, "requested", reference, "comid", ["uri"]).drop("comid")
    return found.withColumn("mainstem_status", F.when(F.col("uri").isNotNull(), F.lit("active_in_mapping_release")))


@query(
    "OP48_mainstem_to_comids",
    """SELECT n_nationkey AS input_index, n_name, CAST(c_custkey AS VARCHAR) AS comid, 'matched' AS status,
CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS match_index FROM nation JOIN customer ON n_nationkey = c_nationkey
UNION ALL SELECT n_nationkey, n_name, NULL, 'not_found', NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""",
)
def op48(t):
    reference = t.customer.select("c_nationkey", F.col("c_custkey").cast("string").alias("comid"))
    inputs = t.nation.select(F.col("n_nationkey").alias("input_index"), "n_name")
    return lookup.lookup_with_status(inputs, "input_index", reference, "c_nationkey", ["comid"], ambiguous=False).drop("c_nationkey")


@query(
    "OP49_mainstem_to_gages",
    """SELECT n_nationkey AS input_index, s_name AS gage, 'currentness_not_checked' AS mainstem_status, CASE WHEN s_name IS NULL THEN 'not_found' ELSE 'matched' END AS status,
CAST(CASE WHEN s_name IS NOT NULL THEN row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name, s_suppkey) END AS INTEGER) AS match_index FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""",
)
def op49(t):
    reference = t.supplier.select("s_nationkey", F.col("s_name").alias("gage"), "s_suppkey")
    found = lookup.lookup_with_status(t.nation.select(F.col("n_nationkey").alias("input_index")), "input_index", reference, "s_nationkey", ["gage", "s_suppkey"], ambiguous=False)
    return found.select("input_index", "gage", F.lit("currentness_not_checked").alias("mainstem_status"), "status", "match_index")


@query(
    "OP50_fallback_lookup",
    """WITH i AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS advertised FROM part),
m AS (SELECT s_suppkey % 60 AS k, min(s_name) AS v, count(*) AS n FROM supplier GROUP BY 1)
SELECT p_partkey, p_size, advertised, coalesce(advertised, CASE WHEN n = 1 THEN v END) AS mapped,
CASE WHEN advertised IS NOT NULL THEN 'advertised' WHEN n IS NOT NULL THEN 'mapping' END AS match_source,
CASE WHEN advertised IS NOT NULL OR n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM i LEFT JOIN m ON p_size = k""",
)
def op50(t):
    inputs = t.part.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("advertised"))
    return lookup.fallback_lookup(inputs, "p_size", "advertised", t.supplier.select((F.col("s_suppkey") % 60).alias("k"), F.col("s_name").alias("v")), "k", "v")


@query(
    "OP52_point_to_mainstem",
    """WITH p AS (SELECT c_custkey, 'POINT (' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey % 10 AS VARCHAR) || ')' AS wkt FROM customer),
u AS (SELECT DISTINCT wkt FROM p), l AS (SELECT 'POINT (' || CAST(s_nationkey AS VARCHAR) || ' ' || CAST(s_suppkey % 10 AS VARCHAR) || ')' AS wkt, min(s_name) AS mainstem FROM supplier GROUP BY 1)
SELECT c_custkey, wkt, mainstem, CASE WHEN mainstem IS NULL THEN 'not_found' ELSE 'matched' END AS status FROM p LEFT JOIN (SELECT * FROM u LEFT JOIN l USING (wkt)) USING (wkt)""",
)
def op52(t):
    """Points are looked up once for each distinct geometry, then handed back to every input."""
    wkt = lambda x, y: F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), (y % 10).cast("string"), F.lit(")"))
    points = t.customer.select("c_custkey", wkt(F.col("c_nationkey"), F.col("c_custkey")).alias("wkt"))
    catchments = t.supplier.select(wkt(F.col("s_nationkey"), F.col("s_suppkey")).alias("wkt"), "s_name").groupBy("wkt").agg(F.min("s_name").alias("mainstem"))
    found = points.select("wkt").distinct().join(lookup.joinable(catchments), "wkt", "left")
    return points.join(lookup.joinable(found), "wkt", "left").withColumn("status", F.when(F.col("mainstem").isNull(), F.lit("not_found")).otherwise(F.lit("matched")))


@query(
    "OP52_points_in_areas",
    """WITH p AS (SELECT o_orderkey, (o_orderkey * 17 % 680) / 2.0 - 170 AS x, (o_orderkey * 29 % 320) / 2.0 - 80 AS y FROM orders),
a AS (SELECT c_custkey, c_custkey * 37 % 340 - 170 AS x, c_custkey * 53 % 160 - 80 AS y, 1 + c_custkey % 9 AS r FROM customer)
SELECT o_orderkey, c_custkey AS area_id FROM p, a WHERE abs(p.x - a.x) + abs(p.y - a.y) <= r""",
)
def op52_areas(t):
    """Every order as a point, every customer as a square on its corner, edges included."""
    x, y, r = F.col("c_custkey") * 37 % 340 - 170, F.col("c_custkey") * 53 % 160 - 80, 1 + F.col("c_custkey") % 9
    corners = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners]), F.lit("))"))
    areas = t.customer.select(F.col("c_custkey").alias("area_id"), wkt.alias("area_wkt"))
    return points.in_areas(t.orders.select("o_orderkey"), F.col("o_orderkey") * 17 % 680 / 2 - 170, F.col("o_orderkey") * 29 % 320 / 2 - 80, areas)


@query(
    "OP52_catchment_mainstems",
    """WITH p AS (SELECT c_custkey, (c_custkey * 7 % 720) / 2.0 - 180 AS x, (c_custkey * 11 % 360) / 2.0 - 90 AS y FROM customer), m AS (SELECT n_nationkey AS k, n_name AS uri FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT n_nationkey, 'b' || n_name FROM nation WHERE n_nationkey % 4 = 1),
i AS (SELECT c_custkey, n_nationkey AS comid FROM p LEFT JOIN nation ON x BETWEEN n_nationkey * 14 - 178 AND n_nationkey * 14 - 164 AND y BETWEEN -60 AND 60)
SELECT c_custkey, comid, uri, CAST(CASE WHEN uri IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey, comid ORDER BY uri) END AS INTEGER) AS match_index,
CASE WHEN uri IS NULL THEN 'not_found' WHEN comid % 4 = 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM i LEFT JOIN m ON comid = k""",
)
def op52_catchments(t):
    """Every customer as a point, every nation as a catchment; some have two mainstems, some have none."""
    n = F.col("n_nationkey")
    west, east = (n * 14 - 178).cast("string"), (n * 14 - 164).cast("string")
    box = F.concat(F.lit("POLYGON (("), west, F.lit(" -60, "), east, F.lit(" -60, "), east, F.lit(" 60, "), west, F.lit(" 60, "), west, F.lit(" -60))"))
    catchments = t.nation.select(n.alias("comid"), box.alias("wkt"))
    mapping = t.nation.where("n_nationkey % 4 <> 3").select(n.alias("k"), F.col("n_name").alias("uri")).unionByName(t.nation.where("n_nationkey % 4 = 1").select(n.alias("k"), F.concat(F.lit("b"), "n_name").alias("uri")))
    return points.points_to_mainstems(t.customer, "c_custkey", F.col("c_custkey") * 7 % 720 / 2 - 180, F.col("c_custkey") * 11 % 360 / 2 - 90, catchments, mapping, "k", "uri")


@query(
    "OP53_currentness",
    """SELECT d.doc_id, d.source, coalesce(CASE l.quality WHEN 1 THEN 'current' WHEN 0 THEN 'superseded' END, d.lang) AS lang, d.n_chars
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""",
)
def op53(t):
    current = t.labels.groupBy("doc_id").agg(F.min("quality").alias("q")).select(F.col("doc_id").alias("uri"), F.when(F.col("q") == 1, F.lit("current")).when(F.col("q") == 0, F.lit("superseded")).alias("status"))
    return lookup.with_currentness(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id", current, "uri", {"lang": "status"})


@query(
    "OP54_replacements",
    """WITH r AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1),
x AS (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN names ELSE [] END AS names, r_regionkey > 0 AS superseded FROM region LEFT JOIN r ON r_regionkey = n_regionkey)
SELECT r_regionkey, CAST(i AS INTEGER) AS replacement_place, names[i + 1] AS replacement_uri, CASE WHEN NOT superseded THEN 'current' ELSE 'superseded' END AS status FROM x, unnest(range(len(names))) u(i) WHERE len(names) > 0
UNION ALL SELECT r_regionkey, NULL, NULL, CASE WHEN NOT superseded THEN 'current' ELSE 'superseded_unresolved' END FROM x WHERE len(names) = 0 OR names IS NULL""",
)
def op54(t):
    names = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("names", lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    rows = t.region.join(lookup.joinable(names), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, listed).otherwise(F.lit("")).alias("text"))
    found = lookup.replacements(rows, "text").drop("text")
    return found.withColumn("status", lookup.currentness_status(F.col("r_regionkey") > 0, F.col("replacement_uri")))


@query("OP55_uncovered", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def op55(t):
    return lookup.uncovered(t.part.select("p_partkey", "p_brand"), "p_partkey", t.lineitem.where("l_quantity > 45"), "l_partkey")


@query("OP56_restricted", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def op56(t):
    wanted = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return lookup.restricted(t.customer.select("c_custkey", "c_name"), ["c_custkey"], wanted)


@query("OP18_lookup_scan", "SELECT l_partkey AS comid, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def op18(t):
    """Targets are a semi-join of the scan; only three columns of the wide file are read."""
    targets = t.part.where("p_size = 7").select(F.col("p_partkey").alias("comid"))
    return lookup.restricted(t.lineitem.select(F.col("l_partkey").alias("comid"), "l_orderkey", "l_linenumber"), ["comid"], targets)


@query(
    "OP57_positional",
    """SELECT n_nationkey, n_name, r_name, coalesce(s, 0) AS suppliers, CASE WHEN s IS NULL THEN 'none' WHEN s > 4 THEN 'many' ELSE 'few' END AS state
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""",
)
def op57(t):
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    counts = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    rows = lookup.positional(t.nation.select("n_nationkey", "n_name"), regions, counts, key="n_nationkey")
    return rows.select("n_nationkey", "n_name", "r_name", F.coalesce("s", F.lit(0)).alias("suppliers"), F.when(F.col("s").isNull(), F.lit("none")).when(F.col("s") > 4, F.lit("many")).otherwise(F.lit("few")).alias("state"))


@query(
    "OP59_product_of_parts",
    """WITH l AS (SELECT r_regionkey, CASE WHEN r_regionkey <> 1 THEN [n_name for n_name in names] ELSE [NULL] END AS lefts, CASE WHEN r_regionkey <> 2 THEN [k for k in keys] ELSE [NULL] END AS rights FROM region
JOIN (SELECT n_regionkey, list(n_name) AS names, list(n_nationkey) AS keys FROM nation GROUP BY 1) ON n_regionkey = r_regionkey)
SELECT r_regionkey, lefts, CAST(rights AS INTEGER) AS rights FROM (SELECT r_regionkey, unnest(lefts) AS lefts, rights AS rr FROM l), unnest(rr) u(rights)""",
)
def op59(t):
    parts = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("lefts"), F.collect_list("n_nationkey").alias("rights"))
    none = lambda c, k: F.when(F.col("r_regionkey") != k, F.col(c)).otherwise(F.slice(c, 1, 0)).alias(c)
    return lookup.product_of_parts(parts.select("r_regionkey", none("lefts", 1), none("rights", 2)), "lefts", "rights")


@query("OP60_dereferenced", "SELECT a.c_custkey, b.c_name AS target_name FROM customer a LEFT JOIN customer b ON a.c_custkey + a.c_nationkey = b.c_custkey")
def op60(t):
    nodes = t.customer.select("c_custkey", "c_name", (F.col("c_custkey") + F.col("c_nationkey")).alias("refers_to"))
    return lookup.dereferenced(nodes, "c_custkey", "refers_to").select("c_custkey", F.col("target.c_name").alias("target_name"))


@query(
    "OP17_redirects",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS url, CAST(s_nationkey AS BIGINT) AS location FROM supplier WHERE s_suppkey > s_nationkey),
r(start, final, hops) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT start, location, hops + 1 FROM r JOIN e ON final = url WHERE hops < 10)
SELECT start, arg_max(final, hops) AS final, CAST(max(hops) AS INTEGER) AS hops, CAST(NULL AS VARCHAR) AS problem FROM r GROUP BY start""",
)
def op17(t):
    edges = t.supplier.where("s_suppkey > s_nationkey").select(F.col("s_suppkey").alias("url"), F.col("s_nationkey").cast("long").alias("location"))
    return lookup.resolved_redirects(edges, t.supplier.select(F.col("s_suppkey").alias("url")))


@query(
    "OP66_lookup_metadata",
    """WITH j AS (SELECT o_orderkey, CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS k, c_custkey FROM orders
LEFT JOIN customer ON o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END = c_custkey)
SELECT count(DISTINCT o_orderkey) AS input_count, count(DISTINCT k) AS unique_count, count(c_custkey) AS match_count, count(c_custkey) AS matched_count, CAST(0 AS BIGINT) AS ambiguous_count,
count(*) FILTER (c_custkey IS NULL) AS not_found_count FROM j""",
)
def op66(t):
    inputs, reference = _gages(t)
    return lookup.lookup_metadata(lookup.lookup_with_status(inputs, "requested_id", reference, "provider_id", ["uri"]), "input_index", "requested_id")


@query("OP37_bound_query", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def op37(t):
    return predicates.bound_query(t.customer, {"c_nationkey": 3, "c_mktsegment": "BUILDING"}).select("c_custkey", "c_name")


@query("OP70_complete_products", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS lefts, count(DISTINCT l_suppkey % 3) AS rights, count(DISTINCT (l_returnflag, l_suppkey % 3)) AS pairs, count(DISTINCT (l_returnflag, l_suppkey % 3)) = count(DISTINCT l_returnflag) * count(DISTINCT l_suppkey % 3) AS complete FROM lineitem GROUP BY 1")
def op70(t):
    return grouping.complete_products(t.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 3).alias("s")), "l_orderkey", "l_returnflag", "s")


@query("OP19_release_checks", "SELECT 'row_count' AS rule, abs(count(*) - 1000) AS violations FROM customer UNION ALL SELECT 'known_answer', CAST(1 AS BIGINT) UNION ALL SELECT 'absent_key', count(*) FROM customer WHERE c_custkey = 5")
def op19(t):
    reference = t.customer.select(F.col("c_custkey").cast("string").alias("k"), "c_name")
    name = t.customer.where("c_custkey = 7").first()["c_name"]
    return lookup.release_violations(reference, "k", "c_name", 1000, {"7": name, "8": "nobody"}, ["5", "none"])
