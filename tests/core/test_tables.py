import json
import subprocess
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import schemas, storage
from tarn.operators import lookup, ordering, predicates, sets
from tarn.plans import fetch, graph, harmonize, run
from tarn.sinks import package, publish
from tarn.sinks import text as sink
from tarn.sources import delimited, documents, vocabularies
from tarn.sources.features import FeatureCollections
from tarn.sources.graph_results import GraphResults
from tarn.streaming import observations as stream

U = "http://qudt.org/vocab/unit/"


def test_schemas_have_empty_tables(spark):
    for schema in schemas.ALL.values():
        assert sets.empty(spark, schema).schema == schema and sets.empty(spark, schema).count() == 0


NATIVE = "value string, unit_label string, variable_mapped boolean, unit_known boolean, source_unit_uri string, source_unit_label string"


def test_known_flow_values(spark):
    rows = spark.createDataFrame([("183", "ft^3/s", True, True, f"{U}FT3-PER-SEC", "ft^3/s"), ("151", "ft^3/s", True, True, f"{U}FT3-PER-SEC", "ft^3/s")], NATIVE)
    assert [r["harmonized_value"] for r in harmonize.harmonized_values(rows).orderBy(F.desc("value")).collect()] == [5.181982926336, 4.275843835392]


def test_status_cascade(spark):
    f = f"{U}DEG_F"
    cases = [
        ("1", "deg F", False, True, f, "deg F", "variable_ambiguous"), ("1", "F", True, True, f, "deg F", "unit_conflict"), ("1", None, True, True, f, "deg F", "unit_conflict"), ("x", "deg F", True, True, f, "deg F", "invalid_value"),
        ("1", "y", True, True, f"{U}YD", "y", "unit_unmapped"), ("1", "deg C", True, True, f"{U}DEG_C", "deg C", "harmonized_identity"), (None, "deg C", True, True, f"{U}DEG_C", "deg C", "harmonized_missing"), (None, "deg F", True, True, f, "deg F", "harmonized_missing"),
        ("1", "mm", True, True, f"{U}MilliM", "mm", "conversion_unavailable"), ("212", "deg F", True, True, f, "deg F", "harmonized_converted"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {NATIVE}, wanted string")
    for r in harmonize.harmonized_values(rows).collect():
        assert r["status"] == r["wanted"], r
        if r["status"] == "harmonized_converted":
            assert r["harmonized_value"] == pytest.approx(100) and r["conversion_rule_id"] == "temperature-deg-f-to-deg-c"
    changed = harmonize.harmonized_values(rows.where("i = 8"), {"length": f"{U}IN"}).first()
    assert changed["status"] == "harmonized_converted" and changed["unit_uri"] == f"{U}IN"
    with pytest.raises(ValueError, match="no reviewed unit"):
        vocabularies.target_units(spark, {"length": f"{U}DEG_C"})


def test_one_bad_zone_leaves_a_resource_native(spark):
    url = "https://www.waterqualitydata.us/data/Result/search?siteid=S&characteristicName=Flow"
    names = ["result_id", "MonitoringLocationIdentifier", "ActivityStartDate", "ActivityStartTime.Time", "ActivityStartTime.TimeZoneCode", "CharacteristicName", "ResultMeasureValue", "ResultMeasure.MeasureUnitCode", "MeasureQualifierCode", "distribution_url", "catalog_variable_name"]
    rows = [("a", "S", "2024-01-01", "00:00:00", "EST", "Flow", "1", "ft", "NA", url, "Flow"), ("a", "S", "2024-01-02", "00:00:00", "PST", "Flow", "", "ft", "x", url, "Flow"), ("b", "S", "2024-01-01", "00:00:00", "EST", "Flow", "1", "ft", "", url, "Flow"), ("b", "S", "2024-01-01", "00:00:00", "ZZZ", "Flow", "1", "ft", "", url, "Flow"), ("c", "T", "2024-01-01", "00:00:00", "EST", "Flow", "1", "ft", "", url, "Flow")]
    got = harmonize.wqp_native(spark.createDataFrame(rows, names)).orderBy("ActivityStartDate").collect()
    assert [(r["result_id"], r["value"], r["qualifier"], r["datetime"].hour) for r in got] == [("a", "1", None, 5), ("a", None, "x", 8)]


def test_lookup_keeps_inputs(spark):
    inputs = spark.createDataFrame([(1, "500"), (2, "600"), (3, "500"), (4, "9"), (5, None)], "input_index int, comid string")
    reference = spark.createDataFrame([("500", "m20"), ("500", "m10"), ("600", "m30"), (None, "m40")], "key string, uri string")
    got = [(r["input_index"], r["status"], r["match_index"], r["uri"]) for r in lookup.lookup_with_status(inputs, "comid", reference, "key", ["uri"]).orderBy("input_index", "match_index").collect()]
    assert got == [(1, "ambiguous", 1, "m10"), (1, "ambiguous", 2, "m20"), (2, "matched", 1, "m30"), (3, "ambiguous", 1, "m10"), (3, "ambiguous", 2, "m20"), (4, "not_found", None, None), (5, "not_found", None, None)]
    again = lookup.lookup_with_status(reference.select(F.monotonically_increasing_id().alias("input_index"), "uri"), "uri", reference.withColumnRenamed("uri", "u"), "u", ["key"], ambiguous=False)
    assert {r["status"] for r in again.collect()} == {"matched"}


def test_large_sides_are_stored(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    inputs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(300)], "input_index int, k string")
    reference = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c")], "key string, uri string")
    found = lookup.lookup_with_status(inputs, "k", reference, "key", ["uri"])
    assert {r["status"]: r["count"] for r in found.groupBy("status").count().collect()} == {"ambiguous": 200, "matched": 1, "not_found": 199}
    assert lookup.restricted(inputs, ["k"], reference.withColumnRenamed("key", "k")).count() == 101
    assert lookup.uncovered(inputs, "k", reference, "key").count() == 199


def test_redirect_loops_and_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), *[(f"n{i}", f"n{i + 1}") for i in range(8)]], "url string, location string")
    got = {r["start"]: (r["final"], r["hops"], r["problem"]) for r in lookup.resolved_redirects(edges, edges.select("url").unionByName(spark.createDataFrame([("q",)], "url string")), limit=5).collect()}
    assert got["a"] == ("c", 2, None) and got["q"] == ("q", 0, None)
    assert got["x"][2] == got["s"][2] == "redirect_loop" and got["n0"] == ("n5", 5, "too_many_redirects") and got["n4"] == ("n8", 4, None)


def test_plan_does_not_depend_on_row_order(spark):
    row = lambda site, dist, var, provider, fetchable=True: (site, "d", dist, provider, "n", f"https://example.org/{dist}.csv", None, None, None, fetchable, None, None, var, None, None, None, None, None)
    rows = [row("s1", "x1", "v1", "p"), row("s1", "x1", "v2", "p"), row("s0", "x2", "v1", None), row("s2", "x3", None, "a", False), row("s3", "x4", "v1", "p"), row("s3", None, "v1", "p"), row("s4", "x5", "v1", "p"), row("other", "x5", "v1", "p")]
    names = [*fetch.FACTS[:2], "distribution_id", *fetch.FACTS[2:], *fetch.VARIABLE]
    types = {"conforms_to": "array<string>", "fetchable": "boolean", "temporal_start": "timestamp", "temporal_end": "timestamp"}
    ddl = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    results = []
    for given in (rows, rows[::-1]):
        plan = fetch.fetch_plan(spark.createDataFrame(given, ddl), max_datasets=2)
        assert [r["distribution_id"] for r in plan.conflicts.collect()] == ["x5"] and plan.unplannable.first()[0] == 1
        results.append([tuple(r) for r in plan.distributions.select("selection_order", "fetch_order", "distribution_id", "variable_count", "decision").orderBy("selection_order").collect()])
    assert results[0] == results[1] == [(1, None, "x3", 1, "not_fetchable"), (2, 1, "x1", 2, "selected_unplanned"), (3, 2, "x4", 1, "selected_unplanned"), (4, None, "x2", 1, "skipped_max_datasets")]


def test_classification(spark):
    urls = {"https://a.org/collections/x/position": "edr", "https://api.waterdata.usgs.gov/ogcapi/v0/collections/continuous/items": "usgs_waterdata_continuous", "https://waterservices.usgs.gov/nwis/dv/?x": "nwis_legacy_dv", "https://a.org/collections/x/items?f=json": "ogc_api_features", "ftp://a.org/x.csv": "csv", "ftp://a.org/collections/x/items": "unknown"}
    rows = spark.createDataFrame([(u, None, None, w) for u, w in urls.items()] + [("https://a.org/", "text/csv", None, "csv"), ("https://a.org/", None, ["http://www.opengis.net/spec/ogcapi-edr-1/1.0/conf/core"], "edr")], "access_url string, media_type string, conforms_to array<string>, wanted string")
    assert predicates.classified(rows).where("handler_id <> wanted").count() == 0
    with pytest.raises(ValueError):
        predicates.handler_table(spark, predicates.HANDLERS[:-1])


def test_queries_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert predicates.bound_query(df, {"n": 1}).count() == 1
    for bad in ({"x": 1}, {"n": "1"}, {"s": 1}):
        with pytest.raises(ValueError):
            predicates.bound_query(df, bad)
    with pytest.raises(ValueError):
        predicates.bound_query(df, {"s": "a"}, {"s": ["b"]})
    for bad in ((1, 2, 3), (0, 5, 1, 4)):
        with pytest.raises(ValueError):
            predicates.in_bbox(F.lit(1.0), F.lit(1.0), bad)
    with pytest.raises(ValueError):
        ordering.page(df, ["n"], 1001)
    with pytest.raises(ValueError):
        graph.datasets_for_sites(None, [])


def test_strict_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"id","a/b"\r\n"1","x ""y"""\r\n2,\r\n3,a,b\n4,a"b\n\n')
    rows, problems = delimited.read_strict(spark, str(tmp_path / "a.csv"), dots=True)
    assert rows.columns == ["id", "a.b"] and [tuple(r) for r in rows.orderBy("id").collect()] == [("1", 'x "y"'), ("2", "")]
    assert sorted(r["problem"] for r in problems.collect()) == ["blank_record", "quoting", "record_width"]
    for bad in ("a,a", "a,", ""):
        with pytest.raises(ValueError):
            delimited.header_of(bad)


def test_strict_csv_bears_any_field(spark):
    long = '"' + "x" * 1_000_000 + '""y"'
    wide = ",".join(['"a"'] * 100_000)
    lines = spark.createDataFrame([(long,), ("z" * 1_000_000,), ('"' + "q" * 1_000_000,), (wide,), (wide + '"',)], "value string")
    got = [(r["problem"], r["n"], r["size"]) for r in delimited.scan_lines(lines.coalesce(1), 1).select("problem", F.size("fields").alias("n"), F.char_length(F.col("fields")[0]).alias("size")).collect()]
    assert got == [(None, 1, 1_000_002), (None, 1, 1_000_000), ("quoting", None, None), ("record_width", None, None), ("quoting", None, None)]
    assert delimited.scan_lines(lines.where("value LIKE '\"a\"%'"), 100_000).where("problem IS NULL").count() == 1


def test_strict_csv_keeps_what_looks_like_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"a","b"\r\n"a","b"\r\n"1","2"\r\n"3\r4","5"\r\n')
    (tmp_path / "b.csv").write_bytes(b'\xef\xbb\xbf"a","b"\n"a","b"\n6,7')
    (tmp_path / "c.csv").write_bytes(b'"a","c"\n8,9\n')
    rows, problems = delimited.read_strict(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("1", "2"), ("6", "7"), ("a", "b"), ("a", "b")]
    assert sorted((r["problem"], r["value"]) for r in problems.collect()) == [("control_character", '"3\r4","5"\r'), ("header", "8,9")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        (tmp_path / "d").mkdir()
        (tmp_path / "d" / "long.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(500)) + "a,b\n")
        rows, problems = delimited.read_strict(spark, str(tmp_path / "d"))
        assert rows.count() == 501 and problems.count() == 0 and rows.rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_result_hash_sees_order_and_nulls(spark):
    rows = [(i + 1, None if i == 3 else f"v{i}") for i in range(40)]
    base = delimited.result_hash(spark.createDataFrame(rows, "n long, v string"), "n", ["v"], fan=4).first()[0]
    assert base == delimited.result_hash(spark.createDataFrame(rows[::-1], "n long, v string"), "n", ["v"], fan=4).first()[0]
    for other in ([*rows[:3], (4, ""), *rows[4:]], [(1, rows[1][1]), (2, rows[0][1]), *rows[2:]]):
        assert base != delimited.result_hash(spark.createDataFrame(other, "n long, v string"), "n", ["v"], fan=4).first()[0]


def test_query_results(spark):
    bodies = ['{"head":{"vars":["a","b"]},"results":{"bindings":[{},{"a":{"type":"bnode","value":"x"}}]}}', '{"head":{},"boolean":true}', '{"head":{"vars":["a"]},"results":{"bindings":[{"z":{"type":"uri","value":"x"}}]}}', '{"results":{"bindings":[]},"boolean":false,"head":{}}', "{"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")
    got = {r["doc_id"]: (r["form"], r["rows"], r["answer"], r["problem"]) for r in documents.result_shape(docs).collect()}
    assert got[0] == ("select", 2, None, None) and got[1][0] == "ask" and got[1][2] is True and got[2][3] == "terms" and got[3][3] == got[4][3] == "result_form"
    row = documents.select_bindings(docs.where("doc_id = 0")).first()
    assert (row["row"], row["variable"], row["term_type"], len(row["bnode_scope"])) == (2, "a", "bnode", 64)


def test_runs_isolate_failures(spark):
    good = json.dumps({"type": "FeatureCollection", "features": [], "numberReturned": 0, "links": []})
    rows = [("r1", "usgs_waterdata_daily", good), ("r2", "usgs_waterdata_daily", None), ("r3", "edr", "{}"), ("r4", "csv", "x"), ("r5", "nwis_legacy_dv", "x"), ("r6", "csv", "a,a\n1,2")]
    payloads = spark.createDataFrame(rows, "request_id string, handler_id string, body string")
    for name, value in {"parameter": "flow", "site": "S", "parameter_code": "1", "statistic_id": "1", "time_start": "2024-01-01", "time_end": "2024-01-02"}.items():
        payloads = payloads.withColumn(name, F.lit(value))
    payloads = payloads.withColumn("lon", F.lit(0.0)).withColumn("lat", F.lit(0.0)).withColumn("page_limit", F.lit(5))
    statuses = run.run_status(payloads)
    assert {r["request_id"]: r["status"] for r in statuses.collect()} == {"r1": "succeeded", "r2": "transport_failed", "r3": "parse_failed", "r4": "succeeded", "r5": "capability_failed", "r6": "parse_failed"}
    assert {r["request_id"]: r["status"] for r in run.run_status(payloads, unavailable=["csv"]).collect()}["r4"] == "capability_failed"
    assert run.overall_status(statuses).first()["status"] == "partial"
    assert [p for _, _, p in run.preflight({"h": {"numpy": "1.0", "nothing-of-the-kind": "1", "pandas": "999"}})] == ["missing", None, "outdated"]


def test_packages(spark, tmp_path):
    sites = spark.createDataFrame([(1, "a", 0.1), (2, None, None)], "k int, name string, x double")
    path = str(tmp_path / "p")
    package.write_package(spark, path, {"sites": sites}, {"catalog": "h1"})
    assert {r["status"] for r in package.verify_package(spark, path).collect()} == {"verified"}
    assert sorted(map(tuple, package.load_package(spark, path)["sites"].collect())) == sorted(map(tuple, sites.collect()))
    assert package.lineage_matches(spark, path, catalog="h1") and not package.lineage_matches(spark, path, catalog="h2")
    assert json.loads(package.frictionless(spark, path))["resources"][0]["schema"]["fields"][2] == {"name": "x", "type": "number"}
    with pytest.raises(FileExistsError):
        package.write_package(spark, path, {"sites": sites})
    package.write_package(spark, path, {"sites": sites.limit(1)}, replace=True)
    assert package.load_package(spark, path)["sites"].count() == 1 and [p.name for p in tmp_path.iterdir()] == ["p"]
    data = next((tmp_path / "p" / "sites").glob("*.parquet"))
    data.write_bytes(data.read_bytes() + b"x")
    (data.parent / f".{data.name}.crc").unlink()  # the file system's own check would come first
    (tmp_path / "p" / "sites" / "more.bin").write_bytes(b"y")
    assert {r["status"] for r in package.verify_package(spark, path).collect()} >= {"altered", "unlisted"}
    with pytest.raises(ValueError, match="not verified"):
        package.load_package(spark, path)


def test_canonical_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1, 'a "b"', True), (2, None, "", None), (3, 1e300, "x,y", False)], "k int, x double, s string, b boolean")
    sink.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    texts, problems = delimited.read_strict(spark, str(tmp_path / "c"))
    assert problems.count() == 0
    back = package.hydrated(texts, rows.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, 0.1, 'a "b"', True), (2, None, None, None), (3, 1e300, "x,y", False)]
    odd = spark.createDataFrame([("01", "TRUE", "2024-01-01T00:00:00Z")], "i string, b string, t string")
    kinds = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("b", T.BooleanType()), T.StructField("t", T.TimestampType())])
    assert tuple(package.hydrated(odd, kinds).first()) == (None, None, None)


def test_sitemap(spark):
    urls = spark.createDataFrame([("https://b.org/?x=1&y",), ("https://a.org",), ("HTTPS://a.org/#f",), ("nothing",)], "u string")
    text = sink.sitemap(urls, "u")
    assert text.count("<loc>") == 2 and text.index("a.org") < text.index("b.org") and "x=1&amp;y" in text


def test_findings(spark):
    rows = spark.createDataFrame([("https://a/", "n", "https://d/", "http://10.0.0.1/", "v", None), ("bad", None, "https://d/", None, None, None)], "site_uri string, site_name string, dataset_uri string, distribution_url string, variable_name string, unit_uri string")
    found = publish.findings(rows.unionByName(rows))
    assert [r["rule_id"] for r in found.collect()] == ["site-uri", "distribution-url", "site-name", "variable-unit"] and not publish.is_valid(found)


def test_stream_is_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([("183", "ft^3/s", True, True, f"{U}FT3-PER-SEC", "ft^3/s"), ("x", "m", True, True, f"{U}M", "m")], NATIVE)
    rows.write.parquet(str(tmp_path / "in"))
    stream.write_stream(stream.harmonized_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, harmonize.harmonized_values(rows).collect()), key=str)


@pytest.fixture
def service():
    asked = []
    features = [{"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": {"code": f"0{i}", "n": i, "even": i % 2 == 0}} for i in range(25)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append(q)
            found = [f for f in features if "code" not in q or f["properties"]["code"] == q["code"]]
            page = found[int(q["offset"]) :][: int(q["limit"])]
            told = {} if self.path.startswith("/uncounted") else {"numberMatched": len(found)}
            body = json.dumps({"type": "FeatureCollection", "features": page, "numberReturned": len(page), **told}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            asked.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            rows = [{"site": {"type": "uri", "value": "urn:a"}}, {"site": {"type": "uri", "value": "urn:b"}, "name": {"type": "typed-literal", "value": "2", "datatype": "urn:int"}}]
            body = json.dumps({"head": {"vars": ["site", "name"]}, "results": {"bindings": rows}}).encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html" if "html" in asked[-1] else "application/sparql-results+json; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/items", asked
    server.shutdown()


def test_feature_collections(spark, service):
    url, asked = service
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureCollections)
    read = lambda: spark.read.format("feature_collection").option("url", url).option("limit", 10).option("properties", "code string, n long, even boolean").load()
    rows = read().orderBy("n").collect()
    assert len(rows) == 25 and rows[3]["code"] == "03" and rows[4]["even"] is True and json.loads(rows[5]["geometry"])["coordinates"] == [5, 0]
    uncounted = spark.read.format("feature_collection").option("url", url.replace("/items", "/uncounted")).option("limit", 10).option("properties", "n long")
    assert sorted(r["n"] for r in uncounted.load().collect()) == list(range(25))
    with pytest.raises(Exception, match="more than 1 pages"):
        uncounted.option("pages", 1).load().collect()
    asked.clear()
    assert [r["n"] for r in read().where("code = '07'").collect()] == [7]
    assert all(q.get("code") == "07" for q in asked) and asked


def test_graph_results(spark, service):
    url, asked = service
    spark.dataSource.register(GraphResults)
    read = lambda query, **more: spark.read.format("graph_results").option("url", url).option("query", query).options(**more).load()
    rows = read("SELECT ?site ?name").orderBy("row", "variable_index").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "site", "uri", "urn:a", None, None), (2, 1, "site", "uri", "urn:b", None, None), (2, 2, "name", "literal", "2", "urn:int", None)] and asked[-1] == "SELECT ?site ?name"
    for query, more, message in (("html", {}, "of type text/html"), ("x", {"max_bytes": 10}, "more than 10 bytes"), ("x", {"max_rows": 1}, "more than 1 rows")):
        with pytest.raises(Exception, match=message):
            read(query, **more).collect()


def test_parameters():
    import datetime as dt

    from tarn.plans import parameters as p

    assert p.uri_list(["urn:b", "urn:a", "urn:b"]) == ["urn:a", "urn:b"] and p.whole(5, 1, 10) == 5 and p.literal("é") == "é"
    assert p.instant(dt.datetime(2024, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))).hour == 0
    assert p.area("POLYGON ((0 0, 1 0, 1 1, 0 0))")
    for bad in (lambda: p.uri("a b"), lambda: p.uri("urn:<x>"), lambda: p.uri_list([]), lambda: p.whole(True, 0, 1), lambda: p.whole(11, 1, 10), lambda: p.literal("a\n"), lambda: p.instant(dt.datetime(2024, 1, 1)), lambda: p.area("POLYGON ((0 0, 200 0, 1 1, 0 0))")):
        with pytest.raises(ValueError):
            bad()


def test_stored_tables_are_removed_at_the_end(spark):
    rows = storage.stored(spark.range(3), "three")
    path = rows.inputFiles()[0].removeprefix("file://")
    assert f"/tarn-{spark.sparkContext.applicationId}/three-" in path and rows.count() == 3
    code = "import sys\nfrom pyspark.sql import SparkSession\nfrom tarn.storage import stored\nspark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nprint('AT', stored(spark.range(3), 'three').inputFiles()[0])"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120).stdout
    folder = Path(said.split("AT file://")[1].split("/three-")[0].strip())
    for _ in range(100):  # the virtual machine ends after Python
        if not folder.exists():
            break
        time.sleep(0.2)
    assert folder.name.startswith("tarn-local") and not folder.exists()


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True), isLocal=lambda: False)
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: context)))
    with pytest.raises(RuntimeError, match="share"):
        storage.shared_folder(spark)
