"""Paths that only large tables take, and inputs of odd sizes, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import grouping, lookup, ordering, predicates, spatial
from tarn.plans import run
from tarn.sinks import package, publish
from tarn.sinks import text as sink
from tarn.sources import delimited, releases


def test_numbering_by_ranges_is_numbering(spark):
    own = random.Random(1)
    rows = [(None if own.random() < 0.1 else f"k{own.randint(0, 5)}" if own.random() < 0.6 else "hot", own.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    got = {r["i"]: (r["n"], r["t"]) for r in lookup.numbered_by_ranges(df, ["k"], [F.col("o").desc(), F.col("i").asc()], "n", "t").collect()}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in group] == [(n + 1, len(group)) for n in range(len(group))]


def test_large_tables_are_numbered_by_ranges(spark, monkeypatch):
    df = spark.range(300).selectExpr("id % 3 AS k", "id")
    small = sorted(map(tuple, ordering.numbered(df, ["id"], "n", by=["k"]).collect()))
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, ordering.numbered(df, ["id"], "n", by=["k"]).collect())) == small


def test_admission_streams_over_batches(spark):
    own = random.Random(2)
    rows = [("hot" if i % 3 else None, i, own.choice([None, 1, 5, 40, 200])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["o"]: r["admitted"] for r in ordering.admitted(df, ["g"], ["o"], "size", 60, 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("hot", None):
        count = total = 0
        for _, o, size in [r for r in rows if r[0] == g]:
            fits = size is not None and count < 60 and size <= 300 - total
            count, total = count + fits, total + (size if fits else 0)
            assert got[o] is fits


def test_fragments_and_first_values(spark):
    rows = [(1, 2, ["b", None], ["x"]), (1, 1, ["a", "b"], None), (1, 3, None, ["x", "y"]), (2, 1, None, []), (3, 1, ["z", "z"], ["z"])]
    df = spark.createDataFrame(rows, "node int, o int, v array<string>, w array<string>")
    got = {r["node"]: (r["v"], r["w"]) for r in grouping.merged_fragments(df, "node", "o", ["v", "w"]).collect()}
    assert got == {1: (["a", "b", None], ["x", "y"]), 2: ([], []), 3: (["z"], ["z"])}
    values = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 3, "y"), ("b", 1, None), ("c", 1, "q"), ("c", 2, "q")], "k string, o int, v string")
    assert sorted(map(tuple, grouping.first_values(values, "k", "v", ["o"]).collect())) == [("a", "x", True), ("b", None, False), ("c", "q", False)]


def test_boxes_of_any_size_meet(spark):
    own = random.Random(3)
    box = lambda w, s, e, n: f"POLYGON (({w} {s}, {e} {s}, {e} {n}, {w} {n}, {w} {s}))"
    areas = [("world", (-180, -90, 180, 90))] + [(f"a{i}", (x, y, x + d, y + d)) for i, (x, y, d) in enumerate((own.uniform(-170, 120), own.uniform(-80, 40), own.choice([0.01, 0.3, 5, 40])) for _ in range(40))]
    lines = [(f"l{i}", x, y, x + d, y) for i, (x, y, d) in enumerate((own.uniform(-170, 100), own.uniform(-80, 80), own.choice([0.02, 1, 60])) for _ in range(60))]
    a = spark.createDataFrame([(k, box(*b)) for k, b in areas], "area_id string, area_wkt string")
    b = spark.createDataFrame([(k, f"LINESTRING ({x1} {y1}, {x2} {y2})") for k, x1, y1, x2, y2 in lines], "line_id string, line_wkt string")
    found = spatial.intersecting(a, b)
    want = {(k, m) for k, (w, s, e, n) in areas for m, x1, y1, x2, _ in lines if s < y1 < n and max(w, x1) < min(e, x2)}
    rows = found.select("area_id", "line_id").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_registry_errors():
    text = json.dumps({"handlers": [{"name": "a", "outcome": "fetch", "lifecycle": "active", "every": [{"fact": "access_url", "operator": "regex", "values": ["^x"]}], "some": []}, {"name": "rest", "outcome": "reference_only", "lifecycle": "active", "every": [], "some": []}]})
    assert [h.name for h in predicates.load_handlers(text)] == ["a", "rest"]
    for old, new in (('"rest"', '"a"'), ('"regex"', '"like"'), ('["^x"]', '["("]'), ('["^x"]', "[]"), ('["^x"]', "[1]"), ('"access_url"', '"color"'), ('"fetch"', '"maybe"'), ('"active"', '"old"'), ('"a"', '"A b"'), ('"every": [], ', ""), ('"lifecycle"', '"cycle"'), ('"handlers"', '"rows"')):
        with pytest.raises(ValueError):
            predicates.load_handlers(text.replace(old, new, 1) if old != '"every": [], ' else text.replace(old, new))


def test_snapshots_and_optional_tables(spark, tmp_path):
    sets = spark.createDataFrame([(1, "a, \"b\"", 0.1, True), (2, None, None, False)], "k int, name string, x double, b boolean")
    path = str(tmp_path / "snapshot")
    package.write_snapshot(spark, path, {"datasets": sets})
    assert sorted(map(tuple, package.catalog_view(spark, path)["datasets"].collect())) == sorted(map(tuple, sets.collect()))
    for bad in ({"sites": sets}, {"datasets": sets, "more": sets}):
        with pytest.raises(ValueError):
            package.write_snapshot(spark, str(tmp_path / "other"), bad)
    nested = str(tmp_path / "p")
    package.write_package(spark, nested, {"sites": sets, "native": sets.withColumn("part", F.col("k"))}, {"catalog": "h"}, optional=["native"])
    assert {r["path"].split("/")[0] for r in package.verify_package(spark, nested).collect()} == {"sites", "native"}
    package.Place(spark, f"{nested}/native").remove()
    assert package.verification(spark, nested).first()["status"] == "verified_with_optional_absences" and set(package.load_package(spark, nested)) == {"sites"}
    assert package.replayed(spark, nested, catalog="h")["sites"].count() == 2
    with pytest.raises(ValueError, match="something else"):
        package.replayed(spark, nested, catalog="other")
    with pytest.raises(ValueError, match="no requests"):
        package.exported_requests(spark, nested)
    with pytest.raises(ValueError):
        package.write_package(spark, str(tmp_path / "q"), {"sites": sets}, optional=["more"])


def test_releases(spark, tmp_path):
    (tmp_path / "r.csv").write_text('"comid","uri"\n"1","a"\n')
    facts = releases._facts(spark, str(tmp_path / "r.csv")).first()
    target = str(tmp_path / "installed")
    assert releases.info(spark, target).count() == 0
    with pytest.raises(ValueError, match="isn't the release"):
        releases.install(spark, str(tmp_path / "r.csv"), target, "v1", facts["bytes"], "0" * 64)
    releases.install(spark, str(tmp_path / "r.csv"), target, "v1", facts["bytes"], facts["sha256"])
    assert releases.lookup(spark, target).collect() == [("1", "a")]
    with pytest.raises(FileExistsError):
        releases.install(spark, str(tmp_path / "r.csv"), target, "v1", facts["bytes"], facts["sha256"])
    (tmp_path / "installed" / ".asset.crc").unlink(missing_ok=True)
    (tmp_path / "installed" / "asset").write_text('"comid","uri"\n"1","b"\n')
    assert {r["rule"]: r["fine"] for r in releases.checks(spark, target).collect()} == {"size": True, "sha256": False}
    with pytest.raises(ValueError, match="receipt"):
        releases.lookup(spark, target)


def test_csv_documents(spark):
    bodies = {"fine": "﻿a,b\r\n1,\"x\"\"y\"\r\n", "only a header": "a,b", "twice": "a,a\n1,2\n", "empty": "", "blank": "a\n\n1\n", "lone": "a,b\n1,2\r3\n", "open": 'a,b\n"1,2\n', None: None}
    df = spark.createDataFrame(list(bodies.items()), "doc_id string, body string")
    got = {r["doc_id"]: (r["problem"], r["rows"]) for r in delimited.csv_documents(df).collect()}
    assert got["fine"] == (None, 1) and got["only a header"] == (None, 0) and got["twice"][0] == got["empty"][0] == got[None][0] == "header"
    assert got["blank"][0] == "blank_record" and got["lone"][0] == "control_character" and got["open"][0] == "quoting"
    assert [(r["doc_id"], r["record"]) for r in delimited.csv_document_rows(df).collect()] == [("fine", {"a": "1", "b": 'x"y'})]
    assert run.admitted_requests(spark.createDataFrame([("r", i, 10) for i in range(40)], "run_id string, fetch_order int, response_byte_limit long")).where("admitted").count() == 32


def test_findings_of_documents(spark):
    site = {"@id": "https://e.org/s", "@type": "hyf:HY_HydrometricFeature", "hyf:HY_HydroLocationType": "hydrometricStation", "schema:name": "n", "schema:provider": {"@id": "https://p.org", "schema:name": "p", "schema:url": "https://p.org/"}, "gsp:hasGeometry": {"gsp:asWKT": "POINT (1 2)"}}
    context = {"schema": "https://schema.org/", "hyf": "https://www.opengis.net/def/schema/hy_features/hyf/", "gsp": "http://www.opengis.net/ont/geosparql#", "x": "https://e.org/x/"}
    good = {"@context": context, "x:profileVersion": "1.0.0", "x:profile": {"@id": "https://e.org/profile"}, **site}
    bad = {**good, "gsp:hasGeometry": {"gsp:asWKT": "LINESTRING (1 2, 3 4)"}, "hyf:HY_HydroLocationType": "somewhere", "schema:subjectOf": {"@type": "schema:Dataset", "schema:name": "d"}}
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "{}"), ("broken", "{")], "profile_uri string, body string")
    found = publish.document_findings(df, "1.0.0", "https://e.org/profile").collect()
    assert [r for r in found if r["profile_uri"] == "good"] == []
    assert [(r["rule_id"], r["json_pointer"]) for r in found if r["profile_uri"] == "bad"] == [("site.geometry", "/@graph/0/geo:hasGeometry/geo:asWKT"), ("site.location_type", "/@graph/0/hyf:HY_HydroLocationType"), ("dataset.distribution", "/dataset/0/schema:distribution"), ("dataset.variable", "/dataset/0/schema:variableMeasured")]
    assert {r["rule_id"] for r in found if r["profile_uri"] == "none"} == {"profile.version", "profile.identifier", "site.required"}
    assert [r["rule_id"] for r in found if r["profile_uri"] == "broken"] == ["document.parse"]
    with pytest.raises(ValueError):
        sink.package_report({"more": df})


def test_single_items_and_areas(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    status = lambda rows, **more: [(r["k"], r["status"]) for r in lookup.single_item(rows, ["k"], **more).collect()]
    assert status(df.where("k = 2")) == [(2, "matched")] and sorted(status(df)) == [(1, "ambiguous"), (2, "ambiguous")]
    assert status(df.where("k = 9")) == [(None, "not_found")] and status(df.where("k = 9"), fallback=df.where("k = 3")) == [(3, "matched_by_fallback")]
    with pytest.raises(ValueError):
        predicates.area_of(F.lit("x"), "country")
    with pytest.raises(ValueError):
        spatial.to_crs84(F.lit(1.0), F.lit(1.0), "EPSG:27700")


def test_a_scope_removes_what_was_written_in_it(spark):
    from tarn.storage import scope, stored

    there = lambda df: len(df.inputFiles()) and all(__import__("os").path.exists(f.removeprefix("file://")) for f in df.inputFiles())
    before = stored(spark.range(3), "kept")
    with scope(spark):
        outer = stored(spark.range(4), "outer")
        with pytest.raises(ZeroDivisionError), scope(spark):
            inner = stored(spark.range(5), "inner")
            assert inner.count() == 5 and there(inner)
            raise ZeroDivisionError
        assert not there(inner) and there(outer) and outer.count() == 4
    assert not there(outer) and there(before) and before.count() == 3
    after = stored(spark.range(6), "kept")
    assert there(after)
