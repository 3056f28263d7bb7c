import json

from pyspark.sql import functions as F

from tarn.sinks import publish
from tarn.sources import jsonld, linked_data

SITE = {"@id": "https://e.org/s", "@type": ["hyf:HY_HydrometricFeature"], "schema:name": "One", "gsp:hasGeometry": {"gsp:asWKT": {"@value": "POINT (1 2)", "@type": "gsp:wktLiteral"}}}
DATASET = {"@type": "schema:Dataset", "schema:name": "Flow", "schema:distribution": {"schema:contentUrl": "https://e.org/a.csv", "schema:encodingFormat": "text/csv"}, "schema:variableMeasured": {"@id": "https://e.org/v", "schema:name": "flow"}}
DECLARED = {"schema": "https://schema.org/", "hyf": "https://www.opengis.net/def/schema/hy_features/hyf/", "gsp": "http://www.opengis.net/ont/geosparql#"}


def expanded(value):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            prefix, _, rest = k.partition(":")
            out[DECLARED[prefix] + rest if rest and prefix in DECLARED else k] = v if k.startswith("@") else [expanded(v) if isinstance(v, dict) else {"@value": v}]
        return out
    return value


SHAPES = {
    "nested": {"@context": DECLARED, **SITE, "schema:subjectOf": DATASET},
    "undeclared": {**SITE, "schema:subjectOf": [DATASET]},
    "graph": {"@context": DECLARED, "@graph": [{**SITE, "schema:subjectOf": {"@id": "https://e.org/d"}}, {"@id": "https://e.org/d", **DATASET}]},
    "about": {"@context": DECLARED, "@graph": [SITE, {"@id": "https://e.org/d", **DATASET, "schema:about": {"@id": "https://e.org/s"}}]},
    "fragments": {"@context": DECLARED, "@graph": [{**SITE, "schema:subjectOf": {"@id": "https://e.org/d"}}, {"@id": "https://e.org/d", "@type": "schema:Dataset", "schema:name": "Flow"}, {"@id": "https://e.org/d", **{k: v for k, v in DATASET.items() if k not in ("@type", "schema:name")}}]},
    "expanded": [expanded({**SITE, "schema:subjectOf": DATASET})],
    "terms": {"@context": ["https://schema.org/", {"label": "schema:name", "schema": "https://schema.org/", "hyf": DECLARED["hyf"], "gsp": DECLARED["gsp"]}], "label": "One", **{k: v for k, v in SITE.items() if k != "schema:name"}, "subjectOf": DATASET},
}


def test_every_shape_gives_the_same_rows(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in SHAPES.items()], "profile_uri string, body string")
    sites = {r["source_url"]: (r["site_uri"], r["name"], r["geometry"]) for r in linked_data.locations(df).collect()}
    assert sites == {k: ("https://e.org/s", "One", "POINT (1 2)") for k in SHAPES}
    found = {r["profile_uri"]: (r["site_uri"], r["dataset_name"], r["distribution_url"], r["media_type"], r["variable_uri"], r["variable_name"]) for r in linked_data.datasets(df).collect()}
    assert found == {k: ("https://e.org/s", "Flow", "https://e.org/a.csv", "text/csv", "https://e.org/v", "flow") for k in SHAPES}
    codes = {r["profile_uri"]: r["codes"] for r in jsonld.documents(df).collect()}
    assert codes["undeclared"] == ["known_prefix_repaired"] and codes["nested"] == []


def entries(node, name):
    return [e["v"] if e["r"] is None else (e["r"],) for e in node["properties"][name]]


def plain(text, *names):
    """Top nodes: id, types and what is asked for; and the codes."""
    nodes, codes = jsonld.nodes_of(text if isinstance(text, str) else json.dumps(text))
    return [(n["id"], n["types"], *(entries(n, x) if x in n["properties"] else None for x in names)) for n in nodes if n["place"] is not None], codes


def test_odd_documents():
    for bad in (None, "", "{", "3", '"x"', "[" * 100_000):
        assert jsonld.nodes_of(bad) == ([], ["document_parse"])
    assert jsonld.nodes_of("[]") == ([], []) and plain("{}") == ([("_:#0", [])], [])
    many = json.dumps([{"@id": "a", "n": i} for i in range(jsonld.FRAGMENTS + 1)])
    assert jsonld.nodes_of(many) == ([], ["fragment_budget"])
    circle = {"@graph": [{"@id": "a", "p": {"@id": "b"}, "n": 1}, {"@id": "b", "p": {"@id": "a"}, "n": 2}]}
    assert plain(circle, "p", "n") == ([("a", [], [("b",)], ["1"]), ("b", [], [("a",)], ["2"])], [])
    spoken = {"@context": "https://x.org/c", "schema:name": [{"@value": "eins", "@language": "de"}, {"@value": "one", "@language": "en"}], "http://schema.org/description": "d"}
    assert plain(spoken, "name", "description") == ([("_:#0", [], ["one", "eins"], ["d"])], ["remote_context_ignored", "known_prefix_repaired"])


def test_output_is_linear_in_the_input(spark):
    """Eight nodes that all name each other stay eight; a chain of references keeps its end."""
    mesh = json.dumps({"@graph": [{"@id": f"n{i}", "p": [{"@id": f"n{j}"} for j in range(8) if j != i]} for i in range(8)]})
    nodes, codes = jsonld.nodes_of(mesh)
    assert len(nodes) == 8 and codes == [] and len(json.dumps(nodes)) < 4000
    chain = {"@id": "c12", "schema:name": "end"}
    for i in range(11, -1, -1):
        chain = {"@id": f"c{i}", "schema:isPartOf": chain}
    df = spark.createDataFrame([("mesh", mesh), ("chain", json.dumps(chain)), ("none", "<")], "profile_uri string, body string")
    table = jsonld.node_table(df)
    found = {(r["profile_uri"], r["start"], r["node"]): r["steps"] for r in jsonld.reached(table, table.where("node in ('c0', 'n3')")).collect()}
    assert found == {**{("chain", "c0", f"c{i}"): i for i in range(13)}, **{("mesh", "n3", f"n{i}"): int(i != 3) for i in range(8)}}
    last = jsonld.followed(spark.createDataFrame([("chain", "c12"), ("chain", "x"), ("none", "c12")], "profile_uri string, ref string"), "ref", table, "at").collect()
    assert sorted((r["profile_uri"], r["ref"], r["at"] and r["at"]["properties"]["name"][0]["v"]) for r in last) == [("chain", "c12", "end"), ("chain", "x", None), ("none", "c12", None)]
    rows = {(r["node"], r["property"], r["nth"], r["value"], r["reference"]) for r in jsonld.statements(table).where("profile_uri = 'chain'").collect()}
    assert ("c12", "name", 0, "end", None) in rows and ("c11", "isPartOf", 0, None, "c12") in rows and len(rows) == 13


def test_terms_and_containers():
    context = {
        "id": "@id", "type": "@type", "ex": "https://e.org/", "@base": "https://b.org/x/", "knows": {"@id": "ex:knows", "@type": "@id"}, "kind": {"@id": "ex:kind", "@type": "@vocab"}, "label": {"@id": "schema:name", "@container": "@language"},
        "partOf": {"@reverse": "ex:has"}, "gone": None, "steps": {"@id": "ex:steps", "@container": "@list"}, "byId": {"@id": "ex:byId", "@container": "@id"}, "byType": {"@id": "ex:byType", "@container": "@type"}, "byKey": {"@id": "ex:byKey", "@container": "@index"},
        "inner": {"@id": "ex:inner", "@context": {"v": "ex:innerV"}}, "Special": {"@id": "ex:Special", "@context": {"v": "ex:specialV"}}, "v": "ex:v",
    }
    body = {
        "@context": context, "id": "a", "type": "ex:T", "knows": ["b", "../c", "ex:d"], "kind": "v", "label": {"de": "eins", "en": "one"}, "partOf": {"id": "w"}, "gone": 1, "steps": {"@list": [1, 2, True]},
        "byId": {"k1": {"v": 1}, "k2": {"v": 2}}, "byType": {"Special": {"id": "t", "v": 3}}, "byKey": {"x": 5, "y": [6, 7]}, "inner": {"id": "i", "v": 4}, "@reverse": {"ex:made": {"id": "m"}}, "@included": [{"id": "inc", "v": 8}],
    }
    nodes, codes = jsonld.nodes_of(json.dumps(body))
    by = {n["id"]: n for n in nodes}
    at, e = "https://b.org/x/", "https://e.org/"
    a = by[at + "a"]
    assert a["types"] == [e + "T"] and entries(a, e + "knows") == [(at + "b",), ("https://b.org/c",), (e + "d",)] and entries(a, e + "kind") == [(e + "v",)] and entries(a, "name") == ["one", "eins"]
    assert entries(by[at + "w"], e + "has") == [(at + "a",)] and entries(by[at + "m"], e + "made") == [(at + "a",)] and "gone" not in a["properties"] and entries(a, e + "steps") == ["1", "2", "true"]
    assert entries(a, e + "byId") == [(at + "k1",), (at + "k2",)] and entries(by[at + "k2"], e + "v") == ["2"] and by[at + "t"]["types"] == [e + "Special"] and entries(by[at + "t"], e + "specialV") == ["3"]
    assert entries(a, e + "byKey") == ["5", "6", "7"] and entries(by[at + "i"], e + "innerV") == ["4"] and entries(by[at + "inc"], e + "v") == ["8"] and codes == ["known_prefix_repaired"]


def test_scopes_end_where_their_objects_end():
    body = {"@context": {"n": "https://e.org/outer"}, "n": 1, "https://e.org/p": [{"@context": {"n": "https://e.org/inner"}, "n": 2}, {"@context": None, "n": 3}, {"n": 4}]}
    nodes = jsonld.nodes_of(json.dumps(body))[0]
    assert [{k: entries(n, k) for k in n["properties"] if k != "https://e.org/p"} for n in nodes] == [{"https://e.org/outer": ["1"]}, {"https://e.org/inner": ["2"]}, {"n": ["3"]}, {"https://e.org/outer": ["4"]}]
    round_about = {"@context": {"a": "b", "b": "a", "c": "c:c"}, "a": 1, "c": 2}
    assert len(jsonld.nodes_of(json.dumps(round_about))[0]) == 1


def test_profile_files(spark, tmp_path):
    (tmp_path / "a.jsonld").write_text("﻿" + json.dumps(SHAPES["nested"], indent=1))
    (tmp_path / "b.jsonld").write_text(json.dumps(SHAPES["graph"]))
    read = jsonld.read_profiles(spark, str(tmp_path))
    assert read.count() == 2 and linked_data.locations(read).select("name").distinct().collect()[0]["name"] == "One"
    assert {r["u"] for r in read.select(F.regexp_extract("profile_uri", "[^/]+$", 0).alias("u")).collect()} == {"a.jsonld", "b.jsonld"}


def test_only_what_is_no_json_is_no_document(spark):
    """Odd contexts, depth and long numbers don't cost a document its nodes, and what can't be read is no parse error."""
    ex = lambda **said: {"@context": {"a": {"@id": "https://e.org/a", **said}}, "a": {"x": 1}}
    assert plain({"@context": {"@base": "http://[x"}, "@id": "a", "n": 1}, "n") == ([("a", [], ["1"])], ["address_invalid"])
    assert plain({"@context": {"@base": "https://e.org/"}, "@id": "//[x", "n": 1}, "n") == ([("//[x", [], ["1"])], ["address_invalid"])
    for odd in (5, [{}], [["@list"]]):
        nodes, codes = jsonld.nodes_of(json.dumps(ex(**{"@container": odd})))
        assert len(nodes) == 2 and codes == ["container_invalid"]
    assert plain('{"n": ' + "7" * 5000 + "}", "n") == ([("_:#0", [], ["7" * 5000])], [])
    terms = {f"t{i}": f"t{i + 1}" for i in range(40)}
    assert plain({"@context": {**terms, "t40": "https://e.org/x"}, "t0": 1}, "https://e.org/x") == ([("_:#0", [], ["1"])], [])
    for depth in (500, 5_000, 30_000):
        nodes, codes = jsonld.nodes_of("".join(f'{{"@id": "n{i}", "p": ' for i in range(depth)) + "[" * depth + '"end]"' + "]" * depth + "}" * depth)
        assert len(nodes) == depth and codes == [] and entries(next(n for n in nodes if n["id"] == f"n{depth - 1}"), "p") == ["end]"]
    for bad in ("[" * 30_000 + "]" * 29_999, "[" * 30_000 + "}" * 30_000, "[" * 30_000 + "x" + "]" * 30_000):
        assert jsonld.nodes_of(bad) == ([], ["document_parse"])
    many = json.dumps([{"@id": "a", "n": i} for i in range(jsonld.FRAGMENTS + 1)])
    rows = spark.createDataFrame([("many", many), ("none", "<"), ("base", json.dumps({"@context": {"@base": "http://[x"}, "@graph": [SITE, {"@id": "x", "n": 1}]})), ("half", '{"@id": "\\ud800", "n": 1}')], "profile_uri string, body string")
    found = {}
    for r in publish.document_findings(rows, "1", "p").collect():
        found.setdefault(r["profile_uri"], set()).add((r["rule_id"], r["severity"]))
    assert found["many"] == {("document.jsonld", "error")} and found["none"] == {("document.parse", "error")}
    assert ("parser.address_invalid", "warning") in found["base"] and not {r for r, _ in found["base"]} & {"document.parse", "site.required"}
    assert [r["nodes"] for r in jsonld.documents(rows).where("profile_uri = 'half'").collect()] == [["?"]]
