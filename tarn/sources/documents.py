"""JSON documents of services to tables: coverages, daily and continuous values, features, query results.

A document is one row (its id and body). Bodies are parsed by ``from_json`` under the schema that is expected, checked by
expressions, and exploded; a document that fails a check gives no rows, and its reason from the ``*_problems`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.temporal import rfc3339_utc, strict_date

_COVERAGE = """type string, id string, parameters map<string, struct<observedProperty: struct<label: string>, unit: struct<symbol: string, label: string>>>,
ranges map<string, struct<type: string, dataType: string, axisNames: array<string>, shape: array<double>, `values`: array<double>>>,
domain struct<type: string, domainType: string, axes: struct<x: struct<`values`: array<double>>, y: struct<`values`: array<double>>, t: struct<`values`: array<string>>>>"""


def _localized(text: Column) -> Column:
    """A label that is a text or an object by language: English first, else the only one."""
    return F.when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.en"), F.map_values(F.from_json(text, "map<string,string>"))[0])).otherwise(text)


def _coverages(docs: DataFrame) -> DataFrame:
    """docs: doc_id, body, parameter, lon, lat. Adds the parsed document, its one range and its problem."""
    parsed = docs.withColumn("d", F.from_json("body", _COVERAGE))
    parsed = parsed.withColumn("r", F.col("d.ranges")[F.col("parameter")]).withColumn("times", F.col("d.domain.axes.t.values"))
    axes = F.col("d.domain.axes")
    n = F.size("times")
    shape, names = F.col("r.shape"), F.col("r.axisNames")
    flat = (names == F.array(F.lit("t"))) & (shape == F.array(n.cast("double")))
    full = (names == F.array(*map(F.lit, "tyx"))) & (shape == F.array(n.cast("double"), F.lit(1.0), F.lit(1.0)))
    whole = (F.col("r.dataType") == "float") | ((F.col("r.dataType") == "integer") & F.forall("r.values", lambda v: v.isNull() | (v == F.floor(v))))
    here = (axes["x"]["values"] == F.array("lon")) & (axes["y"]["values"] == F.array("lat"))
    only = lambda m: F.map_keys(F.col(m)) == F.array("parameter")
    no = lambda test: ~F.coalesce(test, F.lit(False))
    problem = (
        F.when(no(F.col("d.type") == "Coverage"), F.lit("not_a_coverage"))
        .when(no(only("d.parameters") & only("d.ranges")), F.lit("parameter"))
        .when(no((F.col("d.domain.type") == "Domain") & (F.col("d.domain.domainType") == "PointSeries")), F.lit("domain"))
        .when(no(here), F.lit("position"))
        .when(no((n > 0) & F.forall("times", lambda x: rfc3339_utc(x).isNotNull())), F.lit("time_axis"))
        .when(no((F.col("r.type") == "NdArray") & (flat | full) & (F.size("r.values") == n) & whole), F.lit("range"))
    )
    return parsed.withColumn("problem", problem)


def coverage_series(docs: DataFrame) -> DataFrame:
    """Point series of coverages: doc_id and the nine columns of the native table. A null in the range is a missing value."""
    fine = _coverages(docs).where("problem IS NULL")
    meta = F.col("d.parameters")[F.col("parameter")]
    rows = fine.select("doc_id", F.coalesce("d.id", F.lit("1")).alias("coverage_id"), "parameter", F.coalesce(_localized(meta["observedProperty"]["label"]), F.col("parameter")).alias("parameter_label"), _localized(F.coalesce(meta["unit"]["symbol"], meta["unit"]["label"])).alias("unit"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(F.arrays_zip(F.col("times").alias("t"), F.col("r.values").alias("v"))).alias("p"))
    return rows.select("doc_id", "coverage_id", "parameter", "parameter_label", "unit", rfc3339_utc(F.col("p.t")).alias("datetime"), "x", "y", F.lit(None).cast("double").alias("z"), F.col("p.v").alias("value"))


def coverage_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, problem and rows of each coverage."""
    return _coverages(docs).select("doc_id", "problem", F.when(F.col("problem").isNull(), F.size("times")).alias("rows"))


def coverage_problems(docs: DataFrame) -> DataFrame:
    return _coverages(docs).where("problem IS NOT NULL").select("doc_id", "problem")


PROPERTIES = ("time_series_id", "monitoring_location_id", "parameter_code", "statistic_id", "time", "value", "unit_of_measure", "approval_status", "qualifier", "last_modified")
_PAGE = "type string, numberReturned long, numberMatched long, features array<struct<type: string, id: string, geometry: string, properties: string>>, links array<struct<rel: string, href: string>>"


def _stop_reason(limit: Column) -> Column:
    """Why a page is not, or may not be, everything."""
    more = F.exists("d.links", lambda link: link["rel"] == "next")
    matched, returned = F.col("d.numberMatched"), F.col("d.numberReturned")
    return F.when(more, F.lit("next_link_not_followed")).when(matched > returned, F.lit("number_matched_exceeds_page")).when(returned == limit, F.lit("page_limit_reached")).otherwise(F.lit("complete_single_page"))


def _value_pages(docs: DataFrame, kind: str) -> DataFrame:
    """docs: doc_id, body, site, parameter_code, statistic_id, time_start, time_end, page_limit."""
    parsed = docs.withColumn("d", F.from_json("body", _PAGE))
    at = strict_date if kind == "daily" else rfc3339_utc
    own = ", ".join(f"{p} string" for p in PROPERTIES)
    exact = F.array_sort(F.array(*map(F.lit, PROPERTIES)))
    # The page's own columns meet each feature inside the array, so nothing is joined or shuffled.
    features = F.transform(
        "d.features",
        lambda f: F.struct(
            f["id"].alias("own_id"), F.from_json(f["properties"], own).alias("p"),
            ((f["type"] == "Feature") & (F.coalesce(f["id"], F.lit("")) != "") & f["geometry"].isNull() & (F.array_sort(F.json_object_keys(f["properties"])) == exact)).alias("shaped"),
        ),
    )
    parsed = parsed.withColumn("f", features)
    good = F.forall("f", lambda x: F.coalesce(x["shaped"], F.lit(False)))
    planned = F.forall("f", lambda x: F.coalesce((x["p"]["monitoring_location_id"] == F.col("site")) & (x["p"]["parameter_code"] == F.col("parameter_code")) & (x["p"]["statistic_id"] == F.col("statistic_id")), F.lit(False)))
    inside = F.forall("f", lambda x: F.coalesce(at(x["p"]["time"]).between(at(F.col("time_start")), at(F.col("time_end"))) & rfc3339_utc(x["p"]["last_modified"]).isNotNull(), F.lit(False)))
    no = lambda test: ~F.coalesce(test, F.lit(False))
    problem = (
        F.when(no(F.col("d.type") == "FeatureCollection") | F.col("d.features").isNull() | F.col("d.links").isNull(), F.lit("not_a_page"))
        .when(no(good), F.lit("feature_shape"))
        .when(no(planned), F.lit("not_as_planned"))
        .when(no(inside), F.lit("time_window"))
        .when(no((F.col("d.numberReturned") == F.size("d.features")) & (F.coalesce("d.numberMatched", "d.numberReturned") >= F.col("d.numberReturned"))), F.lit("page_counts"))
    )
    return parsed.withColumn("problem", problem)


def value_rows(docs: DataFrame, kind: str = "daily") -> DataFrame:
    """doc_id and the eleven native columns of daily or continuous values."""
    if kind not in ("daily", "continuous"):
        raise ValueError("kind is daily or continuous")
    # Pages with a problem explode to nothing. A filter on it would be pushed below, where all features are parsed again.
    rows = _value_pages(docs, kind).select("doc_id", F.explode(F.when(F.col("problem").isNull(), F.col("f"))).alias("v"))
    when = strict_date(F.col("v.p.time")) if kind == "daily" else rfc3339_utc(F.col("v.p.time"))
    return rows.select("doc_id", F.col("v.own_id").alias(f"{kind}_id"), *[F.col(f"v.p.{p}").alias(p) for p in PROPERTIES[:4]], when.alias("time"), *[F.col(f"v.p.{p}").alias(p) for p in PROPERTIES[5:9]], rfc3339_utc(F.col("v.p.last_modified")).alias("last_modified"))


def page_status(docs: DataFrame, kind: str = "daily") -> DataFrame:
    """doc_id, problem, rows, stop_reason and truncated of each page."""
    reason = F.when(F.col("problem").isNull(), _stop_reason(F.col("page_limit")))
    return _value_pages(docs, kind).select("doc_id", "problem", F.when(F.col("problem").isNull(), F.size("d.features")).alias("rows"), reason.alias("stop_reason"), (reason != "complete_single_page").alias("truncated"))


def _feature_pages(docs: DataFrame, limit: int) -> DataFrame:
    """docs: doc_id, body. Adds the parsed page and its problem."""
    parsed = docs.withColumn("d", F.from_json("body", _PAGE))
    n = F.size("d.features")
    no = lambda test: ~F.coalesce(test, F.lit(False))
    problem = (
        F.when(no(F.col("d.type") == "FeatureCollection") | F.col("d.features").isNull(), F.lit("not_a_page"))
        .when(no(F.forall("d.features", lambda f: F.coalesce(f["type"] == "Feature", F.lit(False)))), F.lit("feature_shape"))
        .when(n > limit, F.lit("payload_limit"))
        .when(F.coalesce(F.col("d.numberReturned") != n, F.lit(False)), F.lit("payload_count"))
    )
    return parsed.withColumn("problem", problem)


def feature_page_status(docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """doc_id, problem, rows, stop_reason and truncated of each page of features (doc_id, body); ``limit`` was asked for.

    stop_reason: single_page_budget (there is a next page), missing_next_link (more match than came, and no link), limit (as
    many came as were asked for), no_next (all came); null where the page has a problem.
    """
    n = F.size("d.features")
    more = F.exists("d.links", lambda link: (link["rel"] == "next") & (F.coalesce(link["href"], F.lit("")) != ""))
    reason = (
        F.when(F.col("problem").isNotNull(), F.lit(None).cast("string"))
        .when(F.coalesce(more, F.lit(False)), F.lit("single_page_budget"))
        .when(F.coalesce(F.col("d.numberMatched") > n, F.lit(False)), F.lit("missing_next_link"))
        .when(n == limit, F.lit("limit"))
        .otherwise(F.lit("no_next"))
    )
    return _feature_pages(docs, limit).select("doc_id", "problem", F.when(F.col("problem").isNull(), n).alias("rows"), reason.alias("stop_reason"), (reason != "no_next").alias("truncated"))


def feature_rows(docs: DataFrame, properties: dict[str, str], limit: int = 10_000) -> DataFrame:
    """Features of pages (doc_id, body) without a problem: feature_id, geometry as JSON, and properties typed as given; identifiers are given as string.

    Pages with a problem give no rows: ``feature_page_status`` names them.
    """
    rows = _feature_pages(docs, limit).select("doc_id", F.explode(F.when(F.col("problem").isNull(), F.col("d.features"))).alias("f"))
    typed = [F.get_json_object("f.properties", f"$.{name}").try_cast(kind).alias(name) for name, kind in properties.items()]
    return rows.select("doc_id", F.col("f.id").alias("feature_id"), F.col("f.geometry").alias("geometry"), *typed)


def feature_properties(docs: DataFrame, limit: int = 10_000) -> DataFrame:
    """doc_id, place (from 1) and properties (JSON text) of the features of pages without a problem."""
    rows = _feature_pages(docs, limit).select("doc_id", F.posexplode(F.when(F.col("problem").isNull(), F.col("d.features"))).alias("place", "f"))
    return rows.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.col("f.properties").alias("properties"))


def queryables(docs: DataFrame) -> DataFrame:
    """What a collection's features may be filtered by (collection, body: a JSON Schema): collection, property, type, format, role, problem.

    A property may have several types, and then has none here. A body without properties has one row, with a problem.
    """
    schema = "type string, properties map<string, struct<type: string, format: string, title: string, `x-ogc-role`: string>>"
    parsed = docs.select("collection", F.from_json("body", schema).alias("d")).withColumn("fine", F.coalesce((F.col("d.type") == "object") & F.col("d.properties").isNotNull(), F.lit(False)))
    rows = parsed.select("collection", "fine", F.explode_outer(F.when(F.col("fine"), F.map_entries("d.properties"))).alias("p"))
    kind = F.when(~F.col("p.value.type").startswith("["), F.col("p.value.type"))
    return rows.select("collection", F.col("p.key").alias("property"), kind.alias("type"), F.col("p.value.format").alias("format"), F.col("p.value.`x-ogc-role`").alias("role"), F.when(~F.col("fine"), F.lit("not_queryables")).alias("problem"))


_RESULTS = "head struct<vars: array<string>>, boolean boolean, results struct<bindings: array<map<string, struct<type: string, value: string, datatype: string, `xml:lang`: string>>>>"
TERMS = ("uri", "literal", "typed-literal", "bnode")


def select_bindings(docs: DataFrame) -> DataFrame:
    """Bindings of SELECT results (doc_id, body) as a long table: row, variable_index, variable, term_type, value, datatype, language, bnode_scope.

    An unbound variable has no row, and a row without bindings none at all: ``result_shape`` has the number of rows.
    """
    parsed = docs.withColumn("d", F.from_json("body", _RESULTS)).where("d.results IS NOT NULL AND d.boolean IS NULL")
    rows = parsed.select("doc_id", F.col("d.head.vars").alias("vars"), F.posexplode("d.results.bindings").alias("row", "terms"))
    terms = rows.select("doc_id", "vars", (F.col("row") + 1).cast("long").alias("row"), F.explode("terms").alias("variable", "term"))
    kind = F.when(F.col("term.type") == "typed-literal", F.lit("literal")).otherwise(F.col("term.type"))
    return terms.select(
        "doc_id", "row", F.array_position("vars", F.col("variable")).cast("int").alias("variable_index"), "variable", kind.alias("term_type"), F.col("term.value").alias("value"),
        F.col("term.datatype").alias("datatype"), F.col("term.`xml:lang`").alias("language"), F.when(kind == "bnode", F.sha2(F.col("doc_id").cast("string"), 256)).alias("bnode_scope"),
    ).where(F.col("variable_index") > 0)


def result_shape(docs: DataFrame) -> DataFrame:
    """For each document: form (select, ask or null), rows, the answer of an ASK, and its problem."""
    d = docs.withColumn("d", F.from_json("body", _RESULTS))
    both = F.col("d.results").isNotNull() & F.col("d.boolean").isNotNull()
    none = F.col("d.results").isNull() & F.col("d.boolean").isNull()
    bindings = F.col("d.results.bindings")
    strange = F.exists(bindings, lambda b: F.exists(F.map_keys(b), lambda k: ~F.array_contains(F.col("d.head.vars"), k)) | F.exists(F.map_values(b), lambda v: ~v["type"].isin(*TERMS)))
    problem = F.when(both | none | F.col("d.head").isNull(), F.lit("result_form")).when(F.coalesce(strange, F.lit(False)), F.lit("terms"))
    form = F.when(F.col("d.results").isNotNull(), F.lit("select")).when(F.col("d.boolean").isNotNull(), F.lit("ask"))
    return d.select("doc_id", F.when(problem.isNull(), form).alias("form"), F.when(problem.isNull(), F.size(bindings)).alias("rows"), F.col("d.boolean").alias("answer"), problem.alias("problem"))


def wide(bindings: DataFrame, variables: list[str]) -> DataFrame:
    """One column for each variable, null where it is unbound."""
    return bindings.groupBy("doc_id", "row").pivot("variable", variables).agg(F.first("value"))
