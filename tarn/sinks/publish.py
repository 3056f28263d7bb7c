"""Publishing: nested linked data of sites and datasets, and findings about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import canonical_url, identity_iri, text_is_safe, url_is_safe
from tarn.operators.lookup import joinable
from tarn.sources.jsonld import documents, node_rows
from tarn.sources.linked_data import datasets_of_nodes, sites_of_nodes
from tarn.storage import stored

CONTEXT = {"@vocab": "https://schema.org/", "gsp": "http://www.opengis.net/ont/geosparql#"}


def nested_profiles(sites: DataFrame, datasets: DataFrame) -> DataFrame:
    """(site_uri, body): each site with its datasets, each of these with its distributions and variables, as compact JSON-LD.

    A site's datasets travel as one value, as the document needs them: a site's document has to fit one (2 GB). What goes
    into it is made distinct in the tasks first. Arrays are in order of their URIs.
    """
    distributions = F.array_sort(F.collect_set(F.when(F.col("distribution_url").isNotNull(), F.struct(F.col("distribution_url").alias("contentUrl"), F.col("media_type").alias("encodingFormat")))))
    variables = F.array_sort(F.collect_set(F.when(F.col("variable_uri").isNotNull() | F.col("variable_name").isNotNull(), F.struct(F.col("variable_uri").alias("@id"), F.col("variable_name").alias("name"), F.col("unit_uri").alias("unitCode"), F.col("unit_label").alias("unitText")))))
    one = datasets.groupBy("site_uri", "dataset_uri").agg(F.min("dataset_name").alias("name"), F.min("temporal_coverage").alias("coverage"), distributions.alias("distribution"), variables.alias("variables"))
    node = F.struct(F.col("dataset_uri").alias("@id"), F.lit("Dataset").alias("@type"), F.col("name"), F.col("coverage").alias("temporalCoverage"), "distribution", F.col("variables").alias("variableMeasured"))
    by_site = one.groupBy("site_uri").agg(F.array_sort(F.collect_list(node)).alias("subjectOf"))
    joined = sites.join(joinable(by_site), "site_uri", "left")
    context = F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()])
    body = F.struct(context.alias("@context"), F.col("site_uri").alias("@id"), F.lit("Place").alias("@type"), F.col("name"), F.struct(F.col("geometry").alias("asWKT")).alias("hasGeometry"), "subjectOf")
    return joined.select("site_uri", F.to_json(body).alias("body"))


#: Rule, severity, pointer, when it is broken, message, fix.
RULES = (
    ("site-uri", "error", "/@id", lambda: identity_iri(F.col("site_uri")).isNull(), "A site needs a proper URI.", "Give the site an absolute URI."),
    ("site-name", "warning", "/name", lambda: ~text_is_safe(F.col("site_name"), 1000), "A site needs a plain name.", "Name the site without control characters."),
    ("dataset-uri", "error", "/subjectOf/@id", lambda: identity_iri(F.col("dataset_uri")).isNull(), "A dataset needs a proper URI.", "Give the dataset an absolute URI."),
    ("distribution-url", "error", "/subjectOf/distribution/contentUrl", lambda: F.col("distribution_url").isNotNull() & ~url_is_safe(F.col("distribution_url")), "A distribution's URL can't be requested.", "Use a public HTTP(S) URL."),
    ("variable-unit", "info", "/subjectOf/variableMeasured/unitCode", lambda: F.col("variable_name").isNotNull() & F.col("unit_uri").isNull(), "A variable has no unit URI.", "Add the unit's URI."),
)
_SEVERITY = ("error", "warning", "info")


def findings(rows: DataFrame) -> DataFrame:
    """Findings of all rules, each once: errors, then warnings, then notes; by pointer and rule. rows: sites joined with datasets.

    All rules are judged in one pass over the rows.
    """
    items = [F.when(broken(), F.struct(*[F.lit(v).alias(k) for k, v in (("severity", s), ("json_pointer", p), ("rule_id", r), ("message", m), ("fix", f))])) for r, s, p, broken, m, f in RULES]
    found = rows.select("site_uri", F.explode(F.array_compact(F.array(*items))).alias("f")).select("site_uri", "f.*").distinct()
    return found.orderBy(_place(F.col("severity")), "json_pointer", "rule_id", "site_uri")


def _place(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _SEVERITY)), severity)


def is_valid(found: DataFrame) -> bool:
    """Whether no finding is an error."""
    return found.where("severity = 'error'").isEmpty()


#: Location types that may be texts; rule ids and severities of what a document may break, as are the pointers below.
LOCATION_TYPES = ("hydrometricStation", "Unknown")
SEVERITIES = {
    "document.parse": "error",
    "document.jsonld": "error",
    "profile.version": "error",
    "profile.identifier": "error",
    "site.required": "error",
    "site.identifier": "error",
    "site.location_type_missing": "warning",
    "site.location_type": "error",
    "site.provider": "error",
    "site.provider_name": "error",
    "site.provider_url": "error",
    "site.name": "warning",
    "site.geometry": "error",
    "dataset.distribution": "warning",
    "dataset.variable": "warning",
}
#: What each rule found, and what to do.
ADVICE = {
    "document.parse": ("Nothing could be read: this is no JSON-LD.", "Check the text with a JSON parser."),
    "document.jsonld": ("This is JSON, but one node is described in more pieces than are put together, so none of it was read.", "Describe each node in one place."),
    "profile.version": ("Readers can't tell which version of the profile applies.", "Give profileVersion the value asked for."),
    "profile.identifier": ("Readers can't tell that the profile applies.", "Let profile name the profile asked for."),
    "site.required": ("There is no site to publish.", "Describe a site, with type, @id and position."),
    "site.identifier": ("A site can't be referred to.", "Let its @id be an IRI in normal form."),
    "site.location_type_missing": ("What kind of place a site is remains open.", "Say so by HY_HydroLocationType."),
    "site.location_type": ("A site is of a kind that nobody knows.", "Take a kind's IRI, or one of the two texts that are allowed."),
    "site.provider": ("Nobody answers for a site.", "Name who provides it, by @id or URL."),
    "site.provider_name": ("A provider is known by its address alone.", "Give its name too."),
    "site.provider_url": ("A provider can't be visited.", "Give its web address in normal form."),
    "site.name": ("People can't tell a site by its address.", "Give it a name."),
    "site.geometry": ("A site's position can't be drawn as a point.", "Write it as POINT (longitude latitude)."),
    "dataset.distribution": ("There is nothing to download of a dataset.", "Give a distribution's contentUrl."),
    "dataset.variable": ("Two datasets of one variable can't be matched.", "Give the variable an IRI, or a name and a provider."),
}


def _found(rule: str, pointer: Column, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(rule).alias("rule_id"), pointer.alias("json_pointer")))


def document_findings(profiles: DataFrame, version: str, profile: str) -> DataFrame:
    """Findings about whole documents (profile_uri, body), each once: errors, warnings, notes; by pointer and rule.

    profile_uri, severity, json_pointer, rule_id, profile_version, message, suggested_fix. Pointers count a document's sites
    and dataset rows from 0. Of a document that is none, or without a site, only that is said; a document is valid if no
    finding is an error. What parsing found odd is a warning, as rule ``parser`` with its code.
    """
    read = stored(documents(profiles).drop("body", "nodes"), "documents")
    nodes = node_rows(read)
    sites = stored(sites_of_nodes(nodes), "sites")
    with_sites = stored(sites.select("profile_uri").distinct(), "with_sites").hint("merge")
    datasets_ = datasets_of_nodes(nodes).join(with_sites, "profile_uri", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("profile_uri").orderBy("dataset_uri", "dataset_name", "distribution_url", "variable_uri", "variable_name")) - 1)
    is_json, in_bounds = ~F.array_contains("codes", "document_parse"), ~F.array_contains("codes", "fragment_budget")
    parsed = is_json & in_bounds
    whole = read.drop("parts").join(with_sites.withColumn("sites", F.lit(True)), "profile_uri", "left")
    top = F.array_compact(
        F.array(
            _found("document.parse", F.lit(""), ~is_json),
            _found("document.jsonld", F.lit(""), ~in_bounds),
            _found("profile.version", F.lit("/profileVersion"), parsed & ~F.col("version").eqNullSafe(F.lit(version))),
            _found("profile.identifier", F.lit("/profile"), parsed & ~F.col("profile").eqNullSafe(F.lit(profile))),
            _found("site.required", F.lit("/@graph"), parsed & F.col("sites").isNull()),
        )
    )
    odd = F.transform(F.filter("codes", lambda c: ~c.isin("document_parse", "fragment_budget")), lambda c: F.struct(F.concat(F.lit("parser."), c).alias("rule_id"), F.lit("").alias("json_pointer")))
    at = lambda rest: F.concat(F.lit("/@graph/"), F.col("place").cast("string"), F.lit(rest))
    kind = F.col("location_type")
    is_iri = F.coalesce(identity_iri(kind) == kind, F.lit(False))
    of_site = F.array_compact(
        F.array(
            _found("site.identifier", at("/@id"), ~F.coalesce(identity_iri(F.col("site_uri")) == F.col("site_uri"), F.lit(False))),
            _found("site.location_type_missing", at("/@type"), kind.isNull()),
            _found("site.location_type", at("/hyf:HY_HydroLocationType"), kind.isNotNull() & ~is_iri & ~kind.isin(*LOCATION_TYPES)),
            _found("site.provider", at("/schema:provider"), F.col("provider_uri").isNull()),
            _found("site.provider_name", at("/schema:provider/schema:name"), F.col("provider_name").isNull()),
            _found("site.provider_url", at("/schema:provider/schema:url"), canonical_url(F.col("provider_url")).isNull()),
            _found("site.name", at("/schema:name"), F.col("name").isNull()),
            _found("site.geometry", at("/geo:hasGeometry/geo:asWKT"), F.col("wkt").isNotNull() & ~F.col("wkt").rlike(r"^\s*POINT\s*\(\s*[-+.0-9eE]+\s+[-+.0-9eE]+\s*\)\s*$")),
        )
    )
    row = lambda rest: F.concat(F.lit("/dataset/"), F.col("place").cast("string"), F.lit(rest))
    of_dataset = F.array_compact(F.array(_found("dataset.distribution", row("/schema:distribution"), F.col("distribution_url").isNull()), _found("dataset.variable", row("/schema:variableMeasured"), F.col("variable_id").isNull())))
    parts = [whole.select("profile_uri", F.explode(F.concat(top, odd)).alias("f")), sites.select("profile_uri", F.explode(of_site).alias("f")), datasets_.select("profile_uri", F.explode(of_dataset).alias("f"))]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("profile_uri", "f.*").distinct()
    said = lambda known, other: F.coalesce(F.create_map(*[F.lit(x) for item in known.items() for x in item])[F.col("rule_id")], F.lit(other))
    message, fix = ({rule: parts[i] for rule, parts in ADVICE.items()} for i in (0, 1))
    out = all_.select("profile_uri", said(SEVERITIES, "warning").alias("severity"), "json_pointer", "rule_id", F.lit(version).alias("profile_version"), said(message, "The document holds something unusual.").alias("message"), said(fix, "See the code behind the rule's name.").alias("suggested_fix"))
    return out.orderBy(_place(F.col("severity")), "json_pointer", "rule_id", "profile_uri")
