"""Linked data in web pages and profiles: finding it, and flattening profiles to site and dataset rows.

Profiles are JSON-LD in any form, as a table of nodes (see ``jsonld``). A property is a list of texts and references
there; what it refers to is found by a join on document and node. Unknown properties are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.identity import dataset_id_of, distribution_id, variable_id_of
from tarn.functions.temporal import temporal_interval
from tarn.functions.text import folded_label, identity_iri, media_type
from tarn.operators.grouping import diagnostic, diagnostics
from tarn.operators.predicates import HANDLERS, first_match
from tarn.sources.jsonld import followed, node_table

_SCRIPT = r'(?is)<script[^>]*type\s*=\s*["\']?application/ld\+json["\']?[^>]*>(.*?)</script>'
_LINK = r'(?is)<link\b(?=[^>]*rel\s*=\s*["\']?alternate)(?=[^>]*type\s*=\s*["\']?application/ld\+json)[^>]*href\s*=\s*["\']([^"\']+)'


def retrieved(pages: DataFrame, url: str = "url", html: str = "html", media: str | None = None) -> DataFrame:
    """How each page offers linked data: negotiated (it is JSON-LD), embedded, alternate or none; with documents and target."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1))
    link = F.nullif(F.regexp_extract(F.col(html), _LINK, 1), F.lit(""))
    own = media_type(F.col(media)).isin("application/ld+json", "application/json") if media else F.lit(False)
    mode = F.when(own, F.lit("negotiated")).when(F.size(scripts) > 0, F.lit("embedded")).when(link.isNotNull(), F.lit("alternate")).otherwise(F.lit("none"))
    documents = F.when(mode == "negotiated", F.array(html)).when(mode == "embedded", F.transform(scripts, F.trim)).otherwise(F.array().cast("array<string>"))
    return pages.withColumn("mode", mode).withColumn("documents", documents).withColumn("target", F.when(mode == "alternate", link))


def unprefixed(body: Column) -> Column:
    """Property names without the prefixes and addresses of the vocabularies that profiles use."""
    return F.regexp_replace(body, r'"(?:schema:|https?://schema\.org/|hyf:|gsp:|dc(?:t|terms)?:|skos:)([A-Za-z]+)"\s*:', '"$1":')


def _entry(properties: Column, name: str) -> Column:
    """The first entry of a property; null without one."""
    return F.get(properties[name], F.lit(0))


def _text(properties: Column, name: str) -> Column:
    """A property as a text: what it says or, failing that, what it refers to."""
    entry = _entry(properties, name)
    return F.coalesce(entry["v"], entry["r"])


def _named(node: Column) -> Column:
    """A node's id, if the document names it."""
    return F.when(~node.startswith("_:"), node)


def _iri(properties: Column, name: str) -> Column:
    """A property as an IRI: what it refers to, if that has a name, or its text."""
    entry = _entry(properties, name)
    return F.coalesce(_named(entry["r"]), entry["v"])


def _reference(properties: Column, name: str) -> Column:
    return _entry(properties, name)["r"]


def _provider(entry: Column, node: Column) -> tuple[Column, Column, Column]:
    """URI, name and URL of a provider: a text, or a node (its name and url) with an id or URL."""
    return F.coalesce(_named(entry["r"]), node["url"], entry["v"]), node["name"], node["url"]


def _with_provider(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the node that the entry ``provider`` refers to."""
    p = F.col("properties")
    return followed(rows.withColumn("_provider", F.col("provider.r")), "_provider", nodes, "provider_node", name=_text(p, "name"), url=_text(p, "url"))


def _type(types: Column) -> Column:
    """One type as it is, several as a JSON list, none as nothing."""
    return F.when(F.size(types) == 1, F.get(types, F.lit(0))).when(F.size(types) > 1, F.to_json(types)).otherwise(F.lit(""))


def _sites(nodes: DataFrame, **facts: Column) -> DataFrame:
    """The top nodes that are locations, with ``facts`` of their columns, geometry and provider: one has a geometry or position, or is a place with datasets."""
    p, types = F.col("properties"), _type(F.col("types"))
    place = types.contains("HY_") | p["referencedPosition"].isNotNull() | (types.contains("Place") & p["subjectOf"].isNotNull())
    top = nodes.where("place is not null").select("profile_uri", "node", "place", *[c.alias(name) for name, c in facts.items()], _reference(p, "hasGeometry").alias("_geometry"), _entry(p, "provider").alias("provider"), place.alias("_is_place"))
    found = followed(top, "_geometry", nodes, "geometry", wkt=_text(p, "asWKT")).withColumn("wkt", F.col("geometry.wkt")).where(F.col("_is_place") | F.col("wkt").isNotNull())
    return _with_provider(found.drop("_geometry", "geometry", "_is_place"), nodes)


def site_nodes(profiles: DataFrame) -> DataFrame:
    """What is checked about each site of each document: profile_uri, place (from 0), site_uri, name, location_type, provider and wkt as they are given."""
    return sites_of_nodes(node_table(profiles))


def sites_of_nodes(nodes: DataFrame) -> DataFrame:
    """The same of a table of nodes."""
    p = F.col("properties")
    uri, name, url = _provider(F.col("provider"), F.col("provider_node"))
    found = _sites(nodes, name=_text(p, "name"), location_type=_iri(p, "HY_HydroLocationType")).withColumn("place", F.row_number().over(Window.partitionBy("profile_uri").orderBy("place")) - 1)
    return found.select("profile_uri", "place", _named(F.col("node")).alias("site_uri"), "name", "location_type", uri.alias("provider_uri"), name.alias("provider_name"), url.alias("provider_url"), "wkt")


def locations(profiles: DataFrame) -> DataFrame:
    """One site row for each top node that is a location: it has a geometry or position, or it is a place with datasets."""
    p, nodes = F.col("properties"), node_table(profiles)
    facts = {"name": _text(p, "name"), "description": _text(p, "description"), "site_type": _type(F.col("types")), "landing_url": _text(p, "url"), "_geo": _reference(p, "geo"), "_position": _reference(p, "referencedPosition")}
    found = followed(_sites(nodes, **facts), "_geo", nodes, "geo", latitude=_text(p, "latitude"), longitude=_text(p, "longitude"))
    found = followed(found, "_position", nodes, "position", mainstem=_iri(p, "linearElement"))
    lat, lon = F.col("geo.latitude"), F.col("geo.longitude")
    point = F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")")))
    uri, name, _ = _provider(F.col("provider"), F.col("provider_node"))
    return found.select(
        F.coalesce(_named(F.col("node")), F.col("profile_uri")).alias("site_uri"), "name", "description", "site_type", uri.alias("provider_uri"), name.alias("provider_name"),
        F.col("position.mainstem").alias("mainstem_uri"), "landing_url", F.col("profile_uri").alias("source_url"), F.coalesce("wkt", point).alias("geometry"),
    )


def datasets(profiles: DataFrame) -> DataFrame:
    """A row for each dataset, distribution and variable of each profile; a dataset without one of them has a null in its place."""
    return datasets_of_nodes(node_table(profiles))


def datasets_of_nodes(nodes: DataFrame) -> DataFrame:
    """The same of a table of nodes."""
    p = F.col("properties")
    site = F.coalesce(_named(F.col("node")), F.col("profile_uri"))
    named = nodes.where("place is not null").select("profile_uri", site.alias("site_uri"), _entry(p, "provider").alias("site_provider"), F.explode(p["subjectOf"]).alias("_set")).withColumn("_set", F.col("_set.r"))
    facts = {
        "node": F.col("node"), "name": _text(p, "name"), "description": _text(p, "description"), "coverage": _text(p, "temporalCoverage"), "license": _iri(p, "license"), "provider": _entry(p, "provider"),
        "distribution": F.transform(p["distribution"], lambda e: e["r"]), "variable": F.transform(p["variableMeasured"], lambda e: e["r"]),
    }
    sets = followed(named, "_set", nodes.where(_type(F.col("types")).contains("Dataset")), "d", **facts).where("d.node is not null").drop("_set").withColumn("provider", F.coalesce("d.provider", "site_provider"))
    flat = _with_provider(sets, nodes).withColumn("_dist", F.explode_outer("d.distribution"))
    conforms = F.transform(p["conformsTo"], lambda e: F.coalesce(e["r"], e["v"]))
    flat = followed(flat, "_dist", nodes, "dist", url=_text(p, "contentUrl"), format=_text(p, "encodingFormat"), conforms=conforms).withColumn("_var", F.explode_outer("d.variable"))
    flat = followed(flat, "_var", nodes, "var", property=_iri(p, "propertyID"), name=_text(p, "name"), unit=_iri(p, "unitCode"), label=_text(p, "unitText"), technique=_text(p, "measurementTechnique"))
    uri, name, _ = _provider(F.col("provider"), F.col("provider_node"))
    # A distribution or variable that is named and not described is still that one.
    variable = F.coalesce(_named(F.col("_var")), F.col("var.property"))
    base = flat.select(
        "profile_uri", "site_uri", _named(F.col("d.node")).alias("dataset_uri"), F.col("d.name").alias("dataset_name"), F.col("d.description").alias("dataset_description"), F.col("d.coverage").alias("temporal_coverage"),
        uri.alias("provider_uri"), name.alias("provider_name"), F.col("d.license").alias("license"), F.col("dist.url").alias("distribution_url"), media_type(F.col("dist.format")).alias("media_type"),
        F.coalesce("dist.conforms", F.array().cast("array<string>")).alias("conforms_to"), variable.alias("variable_uri"), F.col("var.name").alias("variable_name"), F.col("var.unit").alias("unit_uri"),
        F.col("var.label").alias("unit_label"), F.col("var.technique").alias("measurement_technique"),
    )
    base = base.withColumn("span", temporal_interval(F.col("temporal_coverage")))
    parts = {"_site": identity_iri(F.col("site_uri")), "_dataset": identity_iri(F.col("dataset_uri")), "_provider": identity_iri(F.col("provider_uri")), "_url": identity_iri(F.col("distribution_url")), "_variable": identity_iri(F.col("variable_uri"))}
    labels = {"_provider": F.coalesce("_provider", folded_label(F.col("provider_name"))), "_label": folded_label(F.col("dataset_name")), "_variable_label": folded_label(F.col("variable_name"))}
    base = base.withColumns(parts).withColumns(labels)
    base = base.withColumn("dataset_id", dataset_id_of(*[F.col(c) for c in ("_site", "_dataset", "_provider", "_label")]))
    base = base.withColumn("distribution_id", distribution_id(F.col("dataset_id"), F.col("_url"), F.col("media_type")))
    base = base.withColumn("variable_id", variable_id_of(F.col("_variable"), F.col("_provider"), F.col("_variable_label")))
    handled = base.withColumn("access_url", F.col("distribution_url")).withColumn("handler_id", F.when(F.col("distribution_url").isNotNull(), first_match(HANDLERS))).drop("access_url")
    found = diagnostics(
        diagnostic(F.col("span.problem").isNotNull(), "warning", "invalid_temporal_coverage", "/temporalCoverage", "Temporal coverage is no interval of instants."),
        diagnostic(F.col("dataset_id").isNull(), "warning", "dataset_identity_incomplete", "/@id", "A dataset lacks what identifies it."),
        diagnostic(F.col("dataset_uri").isNotNull() & F.col("_dataset").isNull(), "warning", "invalid_dataset_uri", "/@id", "A dataset's URI is malformed."),
    )
    fetchable = F.col("handler_id").isNotNull() & (F.col("handler_id") != "unknown")
    return handled.select("*", F.col("span.start").alias("temporal_start"), F.col("span.end").alias("temporal_end"), fetchable.alias("fetchable"), found.alias("diagnostics")).drop("span", *parts, *labels)
