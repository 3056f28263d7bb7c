"""Content identities: SHA-256 over typed, length-prefixed values under a namespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import folded_label, identity_iri

VERSION = "0.1.0"
DATASET, DISTRIBUTION, VARIABLE = "tarn.dataset-id.v1", "tarn.distribution-id.v1", "tarn.variable-id.v1"
TYPES = {"string": "character", "int": "integer", "boolean": "logical"}


def contract_hash(namespace: str, *values: Column, kind: str = "string", version: str = VERSION) -> Column:
    """The identity of ``values``, all of one kind (string, int or boolean). A null is a value of its own, unlike any text."""
    name = TYPES[kind]
    text = {"boolean": lambda v: F.upper(v.cast("string"))}.get(kind, lambda v: v.cast("string"))
    term = lambda v: F.coalesce(F.concat(F.lit(f"{name}:"), F.octet_length(text(v)).cast("string"), F.lit(":"), text(v)), F.lit(f"{name}:NA:"))
    return F.sha2(F.concat_ws("\n", F.lit(f"contract:{version}"), F.lit(f"namespace:{namespace}"), *map(term, values)), 256)


def dataset_id(site_uri: Column, dataset_uri: Column, provider_uri: Column, provider_name: Column, name: Column) -> Column:
    """By site and dataset URI; where either is malformed by site, provider (URI, else folded name) and folded dataset name; else null."""
    return dataset_id_of(identity_iri(site_uri), identity_iri(dataset_uri), F.coalesce(identity_iri(provider_uri), folded_label(provider_name)), folded_label(name))


def dataset_id_of(site: Column, dataset: Column, provider: Column, label: Column) -> Column:
    """The same from canonical parts. As columns of their own these are computed once, not wherever the identity names them."""
    by_uri = contract_hash(DATASET, F.lit("uri"), site, dataset)
    by_label = contract_hash(DATASET, F.lit("fallback"), site, provider, label)
    return F.when(site.isNotNull() & dataset.isNotNull(), by_uri).when(site.isNotNull() & provider.isNotNull() & (label != ""), by_label)


def distribution_id(dataset: Column, url: Column, media: Column) -> Column:
    """By dataset identity, URL and media type (which may be missing); null without the first two."""
    return F.when(dataset.isNotNull() & url.isNotNull(), contract_hash(DISTRIBUTION, dataset, url, media))


def variable_id(variable_uri: Column, provider: Column, name: Column) -> Column:
    """By URI; else by provider and folded name; null where neither is complete."""
    return variable_id_of(identity_iri(variable_uri), provider, folded_label(name))


def variable_id_of(uri: Column, provider: Column, label: Column) -> Column:
    """The same from canonical parts."""
    return F.when(uri.isNotNull(), contract_hash(VARIABLE, uri)).when(provider.isNotNull() & (label != ""), contract_hash(VARIABLE, provider, label))
