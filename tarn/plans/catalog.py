"""Catalog building and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.lookup import joinable
from tarn.operators.ordering import export_order, first_by_key


def violations(datasets: DataFrame, sites: DataFrame, identities: DataFrame, keys: Sequence[str], intervals: DataFrame) -> DataFrame:
    """A row with a count for each rule: every dataset's site is known, identities are unique (nulls being values), intervals run forward."""
    missing = datasets.join(joinable(sites.select("site_uri").distinct()), "site_uri", "left_anti")
    repeated = identities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    backward = intervals.where("temporal_start > temporal_end")
    count = lambda rule, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return count("site_missing", missing).unionByName(count("identity_repeated", repeated)).unionByName(count("interval_reversed", backward))


def schema_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that a table lacks, has beyond ``schema``, or has of another type: column, wanted, found. Instants are of type timestamp, which is UTC."""
    wanted, found = ({f.name: f.dataType.simpleString() for f in s} for s in (schema, df.schema))
    rows = [(c, wanted.get(c), found.get(c)) for c in {**wanted, **found} if wanted.get(c) != found.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, wanted string, found string")


def built_catalog(sites: DataFrame, datasets: DataFrame, fallback_sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites and datasets of a catalog, in export order.

    A site that was asked for but not described gets a row of its own (from ``fallback_sites``); a site described several
    times keeps its first row; dataset rows with one identity within a site keep their first.
    """
    described = first_by_key(sites, ["site_uri"], [c for c in ("name", "source_url") if c in sites.columns])
    missing = fallback_sites.join(joinable(described.select("site_uri")), "site_uri", "left_anti")
    all_sites = described.unionByName(missing, allowMissingColumns=True)
    keys = ["site_uri", "dataset_id", "distribution_id", "variable_id"]
    rest = [c for c in ("variable_name", "source_url", "dataset_name") if c in datasets.columns]
    return export_order(all_sites, "site_uri"), export_order(first_by_key(datasets, keys, rest or keys), *keys)
