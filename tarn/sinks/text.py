"""Canonical text outputs: CSV records, redacted views, reports, sitemaps."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.temporal import microsecond_text
from tarn.functions.text import canonical_url, redacted_url


@F.pandas_udf(T.StringType())
def shortest_17(values: pd.Series) -> pd.Series:
    """Doubles with up to 17 significant digits, which JVM formats don't write."""
    return values.map(lambda v: None if v is None or v != v else f"{v:.17g}")


def canonical_text(column: Column, kind: T.DataType) -> Column:
    """A value as text: logicals true and false, doubles to 17 digits, instants in UTC with microseconds, a null empty."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        shown = shortest_17(column.cast("double"))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        shown = microsecond_text(column)
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        shown = F.to_json(column)
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit(""))


def csv_records(rows: DataFrame) -> DataFrame:
    """One column, ``value``: each row as a record whose fields are all quoted."""
    quoted = [F.concat(F.lit('"'), F.replace(canonical_text(F.col(f"`{f.name}`"), f.dataType), F.lit('"'), F.lit('""')), F.lit('"')) for f in rows.schema]
    return rows.select(F.concat_ws(",", *quoted).alias("value"))


def csv_header(rows: DataFrame) -> str:
    return ",".join('"' + name.replace('"', '""') + '"' for name in rows.columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """Canonical CSV files with LF line ends, the header in each, in the rows' partitions and order."""
    header = csv_header(rows)
    records = csv_records(rows)

    def with_header(batches):
        first = True
        for batch in batches:
            yield pd.DataFrame({"value": [*([header] if first else []), *batch["value"]]})
            first = False
        if first:
            yield pd.DataFrame({"value": [header]})

    records.mapInPandas(with_header, "value string").write.text(path)


def redacted_view(rows: DataFrame) -> DataFrame:
    """Every text column named ``*_uri`` or ``*_url`` without user, query and fragment."""
    hide = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType) and f.name.endswith(("_uri", "_url"))}
    return rows.select(*[F.when(F.col(c).isNotNull(), redacted_url(F.col(c))).alias(c) if c in hide else F.col(c) for c in rows.columns])


def report(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    one = F.lit(1).alias("_one")
    counts = [df.agg(F.count(F.lit(1)).alias(name)).select("*", one) for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.join(more, "_one")
    return out.drop("_one")


#: What a package's report counts (fixed values).
REPORTED = ("sites", "datasets", "problems", "requests", "fetch_statuses", "native_resources", "observations", "harmonized_resources")


def package_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the eight counts of a package; a table that it hasn't counts as zero."""
    if unknown := set(tables) - set(REPORTED):
        raise ValueError(f"no tables of a report: {sorted(unknown)}")
    return report(**tables).select(*[F.col(n) if n in tables else F.lit(0).cast("long").alias(n) for n in REPORTED])


#: A sitemap holds so many locations at most (fixed value of its protocol).
MOST_LOCATIONS = 50_000


def sitemap_locations(urls: DataFrame, column: str) -> DataFrame:
    """Canonical URLs, each once, in order of their bytes."""
    return urls.select(canonical_url(F.col(column)).alias("loc")).where("loc IS NOT NULL").distinct().orderBy("loc")


def sitemap(urls: DataFrame, column: str) -> str:
    """The sitemap of so many locations at most as the protocol allows; more are an error. It is one file, so the driver writes it."""
    found = [r["loc"] for r in sitemap_locations(urls, column).limit(MOST_LOCATIONS + 1).collect()]
    if len(found) > MOST_LOCATIONS:
        raise ValueError(f"more than {MOST_LOCATIONS} locations: write several sitemaps")
    entries = "".join(f"  <url><loc>{escape(u)}</loc></url>\n" for u in found)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n{entries}</urlset>\n'
