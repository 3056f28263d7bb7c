"""Collections of features over HTTP as a Spark data source: equality filters and the box go to the service, pages come back.

    spark.dataSource.register(FeatureCollections)
    spark.read.format("feature_collection").option("url", items).option("properties", "id string, name string").load()

Filters are pushed where spark.sql.python.filterPushdown.enabled is true, which Spark asks for. Each page is asked for by its offset and is a partition of its own, so pages are fetched and retried by tasks.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from tarn.sources.http import MOST_BYTES, fetched

_READ = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.BooleanType: bool}


class Page(InputPartition):
    """A page by its offset; ``onward`` goes from page to page until the service has no more."""

    def __init__(self, offset: int, onward: bool = False):
        super().__init__(offset)
        self.offset, self.onward = offset, onward


class FeatureCollections(DataSource):
    """Options: url (of the items), properties (DDL of the columns), bbox, limit (of a page), pages (at most, where the service doesn't count), max_bytes (of a page), timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def schema(self) -> str:
        return f"feature_id string, geometry string, {self.options['properties']}"

    def reader(self, schema: T.StructType) -> FeatureReader:
        return FeatureReader(schema, dict(self.options))


class FeatureReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields = schema.fields
        self.url, self.limit, self.timeout = options["url"], int(options.get("limit", 1000)), float(options.get("timeout", 60))
        self.pages, self.most_bytes = int(options.get("pages", 10_000)), int(options.get("max_bytes", MOST_BYTES))
        self.query = {"f": "json", **({"bbox": options["bbox"]} if "bbox" in options else {})}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of a property goes into the request; Spark keeps the rest."""
        own = {f.name for f in self.fields[2:]}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in own and f.attribute[0] not in self.query and f.value is not None:
                self.query[f.attribute[0]] = str(f.value).lower() if isinstance(f.value, bool) else str(f.value)
            else:
                yield f

    def _get(self, offset: int, limit: int) -> dict:
        url = f"{self.url}?{urllib.parse.urlencode({**self.query, 'limit': limit, 'offset': offset})}"
        return json.loads(fetched(url, self.timeout, self.most_bytes))

    def partitions(self) -> list[InputPartition]:
        """A page for each ``limit`` features of those that match, as the service counts them; where it doesn't, one task goes from page to page."""
        matched = self._get(0, 1).get("numberMatched")
        if matched is None:
            return [Page(0, onward=True)]
        return [Page(at) for at in range(0, matched, self.limit)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        """Rows of a page, or of all from it on: until a page is empty, or short without a link to the next, or ``pages`` have been read, which is an error."""
        offset, last = partition.offset, None
        for _ in range(self.pages if partition.onward else 1):
            page = self._get(offset, self.limit)
            yield from self._rows(page)
            own = [f.get("id") for f in page["features"]]
            linked = any(link.get("rel") == "next" for link in page.get("links", []))
            if not own or (len(own) < self.limit and not linked):
                return
            if own == last:
                raise ValueError("the service gives one page again and again")
            offset, last = offset + len(own), own
        if partition.onward:
            raise ValueError(f"more than {self.pages} pages")

    def _rows(self, page: dict) -> Iterator[tuple]:
        if page.get("numberReturned", len(page["features"])) != len(page["features"]):
            raise ValueError("a page doesn't hold what it says")
        for feature in page["features"]:
            properties = feature.get("properties") or {}
            geometry = feature.get("geometry")
            values = (self._typed(properties.get(f.name), f.dataType) for f in self.fields[2:])
            yield None if feature.get("id") is None else str(feature["id"]), None if geometry is None else json.dumps(geometry), *values

    @staticmethod
    def _typed(value, kind: T.DataType):
        return None if value is None else _READ[type(kind)](value)
