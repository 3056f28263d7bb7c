"""Results of a SPARQL endpoint as a Spark data source: one bounded POST, its bindings as a long table.

    spark.dataSource.register(GraphResults)
    spark.read.format("graph_results").option("url", endpoint).option("query", text).load()

The rows are those of ``documents.select_bindings``. Queries are made from checked parameters (``plans/parameters.py``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarn.sources.http import MOST_BYTES, fetched

TERMS = {"uri": "uri", "literal": "literal", "typed-literal": "literal", "bnode": "bnode"}
MEDIA = "application/sparql-results+json"


class GraphResults(DataSource):
    """Options: url, query, timeout in seconds, max_bytes and max_rows of the result."""

    @classmethod
    def name(cls) -> str:
        return "graph_results"

    def schema(self) -> str:
        return "row long, variable_index int, variable string, term_type string, value string, datatype string, language string"

    def reader(self, schema: T.StructType) -> GraphReader:
        return GraphReader(dict(self.options))


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.query = options["url"], options["query"]
        self.timeout, self.most_bytes, self.most_rows = float(options.get("timeout", 30)), int(options.get("max_bytes", MOST_BYTES)), int(options.get("max_rows", 10_000))

    def partitions(self) -> list[InputPartition]:
        """One: an endpoint answers a query once, and its rows have no order to divide them by."""
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        headers = {"Content-Type": "application/sparql-query", "Accept": MEDIA}
        found = json.loads(fetched(self.url, self.timeout, self.most_bytes, self.query.encode(), headers, (MEDIA,)))
        if "results" not in found or "boolean" in found:
            raise ValueError("no result of a SELECT query")
        variables, bindings = found["head"]["vars"], found["results"]["bindings"]
        if len(bindings) > self.most_rows:
            raise ValueError(f"more than {self.most_rows} rows")
        for row, terms in enumerate(bindings, 1):
            for variable, term in terms.items():
                yield row, variables.index(variable) + 1, variable, TERMS[term["type"]], term["value"], term.get("datatype"), term.get("xml:lang")
