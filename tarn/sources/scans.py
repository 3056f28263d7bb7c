"""Scans of collections along next links: as a stream that goes on where it stopped, and over pages that are there already.

    spark.dataSource.register(CollectionScan)
    spark.readStream.format("collection_scan").option("url", items).option("properties", "id string").load()

A scan ends for one of the reasons in REASONS, which is a row of its own, with whether rows are missing. Pages name each
other, so they are asked for one after the other: a batch is a page, bounded in bytes, and the stream's offset holds the next
link and what the end depends on. A scan that is stopped and started again from its checkpoint asks for no page twice.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tarn.sources.features import FeatureReader
from tarn.sources.http import MOST_BYTES, fetched

#: Why a scan ends.
REASONS = ("number_matched", "empty_page", "limit", "no_next", "repeated_next", "page_budget")
#: Features and pages of a scan at most, where nothing else is said.
LIMIT, PAGES = 100_000, 100


def _mark(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:16]


def after_page(state: dict, features: int, matched: object, link: str | None, limit: int, pages: int) -> dict:
    """The state of a scan after a page: url (null at the end), pages, rows, matched, trusted, seen, stop and truncated.

    How many match is known from the first page that says so, unless a page says something else, or nothing sensible, or
    more features come than match. Rows are those kept: ``limit`` at most.
    """
    now = dict(state, pages=state["pages"] + 1)
    fine = isinstance(matched, int) and not isinstance(matched, bool) and matched >= 0
    if matched is not None and (not fine or state["matched"] not in (None, matched)):
        now["trusted"] = False
    elif fine:
        now["matched"] = matched
    before, kept = state["rows"], min(features, limit - state["rows"])
    now["rows"] = before + kept
    all_ = lambda: now["trusted"] and now["matched"] is not None and now["rows"] >= now["matched"]
    some = lambda: now["trusted"] and now["matched"] is not None and now["rows"] < now["matched"]
    end = None
    if not features:
        end = ("number_matched", False) if all_() else ("empty_page", link is not None or some())
    else:
        if now["matched"] is not None and before + features > now["matched"]:
            now["trusted"] = False
        if all_():
            end = "number_matched", False
        elif now["rows"] >= limit:
            end = "limit", features > kept or link is not None or some()
        elif link is None:
            end = "no_next", some()
        elif _mark(link) in state["seen"]:
            end = "repeated_next", True
        elif now["pages"] >= pages:
            end = "page_budget", True
    if end:
        return now | {"url": None, "stop": end[0], "truncated": end[1]}
    return now | {"url": link, "seen": [*state["seen"], _mark(link)]}


class CollectionScan(DataSource):
    """Options: url (of the items, with its query), properties (DDL of the columns), limit, pages, max_bytes (of a page), timeout in seconds.

    Rows: page (from 0), feature_id, geometry, the properties, and stop_reason and truncated, which only the last row has.
    """

    @classmethod
    def name(cls) -> str:
        return "collection_scan"

    def schema(self) -> str:
        return f"page int, feature_id string, geometry string, {self.options['properties']}, stop_reason string, truncated boolean"

    def simpleStreamReader(self, schema: T.StructType) -> ScanReader:
        return ScanReader(schema, dict(self.options))


class ScanReader(SimpleDataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields, self.url = schema.fields[3:-2], options["url"]
        self.limit, self.pages = int(options.get("limit", LIMIT)), int(options.get("pages", PAGES))
        self.timeout, self.most_bytes = float(options.get("timeout", 60)), int(options.get("max_bytes", MOST_BYTES))

    def initialOffset(self) -> dict:
        return {"url": self.url, "pages": 0, "rows": 0, "matched": None, "trusted": True, "seen": [_mark(self.url)], "stop": None, "truncated": None}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        body = json.loads(fetched(start["url"], self.timeout, self.most_bytes))
        link = next((x.get("href") for x in body.get("links", []) if x.get("rel") == "next" and x.get("href")), None)
        link = urllib.parse.urljoin(start["url"], link) if link else None
        if link and urllib.parse.urlsplit(link)[:2] != urllib.parse.urlsplit(self.url)[:2]:
            raise ValueError("the next page is another service's")
        end = after_page(start, len(body["features"]), body.get("numberMatched"), link, self.limit, self.pages)
        rows = []
        for feature in body["features"][: end["rows"] - start["rows"]]:
            properties, geometry = feature.get("properties") or {}, feature.get("geometry")
            values = [FeatureReader._typed(properties.get(f.name), f.dataType) for f in self.fields]
            rows.append((start["pages"], None if feature.get("id") is None else str(feature["id"]), None if geometry is None else json.dumps(geometry), *values, None, None))
        if end["stop"]:
            rows.append((start["pages"], None, None, *[None] * len(self.fields), end["stop"], end["truncated"]))
        return rows, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next page; nothing new once the scan has ended."""
        if start["url"] is None:
            return iter(()), start
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same page again, after a failure before it was committed."""
        return iter(()) if start["url"] is None else iter(self._page(start)[0])


def page_facts(pages: DataFrame) -> DataFrame:
    """pages (scan_id, page, url, body) with features, matched, said (whether the body names a number that match) and next of each body."""
    schema = "features array<string>, numberMatched string, links array<struct<rel: string, href: string>>"
    parsed = pages.withColumn("d", F.from_json("body", schema))
    link = F.get(F.filter("d.links", lambda x: (x["rel"] == "next") & (F.coalesce(x["href"], F.lit("")) != "")), F.lit(0))["href"]
    return parsed.select("scan_id", "page", "url", F.coalesce(F.size("d.features"), F.lit(0)).alias("features"), F.when(F.col("d.numberMatched").rlike(r"^\d{1,15}$"), F.col("d.numberMatched").cast("long")).alias("matched"), F.col("d.numberMatched").isNotNull().alias("said"), link.alias("next"))


def scan_status(pages: DataFrame, limit: int = LIMIT, budget: int = PAGES) -> DataFrame:
    """Why each scan over pages that were written down (scan_id, page from 0, url, body) ended: scan_id, pages, rows, stop_reason, truncated.

    The rules are those of ``after_page``, as columns: a scan ends at its first page with a reason, whatever pages follow. A
    scan whose pages give no reason is not at its end: its reason is null. Pages beyond ``budget`` aren't looked at, so a
    window holds so many pages of a scan at most.
    """
    order = Window.partitionBy("scan_id").orderBy("page")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    facts = page_facts(pages.where(F.col("page") < budget))
    facts = facts.withColumn("prior", F.coalesce(F.sum("features").over(before), F.lit(0))).withColumn("known", F.first("matched", ignorenulls=True).over(until))
    odd = (F.col("said") & F.col("matched").isNull()) | F.coalesce(F.col("matched") != F.col("known"), F.lit(False))
    more = (F.col("features") > 0) & F.coalesce(F.col("prior") + F.col("features") > F.col("known"), F.lit(False))
    facts = facts.withColumn("known", F.when(~F.bool_or(odd | more).over(until), F.col("known"))).withColumn("urls", F.collect_set("url").over(until))
    rows = F.least(F.col("prior") + F.col("features"), F.lit(limit))
    all_, some, linked = F.coalesce(rows >= F.col("known"), F.lit(False)), F.coalesce(rows < F.col("known"), F.lit(False)), F.col("next").isNotNull()
    end = lambda reason, truncated: F.struct(F.lit(reason).alias("stop_reason"), truncated.alias("truncated"))
    stop = (
        F.when(all_, end("number_matched", F.lit(False)))
        .when(F.col("features") == 0, end("empty_page", linked | some))
        .when(rows >= limit, end("limit", (F.col("prior") + F.col("features") > limit) | linked | some))
        .when(~linked, end("no_next", some))
        .when(F.array_contains("urls", F.col("next")), end("repeated_next", F.lit(True)))
        .when(F.col("page") + 1 >= budget, end("page_budget", F.lit(True)))
    )
    judged = facts.select("scan_id", "page", rows.alias("rows"), stop.alias("stop"))
    last = F.coalesce(F.min(F.when(F.col("stop").isNotNull(), F.struct("page", "rows", "stop"))), F.max(F.struct("page", "rows", "stop")))
    return judged.groupBy("scan_id").agg(last.alias("last")).select("scan_id", (F.col("last.page") + 1).alias("pages"), "last.rows", "last.stop.stop_reason", "last.stop.truncated")
