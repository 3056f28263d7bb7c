import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tarn.sources import scans


def run(pages, limit, budget):
    """A scan by ``after_page`` over pages by url: (features, matched, next)."""
    state = {"url": "u0", "pages": 0, "rows": 0, "matched": None, "trusted": True, "seen": [scans._mark("u0")], "stop": None, "truncated": None}
    while state["url"] is not None:
        n, matched, link = pages[state["url"]]
        state = scans.after_page(state, n, matched, link, limit, budget)
    return state["pages"], state["rows"], state["stop"], state["truncated"]


@pytest.mark.parametrize(
    ("pages", "limit", "budget", "wanted"),
    [
        ([(2, 5, 1), (2, 5, 2), (1, 5, None)], 9, 9, (3, 5, "number_matched", False)),
        ([(2, None, 1), (2, None, None)], 9, 9, (2, 4, "no_next", False)),
        ([(2, 9, 1), (2, 9, None)], 9, 9, (2, 4, "no_next", True)),
        ([(2, None, 1), (2, None, 0)], 9, 9, (2, 4, "repeated_next", True)),
        ([(2, None, 1), (2, None, 2), (2, None, 3), (2, None, None)], 9, 3, (3, 6, "page_budget", True)),
        ([(2, None, 1), (0, None, 2), (1, None, None)], 9, 9, (2, 2, "empty_page", True)),
        ([(2, None, 1), (0, None, None)], 9, 9, (2, 2, "empty_page", False)),
        ([(2, 3, 1), (2, 3, 2), (2, 3, None)], 9, 9, (3, 6, "no_next", False)),
        ([(2, 4, 1), (2, 5, 2), (2, 4, None)], 9, 9, (3, 6, "no_next", False)),
        ([(4, 9, 1), (4, 9, 2), (1, 9, None)], 5, 9, (2, 5, "limit", True)),
        ([(5, None, None)], 5, 9, (1, 5, "limit", False)),
        ([(0, 0, None)], 5, 9, (1, 0, "number_matched", False)),
        ([(2, -1, 1), (2, 4, None)], 9, 9, (2, 4, "no_next", False)),
    ],
)
def test_reasons(pages, limit, budget, wanted):
    assert run({f"u{i}": (n, m, None if link is None else f"u{link}") for i, (n, m, link) in enumerate(pages)}, limit, budget) == wanted


def test_written_pages_are_judged_alike(spark):
    rng, rows, wanted = random.Random(4), [], {}
    for scan in range(300):
        pages = {}
        for i in range(rng.randint(1, 6)):
            link = rng.choice([f"u{i + 1}", f"u{i + 1}", f"u{i + 1}", None, "u0"])
            pages[f"u{i}"] = (rng.randint(0, 3) if rng.random() < 0.3 else 3, rng.choice([None, 6, 6, 9, 7, "x"]) if scan % 2 else (scan % 12 or None), link)
        last = f"u{len(pages) - 1}"
        pages[last] = (*pages[last][:2], None)
        wanted[scan] = run(pages, 10, 4)
        for i, (url, (n, matched, link)) in enumerate(pages.items()):
            body = {"features": [{"id": k} for k in range(n)], "links": [{"rel": "self", "href": url}] + ([{"rel": "next", "href": link}] if link else [])}
            rows.append((scan, i, url, json.dumps(body | ({} if matched is None else {"numberMatched": matched}))))
    found = scans.scan_status(spark.createDataFrame(rows, "scan_id long, page int, url string, body string"), 10, 4)
    assert {r["scan_id"]: (r["pages"], r["rows"], r["stop_reason"], r["truncated"]) for r in found.collect()} == wanted
    assert {w[2] for w in wanted.values()} == set(scans.REASONS)


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            at = int(self.path.rpartition("=")[2])
            links = [{"rel": "next", "href": f"items?at={at + 2}"}] if at < 8 else []
            body = json.dumps({"type": "FeatureCollection", "features": [{"id": at + k, "geometry": None, "properties": {"n": at + k}} for k in range(2)], "numberMatched": 10, "links": links}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/items?at=0", asked
    server.shutdown()


def test_a_scan_goes_on_where_it_stopped(spark, service, tmp_path):
    url, asked = service
    spark.dataSource.register(scans.CollectionScan)

    def batches(until):
        stream = spark.readStream.format("collection_scan").option("url", url).option("properties", "n long").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            for _ in range(600):
                if len(set(asked)) >= until or query.exception():
                    break
                query.awaitTermination(0.1)
            query.processAllAvailable() if until > 2 else None
        finally:
            query.stop()
        assert query.exception() is None

    batches(2)
    first = len(asked)
    batches(5)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["n"] for r in rows if r["stop_reason"] is None) == list(range(10))
    assert [(r["page"], r["stop_reason"], r["truncated"]) for r in rows if r["stop_reason"]] == [(4, "number_matched", False)]
    assert asked[0].endswith("at=0") and not any(p.endswith("at=0") for p in asked[first:])
