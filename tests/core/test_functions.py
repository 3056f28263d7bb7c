import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tarn.functions import geometry, identity, numbers, temporal, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "safe"),
    [
        ("https://example.org/a", True), ("http://8.8.8.8/", True), ("ftp://example.org/", False), ("http://localhost:80/", False), ("http://a.localhost/", False), ("http://10.0.0.1/", False), ("http://172.16.0.1/", False), ("http://172.32.0.1/", True),
        ("http://100.64.0.1/", False), ("http://192.0.2.9/", False), ("http://192.0.3.9/", True), ("http://224.0.0.1/", False), ("http://[::1]/", False), ("https://u:p@example.org/", False), ("/relative", False), (None, False),
    ],
)
def test_safe_urls(spark, url, safe):
    assert one(spark, text.url_is_safe(F.lit(url).cast("string"))) is safe


@pytest.mark.parametrize(
    ("url", "shown"),
    [("https://u:p@example.org/a?b=c#d", "https://example.org/a?[redacted]#[redacted]"), ("https://example.org/a", "https://example.org/a"), ("https://example.org/#x?y", "https://example.org/#[redacted]"), ("", "<invalid-url>"), ("a b", "<invalid-url>"), (None, "<invalid-url>")],
)
def test_redaction(spark, url, shown):
    assert one(spark, text.redacted_url(F.lit(url).cast("string"))) == shown


@pytest.mark.parametrize(
    ("iri", "wanted"),
    [("HTTPS://Example.ORG:443/a#b", "https://example.org/a#b"), ("http://example.org.:8080", "http://example.org:8080/"), ("URN:x:Y", "urn:x:Y"), ("no iri", None), ("https://u@example.org/", None), ("https:///x", None), (None, None)],
)
def test_identity_iris(spark, iri, wanted):
    assert one(spark, text.identity_iri(F.lit(iri).cast("string"))) == wanted


def test_labels_and_media_types(spark):
    assert one(spark, text.folded_label(F.lit(" Café \t FLOW\n Straße "))) == "café flow strasse"
    assert one(spark, text.media_type(F.lit(" Text/CSV ; charset=utf-8"))) == "text/csv"
    assert one(spark, text.media_type(F.lit("  "))) is None
    assert one(spark, text.query_value(F.lit("https://x/?siteid=A%20B&b=1#siteid=C"), "siteid")) == "A B"
    assert one(spark, text.query_value(F.lit("https://x/?a=1&a=2"), "a")) is None
    assert one(spark, text.uri_number(F.lit("https://x/ref/mainstems/29559"), "mainstems")) == "29559"


def test_identities(spark):
    def wanted(*values):
        lines = ["contract:0.1.0", "namespace:n", *("character:NA:" if v is None else f"character:{len(v.encode())}:{v}" for v in values)]
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()

    for values in (("a", "b"), ("café flow", None), ("", "a\nb")):
        assert one(spark, identity.contract_hash("n", *[F.lit(v).cast("string") for v in values])) == wanted(*values)
    assert one(spark, identity.contract_hash("n", F.lit(7), kind="int")) == hashlib.sha256(b"contract:0.1.0\nnamespace:n\ninteger:1:7").hexdigest()
    assert one(spark, identity.contract_hash("n", F.lit(True), kind="boolean")) == hashlib.sha256(b"contract:0.1.0\nnamespace:n\nlogical:4:TRUE").hexdigest()
    ids = [identity.dataset_id(*[F.lit(v).cast("string") for v in row]) for row in (("https://s/1", "https://d/1", None, None, None), ("https://s/1", "bad uri", "https://p/", None, " Name "), ("https://s/1", None, None, "Provider", "name"), ("https://s/1", None, None, None, "name"))]
    got = [one(spark, i) for i in ids]
    assert len(set(got)) == 4 and got[3] is None and all(len(g) == 64 for g in got[:3])


@pytest.mark.parametrize(("value", "wanted"), [("0", (0.0, False, True)), ("-1.50e2", (-150.0, False, True)), ("01", (None, False, False)), ("+1", (None, False, False)), (".5", (None, False, False)), ("NaN", (None, False, False)), ("1e999", (None, False, False)), ("", (None, False, False)), (None, (None, True, True))])
def test_admitted_numbers(spark, value, wanted):
    assert tuple(one(spark, numbers.admitted_number(F.lit(value).cast("string")))) == wanted


def test_even_shares(spark):
    shares = [one(spark, numbers.even_share(F.lit(10), F.lit(4), F.lit(100), F.lit(p))) for p in (1, 2, 3, 4)]
    assert shares == [3, 3, 2, 2]
    assert [one(spark, numbers.even_share(F.lit(10), F.lit(4), F.lit(2), F.lit(p))) for p in (1, 4)] == [2, 2]


def test_times(spark):
    at = dt.datetime(2024, 2, 29, 1, 2, 3)
    assert one(spark, temporal.strict_utc(F.lit("2024-02-29T01:02:03Z")).cast("timestamp_ntz")) == at
    for bad in ("2024-02-30T01:02:03Z", "2024-02-29 01:02:03Z", "2024-02-29T01:02:03", "2024-02-29T01:02:03Z\n", None):
        assert one(spark, temporal.strict_utc(F.lit(bad).cast("string"))) is None
    assert one(spark, temporal.local_to_utc(F.lit("2024-03-01"), F.lit("00:30:00"), F.lit(-300)).cast("timestamp_ntz")) == dt.datetime(2024, 3, 1, 5, 30)
    assert one(spark, temporal.microsecond_text(F.lit(at))) == "2024-02-29T01:02:03.000000Z"
    span = one(spark, temporal.temporal_interval(F.lit("2024-01-01T00:00:00+02:00/..")))
    assert span["start"] is not None and span["end"] is None and span["problem"] is None
    assert one(spark, temporal.temporal_interval(F.lit("soon")))["problem"] == "invalid_temporal_coverage"
    assert one(spark, temporal.temporal_interval(F.lit("x/..")))["problem"] == "invalid_temporal_endpoint"


def test_polygons_are_canonical():
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"
    turned = "POLYGON ((10 10, 10 0, 0 0, 0 10, 10 10), (4 4, 4 2, 2 2, 2 4, 4 4))"
    assert geometry.area_id(square) == geometry.area_id(turned)
    assert geometry.area_id(square) != geometry.area_id("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))")
    two = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"
    assert geometry.area_id(two) == geometry.area_id("MULTIPOLYGON (((6 6, 5 5, 6 5, 6 6)), ((1 1, 0 0, 1 0, 1 1)))")
    for bad in ("POLYGON ((0 0, 1 1, 0 0))", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "POINT (1 2)", "CIRCLE (1)"):
        with pytest.raises(ValueError):
            geometry.area_id(bad)


def test_least_rotation():
    for items in ("bca", "aab", "baab", "abab", "a", "cba"):
        n = geometry.least_rotation(list(items))
        assert items[n:] + items[:n] == min(items[i:] + items[:i] for i in range(len(items)))


def test_clipped_lengths():
    square = geometry.canonical_polygons("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 4 6, 6 6, 6 4, 4 4))")
    degree = geometry.EARTH_KM * 3.141592653589793 / 180
    km = lambda wkt: geometry.clipped_km(geometry.lines_of(wkt), square)
    assert km("LINESTRING (5 -5, 5 3)") == pytest.approx(3 * degree, rel=1e-6)
    assert km("LINESTRING (5 3, 5 12)") == pytest.approx(5 * degree, rel=1e-6)  # the hole is left out
    assert km("LINESTRING (20 0, 20 10)") == 0
    assert km("MULTILINESTRING ((1 1, 1 2), (1 2, 1 3))") == pytest.approx(2 * degree, rel=1e-6)
