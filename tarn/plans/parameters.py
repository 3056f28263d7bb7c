"""Parameters of the named queries: checked values, never text that is pasted into a query."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Sequence

from tarn.functions import geometry

#: Sites that a query names at most.
MOST_SITES = 200
_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+")


def uri(value: str) -> str:
    """An absolute URI without characters that end or open an IRI."""
    if not isinstance(value, str) or not _IRI.fullmatch(value) or any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in value):
        raise ValueError(f"no absolute URI: {value!r}")
    return value


def uri_list(values: Sequence[str]) -> list[str]:
    """Up to 200 URIs, each once, in order of their bytes."""
    out = sorted({uri(v) for v in values}, key=str.encode)
    if not 1 <= len(out) <= MOST_SITES:
        raise ValueError(f"from 1 to {MOST_SITES} URIs")
    return out


def whole(value: int, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"a whole number from {least} to {most}")
    return value


def literal(value: str, max_bytes: int = 4096) -> str:
    if not isinstance(value, str) or len(value.encode()) > max_bytes or any(unicodedata.category(c) in ("Cc", "Cs") for c in value):
        raise ValueError("a plain text of bounded length")
    return value


def instant(value: dt.datetime) -> dt.datetime:
    """An instant with a zone, in UTC."""
    if value.tzinfo is None:
        raise ValueError("an instant has a zone")
    return value.astimezone(dt.UTC)


def area(wkt: str) -> str:
    """A polygon in longitude and latitude, within their ranges."""
    west, south, east, north = geometry.bounds(geometry.canonical_polygons(wkt))
    if west < -180 or east > 180 or south < -90 or north > 90:
        raise ValueError("longitudes from -180 to 180, latitudes from -90 to 90")
    return wkt
