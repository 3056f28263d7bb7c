"""Text and URL functions. All but label folding are Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control, format and surrogate characters, which no identifier or label may hold.
UNSAFE = r"[\p{Cc}\p{Cf}\p{Cs}]"
#: The same and separators, which no IRI may hold.
UNSAFE_IRI = r"[\p{Z}\p{Cc}\p{Cf}\p{Cs}]"


def text_is_safe(text: Column, max_bytes: int | None = None) -> Column:
    """Whether a text is not null, free of control, format and surrogate characters, and within a number of UTF-8 bytes."""
    fine = text.isNotNull() & ~text.rlike(UNSAFE)
    if max_bytes is not None:
        fine = fine & (F.octet_length(text) <= max_bytes)
    return F.coalesce(fine, F.lit(False))


def media_type(text: Column) -> Column:
    """A media type without parameters, trimmed and in lower case; null if nothing is left to name."""
    return F.when(F.trim(text) != "", F.lower(F.trim(F.split_part(text, F.lit(";"), F.lit(1)))))


def byte_key(text: Column) -> Column:
    """Lower-case hexadecimal UTF-8 bytes: sorting by it is sorting by bytes. Null becomes ``~``, after everything."""
    return F.coalesce(F.lower(F.hex(F.encode(text, "UTF-8"))), F.lit("~"))


@F.pandas_udf(T.StringType())
def folded_label(labels: pd.Series) -> pd.Series:
    """A label for comparison: NFC, ASCII white space trimmed and collapsed, case folded, NFC again."""

    def fold(text):
        if text is None:
            return None
        text = re.sub(r"[ \t\r\n]+", " ", unicodedata.normalize("NFC", text)).strip(" ")
        return unicodedata.normalize("NFC", text.casefold())

    return labels.map(fold)


def _url_parts(url: Column) -> dict[str, Column]:
    part = lambda group: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", group)
    authority = part(2)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    return {
        "scheme": F.lower(part(1)),
        "user": F.regexp_extract(authority, r"^(.*)@", 1),
        "has_user": authority.contains("@"),
        "host": F.regexp_replace(F.lower(F.regexp_replace(host_port, r":\d*$", "")), r"\.$", ""),
        "port": F.regexp_extract(host_port, r":(\d+)$", 1),
        "path": part(3),
        "query": part(4),
        "fragment": part(5),
    }


def _rebuilt(p: dict[str, Column], fragment: bool) -> Column:
    default = ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80")) | (p["port"] == "")
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"])), path, p["query"], p["fragment"] if fragment else F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no final dot, default port or fragment. Null unless absolute HTTP(S)."""
    p = _url_parts(url)
    return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), _rebuilt(p, False))


def identity_iri(iri: Column) -> Column:
    """An IRI for identity: scheme (and for HTTP the host) canonical, the rest as it is, the fragment kept; null if malformed."""
    p = _url_parts(iri)
    scheme = F.lower(F.regexp_extract(iri, r"^([A-Za-z][A-Za-z0-9+.-]*):.+$", 1))
    http = scheme.isin("http", "https")
    usable = (p["host"] != "") & ~p["has_user"]
    other = F.concat(scheme, F.substring(iri, F.char_length(scheme) + 1, F.char_length(iri)))
    return F.when((scheme == "") | iri.rlike(UNSAFE_IRI), F.lit(None)).when(~http, other).when(usable, _rebuilt(p, True))


#: Networks that are not public (fixed values of the IPv4 registries), as patterns over a dotted address.
PRIVATE_IPV4 = (
    r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|2[3-5]\d)\."
)
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def url_is_safe(url: Column) -> Column:
    """Whether a URL may be requested: absolute HTTP(S), no user, a host that is neither local, private nor an IPv6 literal."""
    p = _url_parts(url)
    host = p["host"]
    local = (host == "localhost") | host.endswith(".localhost") | (host.rlike(IPV4) & host.rlike(PRIVATE_IPV4)) | host.contains(":") | host.startswith("[")
    return F.coalesce(p["scheme"].isin("http", "https") & (host != "") & ~p["has_user"] & ~local, F.lit(False))


def redacted_url(url: Column) -> Column:
    """A URL whose query and fragment are masked and whose user is left out; ``<invalid-url>`` for what is none."""
    base = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")
    query = F.when(F.regexp_extract(url, r"^([^#]*)", 1).contains("?"), F.lit("?[redacted]")).otherwise(F.lit(""))
    fragment = F.when(url.contains("#"), F.lit("#[redacted]")).otherwise(F.lit(""))
    return F.when(url.isNull() | (url == "") | url.rlike(UNSAFE_IRI), F.lit("<invalid-url>")).otherwise(F.concat(base, query, fragment))


def query_value(url: Column, name: str) -> Column:
    """The decoded value of a query parameter that occurs exactly once and isn't empty; else null."""
    pattern = rf"[?&]{re.escape(name)}=([^&#]*)"
    found = F.regexp_extract_all(F.split_part(url, F.lit("#"), F.lit(1)), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) == 1, F.nullif(F.try_url_decode(found[0]), F.lit("")))


def uri_number(uri: Column, collection: str) -> Column:
    """The id of a reference URI ``.../ref/<collection>/<positive number>``, as text; else null."""
    return F.nullif(F.regexp_extract(uri, rf"/ref/{collection}/([1-9][0-9]*)$", 1), F.lit(""))
