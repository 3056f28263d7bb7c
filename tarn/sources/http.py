"""One bounded request: what came, or an error when it is too much, too late, or not what was asked for."""

from __future__ import annotations

import urllib.parse
import urllib.request

#: Bytes of a response at most where nothing else is said (fixed value).
MOST_BYTES = 8 << 20


def fetched(url: str, timeout: float, most_bytes: int = MOST_BYTES, data: bytes | None = None, headers: dict[str, str] | None = None, media: tuple[str, ...] = ()) -> bytes:
    """The body of one GET, or POST of ``data``. Retries are Spark's: a task that fails is run again."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError("only HTTP(S) is requested")
    request = urllib.request.Request(url, data=data, headers=headers or {})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        kind = response.headers.get_content_type()
        body = response.read(most_bytes + 1)
    if len(body) > most_bytes:
        raise ValueError(f"a response of more than {most_bytes} bytes")
    if media and kind not in media:
        raise ValueError(f"a response of type {kind}")
    return body
