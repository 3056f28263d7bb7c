"""CRC-32 in DuckDB SQL: what the queries' results are checked against."""

from __future__ import annotations


def _entry(byte: int) -> int:
    """What the checksum's register takes in for one byte: eight steps of division by its polynomial (fixed value)."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_TABLE = "[" + ", ".join(str(_entry(i)) for i in range(256)) + "]"


def crc32_sql(text: str) -> str:
    """An SQL expression for the unsigned CRC-32 of the UTF-8 bytes of ``text``, an expression that isn't null."""
    u = "unicode(x)"
    tail = lambda *shifts: ", ".join(f"128 | (({u} >> {s}) & 63)" for s in shifts)
    of_character = f"CASE WHEN {u} < 128 THEN [{u}] WHEN {u} < 2048 THEN [192 | ({u} >> 6), {tail(0)}] WHEN {u} < 65536 THEN [224 | ({u} >> 12), {tail(6, 0)}] ELSE [240 | ({u} >> 18), {tail(12, 6, 0)}] END"
    numbers = f"CAST(flatten(list_transform(string_split({text}, ''), lambda x: {of_character})) AS BIGINT[])"
    return f"(CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor({_TABLE}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) END)"
