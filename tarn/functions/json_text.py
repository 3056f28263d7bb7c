"""Strict JSON: what a text must be before anything reads it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Problem(ValueError):
    pass


def problem_of(text: str | None, max_bytes: int, max_depth: int, max_members: int) -> str | None:
    """missing, bytes, byte_order_mark, depth, members, duplicate_member, constant (NaN and the like), or syntax; null for strict JSON."""
    if text is None:
        return "missing"
    if len(text.encode("utf-8", "surrogatepass")) > max_bytes:
        return "bytes"
    if text.startswith("\ufeff"):
        return "byte_order_mark"
    depth = members = 0
    quoted = escaped = False
    for ch in text:  # before parsing, which recurses
        if quoted:
            quoted, escaped = escaped or ch != '"', ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
            if depth > max_depth:
                return "depth"
        elif ch in "}]":
            depth -= 1
        elif ch in ",:":
            members += 1
            if members > max_members:
                return "members"

    def pairs(found: list[tuple]) -> dict:
        if len({k for k, _ in found}) != len(found):
            raise _Problem("duplicate_member")
        return dict(found)

    def constant(_: str):
        raise _Problem("constant")

    try:
        json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except _Problem as problem:
        return str(problem)
    except ValueError:
        return "syntax"
    return None


def json_problem(text: Column, max_bytes: int = 8 << 20, max_depth: int = 64, max_members: int = 1_000_000) -> Column:
    """What is wrong with a JSON text; null if nothing is. No built-in function sees repeated members."""

    @F.pandas_udf(T.StringType())
    def judge(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: problem_of(t, max_bytes, max_depth, max_members), na_action=None).astype(object)

    return judge(text)
