"""Declarative predicates over facts, and first-match classification."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("scheme_in", "contains_any", "equals_any", "regex")


@dataclass(frozen=True)
class Test:
    """One predicate over the fact (column) ``fact``: an operator and its values. A null fact never satisfies it."""

    fact: str
    operator: str
    values: tuple[str, ...]

    def column(self) -> Column:
        fact = F.col(self.fact)
        match self.operator:
            case "scheme_in":
                hit = F.lower(F.regexp_extract(fact, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*self.values)
            case "contains_any":
                hit = F.arrays_overlap(fact, F.array(*map(F.lit, self.values)))
            case "equals_any":
                hit = fact.isin(*self.values)
            case "regex":
                hit = reduce(lambda a, b: a | b, [fact.rlike(v) for v in self.values])
            case _:
                raise ValueError(f"operator is one of {OPERATORS}")
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Handler:
    """A class of distributions: satisfied if every test of ``every`` holds and, where given, one of ``some``."""

    name: str
    every: tuple[Test, ...] = ()
    some: tuple[Test, ...] = ()
    outcome: str = "fetch"
    lifecycle: str = "active"
    facts: tuple[str, ...] = field(default=("access_url", "media_type", "conforms_to"))

    def column(self) -> Column:
        both = [t.column() for t in self.every]
        if self.some:
            both.append(reduce(lambda a, b: a | b, [t.column() for t in self.some]))
        return reduce(lambda a, b: a & b, both, F.lit(True))


def first_match(handlers: Sequence[Handler]) -> Column:
    """The name of the first handler that is satisfied: one CASE expression, in order of precedence."""
    case = F.when(handlers[0].column(), F.lit(handlers[0].name))
    for h in handlers[1:]:
        case = case.when(h.column(), F.lit(h.name))
    return case


OUTCOMES, LIFECYCLES = ("fetch", "reference_only"), ("active", "deprecated")


def load_handlers(text: str) -> tuple[Handler, ...]:
    """The handlers of a registry (JSON text), validated; what is unknown, missing or of another type is an error.

    Names are unique and plain, facts and operators known, values texts, patterns compilable, and the last handler alone has
    no tests, so that every distribution has a handler.
    """
    known = Handler.__dataclass_fields__["facts"].default
    try:
        entries = json.loads(text)["handlers"]
        handlers = tuple(Handler(e["name"], tuple(_test(t, known) for t in e["every"]), tuple(_test(t, known) for t in e["some"]), e["outcome"], e["lifecycle"]) for e in entries)
    except (KeyError, TypeError) as error:
        raise ValueError(f"no registry of handlers: {error!r}") from error
    for handler, entry in zip(handlers, entries, strict=True):
        if extra := set(entry) - {"name", "outcome", "lifecycle", "every", "some"}:
            raise ValueError(f"{handler.name} has {sorted(extra)}")
        if not re.fullmatch("[a-z][a-z0-9_]*", handler.name) or handler.outcome not in OUTCOMES or handler.lifecycle not in LIFECYCLES:
            raise ValueError(f"{handler.name!r}, {handler.outcome!r} or {handler.lifecycle!r} isn't known")
    if len({h.name for h in handlers}) != len(handlers):
        raise ValueError("handlers have unique names")
    if not handlers or [bool(h.every or h.some) for h in handlers] != [True] * (len(handlers) - 1) + [False]:
        raise ValueError("the last handler, and no other, has no tests")
    return handlers


def _test(entry: dict, facts: Sequence[str]) -> Test:
    test = Test(entry["fact"], entry["operator"], tuple(entry["values"]))
    if set(entry) != {"fact", "operator", "values"} or test.fact not in facts or test.operator not in OPERATORS:
        raise ValueError(f"no test: {entry}")
    if not test.values or not all(isinstance(v, str) and v for v in test.values):
        raise ValueError(f"values are texts: {entry}")
    if test.operator == "regex":
        for v in test.values:
            try:
                re.compile(v)
            except re.error as error:
                raise ValueError(f"no pattern: {v!r}") from error
    return test


#: The handlers of public water data services, in order of precedence.
HANDLERS = load_handlers((Path(__file__).parent / "handlers.json").read_text())


def handler_table(spark, handlers: Sequence[Handler] = HANDLERS) -> DataFrame:
    """The registry as a table: precedence, handler_id, outcome, lifecycle. Names must not repeat, and the last takes everything."""
    names = [h.name for h in handlers]
    if len(set(names)) != len(names) or handlers[-1].every or handlers[-1].some:
        raise ValueError("handlers have unique names, and the last one has no tests")
    return spark.createDataFrame([(i + 1, h.name, h.outcome, h.lifecycle) for i, h in enumerate(handlers)], "precedence int, handler_id string, outcome string, lifecycle string")


def classified(distributions: DataFrame, handlers: Sequence[Handler] = HANDLERS, out: str = "handler_id") -> DataFrame:
    return distributions.withColumn(out, first_match(handlers))


HUC = r"^(?:\d{2}|\d{4}|\d{6}|\d{8}|\d{10}|\d{12})\z"
COMID = r"^[1-9][0-9]*\z"


def valid_identifier(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))


#: Postal codes of states and territories.
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "AS", "GU", "MP", "PR", "UM", "VI",
)
AREA_KINDS = ("huc", "county", "state")


def area_of(identifier: Column, kind: str = "auto") -> Column:
    """struct<kind, id, problem> of an area's identifier: a hydrologic unit, a county or a state.

    ``auto`` infers the kind from the form: an even number of digits from 2 to 12, five digits, or two letters, which are
    raised. problem: not_inferred, or the kind whose form or codes the identifier is not of; then there is no id.
    """
    if kind not in ("auto", *AREA_KINDS):
        raise ValueError(f"kind is auto or one of {AREA_KINDS}")
    inferred = F.when(identifier.rlike(HUC), F.lit("huc")).when(identifier.rlike(r"^\d{5}\z"), F.lit("county")).when(identifier.rlike(r"^[A-Za-z]{2}\z"), F.lit("state"))
    own = inferred if kind == "auto" else F.lit(kind)
    shown = F.when(own == "state", F.upper(identifier)).otherwise(identifier)
    fine = F.when(own == "huc", identifier.rlike(HUC)).when(own == "county", identifier.rlike(r"^\d{5}\z")).otherwise(F.upper(identifier).isin(*STATES))
    problem = F.when(own.isNull() | identifier.isNull(), F.lit("not_inferred")).when(~fine, own)
    return F.struct(own.alias("kind"), F.when(problem.isNull(), shown).alias("id"), problem.alias("problem"))


#: Which column types a value of each Python type may be compared with.
_BINDS = {str: (T.StringType,), bool: (T.BooleanType,), int: (T.IntegerType, T.LongType, T.DoubleType), float: (T.DoubleType,)}


def bound_query(rows: DataFrame, query: dict, enums: dict[str, Sequence] | None = None) -> DataFrame:
    """Equality filters checked against the schema (and enumerations): unknown columns and mismatched types are errors."""
    out = rows
    for name, value in query.items():
        if name not in rows.columns:
            raise ValueError(f"{name} can't be queried")
        if not isinstance(rows.schema[name].dataType, _BINDS.get(type(value), ())):
            raise ValueError(f"{name} is {rows.schema[name].dataType.simpleString()}, not {type(value).__name__}")
        if enums and name in enums and value not in enums[name]:
            raise ValueError(f"{name} has no value {value!r}")
        out = out.where(F.col(name) == F.lit(value))
    return out


def in_bbox(lon: Column, lat: Column, bbox: Sequence[float]) -> Column:
    """Whether a point lies in a box of 4 or 6 numbers; west beyond east crosses the antimeridian."""
    if len(bbox) not in (4, 6):
        raise ValueError("a box has 4 or 6 numbers")
    half = len(bbox) // 2
    (west, south), (east, north) = bbox[:2], bbox[half : half + 2]
    if south > north or (half == 3 and bbox[2] > bbox[5]):
        raise ValueError("only longitudes may be in reverse")
    across = (lon >= west) | (lon <= east) if west > east else lon.between(west, east)
    return F.coalesce(across & lat.between(south, north), F.lit(False))


def mapped_missing(columns: dict[str, Column], tokens: Sequence[str]) -> dict[str, Column]:
    """Values that are one of at most 16 tokens become null."""
    if len(tokens) > 16:
        raise ValueError("at most 16 tokens")
    return {k: F.when(~c.isin(*tokens), c) if tokens else c for k, c in columns.items()}


@dataclass(frozen=True)
class RoleMapping:
    """Which native columns hold time, value, unit and qualifier, and which texts stand for missing values."""

    datetime: str
    value: str
    unit: str
    qualifier: str | None = None
    missing: tuple[str, ...] = ()

    def select(self, native: DataFrame, *keep: str) -> DataFrame:
        wanted = [self.datetime, self.value, self.unit, *([self.qualifier] if self.qualifier else [])]
        if absent := [c for c in wanted if c not in native.columns]:
            raise ValueError(f"no columns {absent}")
        if len(set(wanted)) != len(wanted):
            raise ValueError("a column has one role")
        roles = mapped_missing({"value": F.col(self.value), "qualifier": F.col(self.qualifier) if self.qualifier else F.lit(None).cast("string")}, self.missing)
        return native.select(*keep, F.col(self.datetime).alias("datetime"), F.col(self.value).alias("original_value"), roles["value"].alias("value"), F.col(self.unit).alias("unit_label"), roles["qualifier"].alias("qualifier"))
