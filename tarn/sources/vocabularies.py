"""Reviewed vocabularies: target units, conversion rules, time zones. Small tables of fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_U = "http://qudt.org/vocab/unit/"

#: Dimension, unit, label, whether it is the default target of its dimension.
UNITS = (
    ("thermodynamic-temperature", f"{_U}DEG_C", "deg C", True),
    ("thermodynamic-temperature", f"{_U}DEG_F", "deg F", False),
    ("length", f"{_U}M", "m", True),
    ("length", f"{_U}FT", "ft", False),
    ("length", f"{_U}MilliM", "mm", False),
    ("length", f"{_U}IN", "in", False),
    ("volume-flow-rate", f"{_U}M3-PER-SEC", "m3/s", True),
    ("volume-flow-rate", f"{_U}FT3-PER-SEC", "ft^3/s", False),
)

#: Rule, from, to, scale, offset, dimension. A rule goes one way and isn't chained.
RULES = (
    ("temperature-deg-f-to-deg-c", f"{_U}DEG_F", f"{_U}DEG_C", 0.5555555555555556, -17.77777777777778, "thermodynamic-temperature"),
    ("temperature-deg-c-to-deg-f", f"{_U}DEG_C", f"{_U}DEG_F", 1.8, 32.0, "thermodynamic-temperature"),
    ("length-ft-to-m", f"{_U}FT", f"{_U}M", 0.3048, 0.0, "length"),
    ("length-m-to-ft", f"{_U}M", f"{_U}FT", 3.280839895013123, 0.0, "length"),
    ("length-in-to-mm", f"{_U}IN", f"{_U}MilliM", 25.4, 0.0, "length"),
    ("length-mm-to-in", f"{_U}MilliM", f"{_U}IN", 0.03937007874015748, 0.0, "length"),
    ("flow-ft3-s-to-m3-s", f"{_U}FT3-PER-SEC", f"{_U}M3-PER-SEC", 0.028316846592, 0.0, "volume-flow-rate"),
    ("flow-m3-s-to-ft3-s", f"{_U}M3-PER-SEC", f"{_U}FT3-PER-SEC", 35.31466672148859, 0.0, "volume-flow-rate"),
)

#: Minutes ahead of UTC of the zone codes of water quality results.
ZONES = {
    "ADT": -180, "AKDT": -480, "AKST": -540, "AST": -240, "CDT": -300, "CEST": 120, "CET": 60, "CST": -360, "EDT": -240, "EST": -300, "GMT": 0, "GST": 600,
    "HADT": -540, "HAST": -600, "KST": 540, "MDT": -360, "MST": -420, "NDT": -150, "NST": -210, "PDT": -420, "PST": -480, "SST": -660, "UTC": 0,
}


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "dimension string, unit_uri string, unit_label string, preferred boolean")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, from_unit_uri string, to_unit_uri string, scale double, offset double, dimension string")


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ZONES.items()), "code string, offset_minutes int")


def target_units(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """The target of each dimension: dimension, target_uri, target_label. ``overrides`` names another unit of a dimension."""
    chosen = {d: (u, label) for d, u, label, preferred in UNITS if preferred}
    known = {(d, u): label for d, u, label, _ in UNITS}
    for dimension, uri in (overrides or {}).items():
        if (dimension, uri) not in known:
            raise ValueError(f"{uri} is no reviewed unit of {dimension}")
        chosen[dimension] = (uri, known[dimension, uri])
    return spark.createDataFrame([(d, *c) for d, c in chosen.items()], "dimension string, target_uri string, target_label string")
