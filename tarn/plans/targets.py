"""Request targets of the service families, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WATERDATA = "https://api.waterdata.usgs.gov/ogcapi/v0/collections"


def target(base: Column, **parameters: Column) -> Column:
    """``base`` with a query of the parameters that aren't null, in order of their names, values encoded."""
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(value)) for name, value in sorted(parameters.items())]
    query = F.concat_ws("&", *pairs)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def daily_target(site: Column, parameter: Column, start: Column, end: Column, limit: int) -> Column:
    """One page of daily values of a site and parameter; days include both ends."""
    return target(F.lit(f"{WATERDATA}/daily/items"), f=F.lit("json"), limit=F.lit(str(limit)), monitoring_location_id=site, parameter_code=parameter, time=F.concat(start, F.lit("/"), end))


def continuous_target(site: Column, parameter: Column, start: Column, end: Column, limit: int) -> Column:
    """One page of continuous values; instants include both ends."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return target(F.lit(f"{WATERDATA}/continuous/items"), f=F.lit("json"), limit=F.lit(str(limit)), monitoring_location_id=site, parameter_code=parameter, time=F.concat(at(start), F.lit("/"), at(end)))


def position_target(collection: Column, lon: Column, lat: Column, parameter: Column, start: Column, end: Column) -> Column:
    """A position query of a coverage collection."""
    point = F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
    return target(F.concat(collection, F.lit("/position")), coords=point, datetime=F.concat(start, F.lit("/"), end), f=F.lit("CoverageJSON"), **{"parameter-name": parameter})


def water_quality_target(site: Column, characteristic: Column, start: Column, end: Column) -> Column:
    """Results of a site and characteristic; the service takes whole days, so other instants have no target."""
    whole = (start == F.date_trunc("day", start)) & (end == F.date_trunc("day", end))
    day = lambda c: F.date_format(c, "MM-dd-yyyy")
    url = target(F.lit("https://www.waterqualitydata.us/data/Result/search"), characteristicName=characteristic, mimeType=F.lit("csv"), siteid=site, startDateHi=day(end), startDateLo=day(start))
    return F.when(whole, url)


def features_target(collection: Column, limit: int, bbox: Column | None = None) -> Column:
    return target(F.concat(collection, F.lit("/items")), f=F.lit("json"), limit=F.lit(str(limit)), **({"bbox": bbox} if bbox is not None else {}))
