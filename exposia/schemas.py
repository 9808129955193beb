"""Explicit schemas of every input; identifiers are text and missing is always NULL."""

from __future__ import annotations

from pyspark.sql import types as T

GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_TEXT, _NUMBER, _YEAR = T.StringType(), T.DoubleType(), T.IntegerType()

POPULATION_AVERAGES = _struct(
    Facility_Name=_TEXT, Facility_Code=_TEXT, Average_2025_Population=_NUMBER
)

FACILITY_METADATA = _struct(
    Acronym=_TEXT,
    Year_opened=_YEAR,
    Year_opened_notes=_TEXT,
    Reentry_hub=_TEXT,
    Planned_closure=_TEXT,
    California_model_facility=_TEXT,
    cdcr_air_cooling_pilot=_TEXT,
)

HEAT_DAYS = _struct(
    GEOID=_TEXT,
    days_over_80_historic=_NUMBER,
    days_over_80_midcentury=_NUMBER,
    days_over_90_historic=_NUMBER,
    days_over_90_midcentury=_NUMBER,
    days_over_100_historic=_NUMBER,
    days_over_100_midcentury=_NUMBER,
)

BOUNDARY_PROPERTIES = _struct(
    FID=_TEXT,
    OBJECTID=_TEXT,
    FACILITYID=_TEXT,
    NAME=_TEXT,
    ADDRESS=_TEXT,
    CITY=_TEXT,
    STATE=_TEXT,
    ZIP=_TEXT,
    ZIP4=_TEXT,
    TELEPHONE=_TEXT,
    TYPE=_TEXT,
    STATUS=_TEXT,
    POPULATION=_NUMBER,
    COUNTY=_TEXT,
    COUNTYFIPS=_TEXT,
    COUNTRY=_TEXT,
    NAICS_CODE=_TEXT,
    NAICS_DESC=_TEXT,
    SOURCE=_TEXT,
    SOURCEDATE=_TEXT,
    VAL_METHOD=_TEXT,
    VAL_DATE=_TEXT,
    WEBSITE=_TEXT,
    SECURELVL=_TEXT,
    CAPACITY=_NUMBER,
)

TRACT_PROPERTIES = _struct(GEOID=_TEXT)

SCREENING_PROPERTIES = _struct(
    tract=_TEXT, PollutionP=_NUMBER, ozoneP=_NUMBER, pmP=_NUMBER, dieselP=_NUMBER
)


def panel(category: str) -> T.StructType:
    """Monthly count panel: one row per month, location and category; counts arrive as text."""
    return _struct(
        Year=_YEAR, Month=_TEXT, Location=_TEXT, **{category: _TEXT}, Population=_TEXT
    )
