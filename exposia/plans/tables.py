"""The four tables: facilities, state facilities, heat and air hazard, and their join."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from exposia.functions.numeric import ratio
from exposia.functions.text import key_text, trim_ws, zero_pad
from exposia.operators import cleaning, measures
from exposia.operators.joins import aligned_lookups, enrich, join_aligned, left_lookup
from exposia.operators.reshape import Family, family_means
from exposia.operators.scaling import heat_air_index
from exposia.operators.spatial import assign_region, with_centroid
from exposia.sources.staging import materialize

# Fixed values of the facility review.
UNUSED_BOUNDARY_COLUMNS = (
    "FID", "OBJECTID", "NAICS_CODE", "NAICS_DESC", "SOURCE", "SOURCEDATE", "VAL_METHOD", "VAL_DATE",
    "ZIP4",
)
REVIEWED_TYPES = {
    "10000850": "FEDERAL",
    "10000851": "FEDERAL",
    "10000849": "FEDERAL",
    "10000845": "STATE",
    "10000846": "STATE",
}
GENDERS = ("Female", "Male")
CODE_OVERRIDES = {"10000826": "ASP"}
CODE_ALIASES = {"FSP": "FOL"}

THRESHOLDS = (80, 90, 100)
HAZARD_COLUMNS = (
    "days_over_90_historic", "days_over_90_midcentury", "delta_90", "PollutionP", "AQI_norm",
    "heat_hazard_idx_norm",
)
TRACT_DIGITS = 11

_POPULATION = "average_2025_population"


def clean_facilities(
    boundaries: DataFrame,
    *,
    state: str = "CA",
    status: str = "OPEN",
    unused: Sequence[str] = UNUSED_BOUNDARY_COLUMNS,
) -> DataFrame:
    """Open facilities of one state, without unused columns, in title case, with lower-case names."""
    kept = cleaning.keep_equal(boundaries, STATE=state, STATUS=status)
    kept = cleaning.drop_columns(kept, unused)
    return cleaning.lower_columns(cleaning.title_columns(kept, ["NAME", "ADDRESS", "CITY"]))


def facilities(
    boundaries: DataFrame,
    tracts: DataFrame,
    *,
    crs: str | None = "EPSG:4326",
    tracts_crs: str | None = "EPSG:4269",
    types: Mapping[str, str] = REVIEWED_TYPES,
    cell: float | None = None,
    disjoint_tracts: bool = False,
    **selection,
) -> DataFrame:
    """Facilities with centre point, census tract, capacity use and reviewed type."""
    cleaned = clean_facilities(boundaries, **selection)
    placed = assign_region(
        with_centroid(cleaned, crs=crs),
        tracts,
        points_crs=crs,
        regions_crs=tracts_crs,
        cell=cell,
        disjoint=disjoint_tracts,
    )
    return cleaning.override(cleaning.with_capacity(placed), "facilityid", "type", types)


def state_facilities_base(table: DataFrame) -> DataFrame:
    """The facilities under state jurisdiction, after the review of types."""
    return cleaning.keep_equal(table, type="STATE")


def population_lookup(averages: DataFrame) -> tuple[DataFrame, Column]:
    """Average population and the code it is found by."""
    named = averages.withColumnRenamed("Average_2025_Population", _POPULATION)
    code = trim_ws(key_text("Facility_Code"))
    return named.select(_POPULATION, code.alias("_code")), F.col("_code")


def metadata_lookup(metadata: DataFrame, aliases: Mapping[str, str]) -> tuple[DataFrame, Column]:
    """Reviewed facts and the code they are found by."""
    acronym = trim_ws(key_text("Acronym"))
    acronym = F.coalesce(cleaning.mapped(acronym, aliases), acronym)
    return metadata.withColumn("Acronym", acronym), F.col("Acronym")


def with_lookups(
    df: DataFrame,
    code: str,
    *,
    averages: DataFrame | None = None,
    counts: DataFrame | None = None,
    metadata: DataFrame | None = None,
    aliases: Mapping[str, str] = CODE_ALIASES,
    location: str = "Location",
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the columns of all given lookups in one join on the code.

    ``stage`` (such as ``materialize``) is applied to the aligned lookups, which shows Catalyst their
    real size. With ``averages`` comes the ratio of the average population to the capacity, if there is one.
    """
    found, columns = {}, {}
    if averages is not None:
        found["averages"], columns["averages"] = population_lookup(averages), [_POPULATION]
    if counts is not None:
        found["counts"] = measures.by_location(counts, location)
        columns["counts"] = [c for c in counts.columns if c != location]
    if metadata is not None:
        found["metadata"] = metadata_lookup(metadata, aliases)
        columns["metadata"] = [c for c in metadata.columns if c != "Acronym"]
    aligned = aligned_lookups(found)
    joined = join_aligned(df, code, stage(aligned) if stage else aligned, columns)
    if averages is not None and "capacity" in df.columns:
        joined = joined.withColumn("capacity_percent_2025", ratio(_POPULATION, "capacity"))
    return joined


def with_population(df: DataFrame, averages: DataFrame, code: str) -> DataFrame:
    """Add the average population of the facility's code and its ratio to the capacity."""
    lookup, key = population_lookup(averages)
    joined = enrich(df, lookup, code, key, [_POPULATION])
    return joined.withColumn("capacity_percent_2025", ratio(_POPULATION, "capacity"))


def with_metadata(df: DataFrame, metadata: DataFrame, code: str, aliases: Mapping[str, str]) -> DataFrame:
    """Add the reviewed facts of the facility's code, with lower-case names."""
    lookup, key = metadata_lookup(metadata, aliases)
    facts = [c for c in metadata.columns if c != "Acronym"]
    return cleaning.lower_columns(enrich(df, lookup, code, key, facts))


def state_facilities(
    base: DataFrame,
    averages: DataFrame,
    metadata: DataFrame,
    *,
    age: DataFrame,
    gender: DataFrame,
    race: DataFrame,
    birth_country: DataFrame | None = None,
    genders: Sequence[str] | None = GENDERS,
    birth_countries: Sequence[str] | None = None,
    bounded: Sequence[str] = ("gender",),
    overrides: Mapping[str, str] = CODE_OVERRIDES,
    aliases: Mapping[str, str] = CODE_ALIASES,
    stage: Callable[[DataFrame], DataFrame] | None = materialize,
) -> DataFrame:
    """State facilities with code, population, demographic shares and reviewed facts.

    The panels are averaged in one shuffle; their counts, the averages and the reviewed facts are
    aligned by code and joined once. ``genders`` and ``birth_countries`` are the categories that get
    a column; None keeps all of them in a map, ``gender_pct`` or ``cob_pct``. Shares of the families in
    ``bounded`` (age, gender, race, cob) are held between 0 and 1 and small ones are 0. ``stage``
    writes the aligned lookups, which shows Catalyst their real size, so that facilities do not
    shuffle to meet a small table; None leaves the choice to adaptive execution.
    """
    named = cleaning.extract_name_attributes(base, overrides)
    code = F.coalesce(cleaning.mapped("cdcr_code", aliases), F.col("cdcr_code"))
    families = [Family(age, "Age Group", "age"), Family(gender, "Gender", "gender"), Family(race, "Race", "race")]
    shown = {"gender": None if genders is None else sorted(genders)}
    if birth_country is not None:
        families.append(Family(birth_country, "Country of Birth", "cob"))
        shown["cob"] = None if birth_countries is None else sorted(birth_countries)
    counts = measures.demographic_counts(family_means(families), shown)
    joined = with_lookups(
        named.withColumn("_code", code), "_code", averages=averages, counts=counts, metadata=metadata, aliases=aliases, stage=stage
    )
    columns = {
        "age": {f"age_over_{t}_pct": f"age_over_{t}_count" for t in measures.AGE_TIERS},
        **{family: {f"{c}_pct": c for c in cleaning.with_prefix(counts, family)} for family in shown},
        "race": {f"{c}_pct": c for c in ("race_white", "race_peopleofcolor")},
    }
    shared = joined
    for family, names in columns.items():
        limits = {"clipped": family in bounded, "smallest": measures.SMALL_SHARE if family in bounded else None}
        if family in shown and shown[family] is None:
            shared = measures.map_shares(shared, family, _POPULATION, f"{family}_pct", **limits)
        shared = measures.add_shares(shared, names, _POPULATION, **limits)
    facts = [c for c in metadata.columns if c != "Acronym"]
    return cleaning.lower_columns(shared.select(*[c for c in shared.columns if c not in (*facts, "_code")], *facts))


def population_difference(df: DataFrame) -> DataFrame:
    return measures.differences(df, {"pop_diff": ("population", _POPULATION)})


def heat_air_hazard(
    heat_days: DataFrame,
    screening: DataFrame,
    *,
    sentinels: Sequence[float] = (),
    all_columns: bool = False,
    stage: Callable[[DataFrame], DataFrame] | None = materialize,
) -> DataFrame:
    """Heat and air hazard per census tract, keyed by ``geoid``.

    ``sentinels`` are turned into missing first. ``all_columns`` also keeps the other thresholds
    and the unscaled measures. ``stage`` writes the joined measures, which the two passes of scaling
    then read; None recomputes them.
    """
    air = ["PollutionP", "ozoneP", "pmP", "dieselP"]
    days = [f"days_over_{t}_{when}" for t in THRESHOLDS for when in ("historic", "midcentury")]
    kind = screening.schema["tract"].dataType.simpleString()
    pruned = screening.select(zero_pad(key_text("tract", kind), TRACT_DIGITS).alias("tract"), *air)
    heat = heat_days.select(F.col("GEOID").alias("geoid"), *days)
    for sentinel in sentinels:
        pruned = cleaning.null_sentinels(pruned, air, sentinel)
        heat = cleaning.null_sentinels(heat, days, sentinel)

    deltas = {f"delta_{t}": (f"days_over_{t}_midcentury", f"days_over_{t}_historic") for t in THRESHOLDS}
    joined = left_lookup(measures.differences(heat, deltas), pruned, [("geoid", "tract")])
    heat_column = "days_over_90_historic"
    also = [d for d in days if d != heat_column] if all_columns else []
    table = heat_air_index(joined, heat=heat_column, also=also, stage=stage)
    return table if all_columns else table.select("geoid", *HAZARD_COLUMNS)


def exposure(table: DataFrame, hazard: DataFrame) -> DataFrame:
    """Facilities with the hazard of their census tract; facilities without one are kept."""
    return left_lookup(table, hazard, [("tract_geoid", "geoid")])
