"""Filters, schema operators and value cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, functions as F

from exposia.functions import numeric, text
from exposia.operators.joins import left_lookup

MAP_LIMIT = 100


def keep_equal(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns all equal the wanted values; missing never equals."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    return df


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns, failing on a name the frame does not have."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns to drop not found: {absent}")
    return df.drop(*columns)


def existing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that the frame has, in the wanted order."""
    present = set(df.columns)
    return [c for c in wanted if c in present]


def with_prefix(df: DataFrame, prefix: str, but: Iterable[str] = ()) -> list[str]:
    """Columns of the family ``<prefix>_``, optionally all but some."""
    skipped = set(but)
    return [c for c in df.columns if c.startswith(f"{prefix}_") and c not in skipped]


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name, failing when two names become equal."""
    lowered = [c.lower() for c in df.columns]
    repeated = sorted({c for c in lowered if lowered.count(c) > 1})
    if repeated:
        raise ValueError(f"columns that collide in lower case: {repeated}")
    return df.toDF(*lowered)


def title_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text.title_case(c) for c in columns})


def null_sentinels(df: DataFrame, columns: Iterable[str], sentinel: float = -999) -> DataFrame:
    """Turn a sentinel into missing in those of the columns that the frame has."""
    return df.withColumns(
        {c: numeric.sentinel_to_null(c, sentinel) for c in existing(df, columns)}
    )


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Fill missing cells of the named columns only, so that keys are never touched."""
    return df.fillna(value, subset=list(columns)) if columns else df


def mapped(key: Column | str, mapping: Mapping[str, str]) -> Column:
    """Value of a small literal mapping, NULL for other keys."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = chain.from_iterable(mapping.items())
    key = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.create_map(*[F.lit(p) for p in pairs]), key)


def override(
    df: DataFrame, key: str, target: str, mapping: Mapping[str, str] | DataFrame
) -> DataFrame:
    """Replace ``target`` where the mapping names the row's key.

    Small mappings become a literal map. Larger ones, or a frame of key and value, are joined;
    a frame must hold each key once.
    """
    if not isinstance(mapping, DataFrame) and len(mapping) <= MAP_LIMIT:
        return df.withColumn(target, F.coalesce(mapped(key, mapping), F.col(target)))
    if not isinstance(mapping, DataFrame):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), "key string, value string")
    names, values = mapping.columns
    lookup = mapping.select(F.col(names), F.col(values).alias("_override"))
    joined = left_lookup(df, lookup, [(key, names)])
    return joined.withColumn(target, F.coalesce("_override", target)).drop("_override")


def extract_name_attributes(
    df: DataFrame,
    overrides: Mapping[str, str],
    *,
    name: str = "name",
    key: str = "facilityid",
    code: str = "cdcr_code",
    flag: str = "cdcr_firecamp",
    flag_text: str = "CAMP",
    flag_pattern: str | None = None,
) -> DataFrame:
    """Derive code and camp flag from a facility name and remove the parentheses from the name.

    The code is the first text in parentheses unless ``overrides`` gives one for the key. The flag
    tests the full name for ``flag_text`` anywhere, or for ``flag_pattern`` where a stricter test is
    wanted, such as a whole word.
    """
    flagged = text.contains_ignoring_case(name, flag_text)
    if flag_pattern is not None:
        flagged = F.coalesce(F.col(name).rlike(flag_pattern), F.lit(False))
    return df.withColumns(
        {
            code: F.coalesce(mapped(key, overrides), text.parenthesised_code(name)),
            flag: flagged,
            name: text.without_parentheses(name),
        }
    )


def with_capacity(
    df: DataFrame,
    population: str = "population",
    capacity: str = "capacity",
    result: str = "capacity_percent",
) -> DataFrame:
    """Clean the sentinel from both measures and add their ratio where both exist."""
    df = null_sentinels(df, [population, capacity])
    if len(existing(df, [population, capacity])) == 2:
        df = df.withColumn(result, numeric.ratio(population, capacity))
    return df


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    """Row count as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while some later action runs, without a job of its own."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
