"""Min-max scaling and composite indices."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from exposia.functions.numeric import nan_to_null, row_mean

_STATS = "_extremes"


def _extremes(columns: Sequence[str]) -> list[Column]:
    found = []
    for i, c in enumerate(columns):
        value = nan_to_null(F.col(c).cast("double"))
        found += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    return found


def min_max_scale(
    df: DataFrame,
    columns: Sequence[str],
    *,
    to: float = 100.0,
    suffix: str = "_norm",
    known: Mapping[str, float | None] | None = None,
) -> DataFrame:
    """Add each column scaled to 0..``to`` by its global minimum and maximum.

    A column with one single value scales to 0 in every row, also where it is missing; one without
    any value stays missing, and NaN counts as missing. The extremes of all columns come from one aggregate, used as a scalar
    subquery: no join and no ordering. ``known`` gives them (``low0``, ``high0``, ...) where they were observed before.
    """
    if known is None:
        stats = df.agg(F.struct(*_extremes(columns))).scalar()
    else:
        stats = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in known.items()])

    def scaled(i: int, c: str) -> Column:
        low, high = F.col(f"{_STATS}.low{i}"), F.col(f"{_STATS}.high{i}")
        value = nan_to_null(F.col(c).cast("double"))
        return (
            F.when(high.isNull(), F.lit(None).cast("double"))
            .when(high != low, F.try_divide(value - low, high - low) * to)
            .otherwise(F.lit(0.0))
        )

    wide = df.withColumn(_STATS, stats)
    return wide.withColumns({f"{c}{suffix}": scaled(i, c) for i, c in enumerate(columns)}).drop(_STATS)


def heat_air_index(
    df: DataFrame,
    *,
    heat: str = "days_over_90_historic",
    also: Sequence[str] = (),
    air: Sequence[str] = ("ozoneP", "pmP", "dieselP"),
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Air quality as the mean of its percentiles, and its scaled mean with the scaled heat days.

    The index is scaled by extremes that depend on those of its parts. ``stage`` (such as
    ``materialize``, which must run the frame) writes the frame once, observing the extremes of the
    parts on the way, and only those of the index take a read of their own; without it the frame is
    evaluated for each.
    """
    parts = df.withColumn("AQI", row_mean(air))
    scaled = [heat, *also, "AQI"]
    known = None
    if stage:
        observation = Observation()
        parts = stage(parts.observe(observation, *_extremes(scaled)))
        known = observation.get
    first = min_max_scale(parts, scaled, known=known)
    index = first.withColumn("heat_hazard_idx", row_mean(["AQI_norm", f"{heat}_norm"]))
    return min_max_scale(index, ["heat_hazard_idx"])
