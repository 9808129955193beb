"""Averages of monthly panels, long to wide, and summary statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from exposia.functions.numeric import from_ordered_image, nan_to_null, ordered_image, parse_suppressed
from exposia.functions.text import slug, slug_column
from exposia.sources.staging import materialize

SORTED_AT_ONCE = 10_000


@dataclass(frozen=True)
class Family:
    """One panel: its frame, category column and the prefix of the wide columns.

    ``values`` lists the categories to turn into columns; without it they are kept in a map.
    """

    frame: DataFrame
    category: str
    prefix: str
    values: Sequence[str] | None = None


def clean_counts(panel: DataFrame, value: str = "Population") -> DataFrame:
    """Turn the published count text of a panel, if it has one, into numbers."""
    if value not in panel.columns:
        return panel
    return panel.withColumn(value, parse_suppressed(F.col(value).cast("string")))


def category_means(panel: DataFrame, keys: Sequence[str], value: str, result: str) -> DataFrame:
    """Mean over the periods present per key combination; rows lacking a key drop out."""
    known = panel.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.avg(nan_to_null(F.col(value).cast("double"))).alias(result))


def stacked(families: Sequence[Family], key: str, value: str) -> DataFrame:
    """All panels in one long frame ``<key>, family, category, count`` with cleaned counts."""
    parts = [
        clean_counts(f.frame, value).select(
            F.col(key).alias(key),
            F.lit(f.prefix).alias("family"),
            F.col(f.category).alias("category"),
            F.col(value).alias("count"),
        )
        for f in families
    ]
    return reduce(DataFrame.unionByName, parts)


def family_means(families: Sequence[Family], key: str = "Location", value: str = "Population") -> DataFrame:
    """Long means ``<key>, family, category, mean`` of several panels in one shuffle."""
    return category_means(
        stacked(families, key, value), [key, "family", "category"], "count", "mean"
    )


def family_maps(families: Sequence[Family], key: str = "Location", value: str = "Population") -> DataFrame:
    """One row per key found in any panel, with a map from category name to mean for each family.

    The panels are averaged together and gathered by key in one aggregate. The maps are sparse and no
    list of categories is looked up, so a panel may have any number of them; a key's own are held in
    one row. Two categories of one family with one name are an error.
    """

    def means_of(prefix: str) -> Column:
        entry = F.struct(slug_column("category").alias("category"), "mean")
        return F.map_from_entries(F.collect_list(F.when(F.col("family") == prefix, entry))).alias(prefix)

    return family_means(families, key, value).groupBy(key).agg(*[means_of(f.prefix) for f in families])


def category_means_wide(
    families: Sequence[Family], key: str = "Location", value: str = "Population"
) -> DataFrame:
    """One row per key found in any panel and one ``<prefix>_<category>`` column per declared category.

    A category a key lacks is 0. A family without declared categories stays a map named by its prefix.
    """
    wide: list[Column] = [F.col(key)]
    for f in families:
        names = [slug(v) for v in f.values or ()]
        if len(set(names)) < len(names):
            raise ValueError("two categories of one family give the same column name")
        if f.values is None:
            wide.append(F.col(f.prefix))
        wide += [F.coalesce(F.try_element_at(f.prefix, F.lit(n)), F.lit(0.0)).alias(f"{f.prefix}_{n}") for n in names]
    return family_maps(families, key, value).select(*wide)


def value_counts(df: DataFrame, column: str, result: str = "count") -> DataFrame:
    """Frequency of each value, missing excluded, most frequent first."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias(result))
    return counts.orderBy(F.desc(result), column)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation as one row with columns ``q0, q1, ...``.

    The column is read and written once, as images of 64 bits; see :func:`selected`. NaN counts as
    missing; without values the quantiles are missing.
    """
    images, basic = _stored_images(df, column, [F.count("v").alias("count")])
    found = quantiles(images, basic["count"], probabilities)
    names = ", ".join(f"q{i} double" for i in range(len(found)))
    return df.sparkSession.createDataFrame([tuple(found)], names)


def _stored_images(df: DataFrame, column: str, metrics: Sequence[Column]) -> tuple[DataFrame, dict]:
    """The images of a column as a written stage, and metrics over ``v`` observed on the way."""
    observation = Observation()
    values = df.select(nan_to_null(F.col(column).cast("double")).alias("v")).observe(observation, *metrics)
    images = materialize(values.select(ordered_image("v").alias("image")), "images")
    return images.filter("image is not null"), observation.get


def quantiles(images: DataFrame, total: int, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles from the images of ``total`` values, between neighbours by linear interpolation."""
    if not total:
        return [None] * len(probabilities)
    places = [p * (total - 1) for p in probabilities]
    at = selected(images, {f(p) for p in places for f in (math.floor, math.ceil)}, total)
    out = []
    for p in places:
        low, high = (from_ordered_image(at[f(p)]) for f in (math.floor, math.ceil))
        out.append(low + (high - low) * (p - math.floor(p)))
    return out


def selected(images: DataFrame, ranks: Iterable[int], total: int, small: int = SORTED_AT_ONCE) -> dict[int, int]:
    """The images at the given ranks (from 0), by radix selection.

    Each round counts the next 16 bits of what shares its leading bits with a wanted image: one
    partially aggregated count of at most 65,536 rows a rank, and nothing is ordered or shuffled whole.
    Once ``small`` images are left, they are counted one by one.
    """
    found: dict[int, int] = {}
    open_ranks = {None: [(r, r) for r in sorted(ranks)]}  # leading bits: rank, and rank among those that share them
    bits, left = 64, total
    while open_ranks:
        above, bits = bits, 0 if left <= small else bits - 16
        active = images
        if above < 64:
            inside = [F.col("image").between(p << above, ((p + 1) << above) - 1) for p in open_ranks]
            active = images.filter(reduce(lambda a, b: a | b, inside))
        counts = active.groupBy(F.shiftright("image", bits).alias("digits")).count().collect()
        groups: dict[int | None, list[tuple[int, int]]] = {}
        for digits, n in sorted(map(tuple, counts)):
            groups.setdefault(None if above == 64 else digits >> (above - bits), []).append((digits, n))
        deeper, left = {}, 0
        for leading, wanted in open_ranks.items():
            before, cells = 0, iter(groups[leading])
            digits, n = next(cells)
            for rank, inner in wanted:
                while inner >= before + n:
                    before += n
                    digits, n = next(cells)
                if not bits:
                    found[rank] = digits
                else:
                    left += n if digits not in deeper else 0
                    deeper.setdefault(digits, []).append((rank, inner - before))
        open_ranks = deeper
    return found


def describe(df: DataFrame, column: str, *, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a column as one row.

    NaN counts as missing. The frame is read once. Quartiles are exact, from the column's stored images,
    unless ``approximate``, which needs no stage.
    """
    c = nan_to_null(F.col(column).cast("double"))
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    basic = [
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    ]
    order = ["count", "mean", "std", "min", *quartiles, "max"]
    if approximate:
        rough = [F.percentile_approx(c, p).alias(n) for n, p in quartiles.items()]
        return df.agg(*basic, *rough).select(*order)
    on_v = [F.count("v"), F.avg("v"), F.stddev_samp("v"), F.min("v"), F.max("v")]
    images, found = _stored_images(df, column, [m.alias(n) for m, n in zip(on_v, ("count", "mean", "std", "min", "max"))])
    found |= dict(zip(quartiles, quantiles(images, found["count"], list(quartiles.values()))))
    schema = ", ".join(f"{n} {'long' if n == 'count' else 'double'}" for n in order)
    return df.sparkSession.createDataFrame([tuple(found[n] for n in order)], schema)
