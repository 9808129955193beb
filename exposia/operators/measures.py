"""Differences, shares, cumulative bands and one-against-the-rest measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from exposia.functions import numeric
from exposia.functions.text import key_text, slug, slug_column, trim_ws
from exposia.operators.cleaning import existing, with_prefix
from exposia.operators.joins import left_lookup

# Age bands of the panels, oldest tier first.
OVER_65 = (
    "65-69 Years", "70-74 Years", "75-79 Years", "80-84 Years", "85-89 Years", "90-94 Years",
    "95 and Older",
)
OVER_60 = ("60-64 Years", *OVER_65)
OVER_55 = ("55-59 Years", *OVER_60)
OVER_50 = ("50-54 Years", *OVER_55)
AGE_TIERS = {"50": OVER_50, "55": OVER_55, "60": OVER_60, "65": OVER_65}

SMALL_SHARE = 0.001


def differences(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``first - second`` under each name."""
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


def add_shares(
    df: DataFrame,
    counts: Mapping[str, str],
    denominator: str,
    *,
    clipped: bool = False,
    smallest: float | None = None,
) -> DataFrame:
    """Add ``count / denominator`` under each name and drop the counts.

    A denominator the frame lacks makes every share 0. ``clipped`` bounds shares to 0..1 and
    ``smallest`` sets lower ones to 0.
    """

    def measure(count: str) -> Column:
        if denominator not in df.columns:
            return F.lit(0.0)
        value = numeric.share(count, denominator)
        value = numeric.clip(value) if clipped else value
        return value if smallest is None else numeric.floor_small(value, smallest)

    return df.withColumns({name: measure(c) for name, c in counts.items()}).drop(*counts.values())


def by_location(counts: DataFrame, location: str = "Location") -> tuple[DataFrame, Column]:
    """Per-location counts and the key that codes meet them by: the trimmed location."""
    return counts, trim_ws(key_text(location))


def attach_counts(df: DataFrame, counts: DataFrame, code: str, location: str) -> DataFrame:
    """Left join per-location counts on the trimmed location."""
    return left_lookup(df, counts, [(code, by_location(counts, location)[1])]).drop(location)


def category_shares(
    df: DataFrame,
    counts: DataFrame,
    prefix: str,
    denominator: str,
    *,
    code: str = "cdcr_code",
    location: str = "Location",
    clipped: bool = True,
    smallest: float | None = SMALL_SHARE,
) -> DataFrame:
    """Share of each category of a family, by default bounded and with small shares as 0."""
    family = with_prefix(counts, prefix)
    joined = attach_counts(df, counts.select(location, *family), code, location)
    return family_shares(joined, prefix, denominator, clipped=clipped, smallest=smallest)


def family_shares(df: DataFrame, prefix: str, denominator: str, *, clipped: bool = False, smallest: float | None = None) -> DataFrame:
    """Turn the attached counts of a family, ``<prefix>_...``, into shares ``<prefix>_..._pct``."""
    names = {f"{c}_pct": c for c in with_prefix(df, prefix)}
    return add_shares(df, names, denominator, clipped=clipped, smallest=smallest)


def map_shares(
    df: DataFrame, counts: str, denominator: str, result: str, *, clipped: bool = False, smallest: float | None = None
) -> DataFrame:
    """Turn a map of counts into a map of shares; a row without counts has none."""

    def measure(_: Column, count: Column) -> Column:
        value = numeric.share(count, F.col(denominator)) if denominator in df.columns else F.lit(0.0)
        value = numeric.clip(value) if clipped else value
        return value if smallest is None else numeric.floor_small(value, smallest)

    return df.withColumn(counts, F.transform_values(counts, measure)).withColumnRenamed(counts, result)


def tier_shares(df: DataFrame, denominator: str) -> DataFrame:
    """Turn the attached sums of tiers, ``..._count``, into shares ``..._pct``."""
    names = {f"{c.removesuffix('_count')}_pct": c for c in df.columns if c.endswith("_count")}
    return add_shares(df, names, denominator)


def tier_counts(
    counts: DataFrame, tiers: Mapping[str, Sequence[str]] = AGE_TIERS, prefix: str = "age"
) -> dict[str, Column]:
    """Sum of each tier over those of its categories that the wide counts have."""
    return {
        f"{prefix}_over_{tier}_count": numeric.row_sum(
            existing(counts, [f"{prefix}_{slug(band)}" for band in bands])
        )
        for tier, bands in tiers.items()
    }


def cumulative_tiers(
    df: DataFrame,
    counts: DataFrame,
    denominator: str,
    *,
    tiers: Mapping[str, Sequence[str]] = AGE_TIERS,
    prefix: str = "age",
    code: str = "cdcr_code",
    location: str = "Location",
) -> DataFrame:
    """Share of each nested tier; neither bounded nor floored."""
    return tier_shares(attach_counts(df, tier_sums(counts, tiers, prefix, location), code, location), denominator)


def tier_sums(
    counts: DataFrame, tiers: Mapping[str, Sequence[str]] = AGE_TIERS, prefix: str = "age", location: str = "Location"
) -> DataFrame:
    """Per-location sums of all tiers, ``<prefix>_over_<tier>_count``."""
    return counts.select(location, *[c.alias(n) for n, c in tier_counts(counts, tiers, prefix).items()])


def one_vs_rest_shares(
    df: DataFrame,
    counts: DataFrame,
    denominator: str,
    *,
    prefix: str = "race",
    one: str = "white",
    rest: str = "peopleofcolor",
    code: str = "cdcr_code",
    location: str = "Location",
) -> DataFrame:
    """Share of one category and of all others of its family; neither bounded nor floored."""
    summed = split_sums(counts, prefix, one, rest, location)
    return family_shares(attach_counts(df, summed, code, location), prefix, denominator)


def split_sums(
    counts: DataFrame, prefix: str = "race", one: str = "white", rest: str = "peopleofcolor", location: str = "Location"
) -> DataFrame:
    """Per-location count of one category of a family and the sum of all its others."""
    single = f"{prefix}_{one}"
    return counts.select(
        location,
        numeric.row_sum(existing(counts, [single])).alias(single),
        numeric.row_sum(with_prefix(counts, prefix, but=[single])).alias(f"{prefix}_{rest}"),
    )


def demographic_counts(
    means: DataFrame,
    shown: Mapping[str, Sequence[str] | None],
    *,
    tiers: Mapping[str, Sequence[str]] = AGE_TIERS,
    tier_family: str = "age",
    split_family: str = "race",
    one: str = "white",
    rest: str = "peopleofcolor",
    location: str = "Location",
) -> DataFrame:
    """All per-location counts from long means (``family, category, mean``) in one aggregation.

    Bands and the one-against-the-rest split are conditional sums, so no list of categories is
    needed for them and none is lost. ``shown`` gives the categories to keep apart per family, or
    None to keep all of them in a map named like the family.
    """
    category = slug_column("category")

    def total(family: str, test: Column) -> Column:
        chosen = (F.col("family") == family) & test
        return F.coalesce(F.sum(F.when(chosen, F.col("mean"))), F.lit(0.0))

    sums = {
        f"{tier_family}_over_{tier}_count": total(tier_family, category.isin(*map(slug, bands)))
        for tier, bands in tiers.items()
    }
    for family, values in shown.items():
        if values is None:
            entry = F.when(F.col("family") == family, F.struct(category.alias("category"), "mean"))
            sums[family] = F.map_from_entries(F.collect_list(entry))
        for v in values or ():
            sums[f"{family}_{slug(v)}"] = total(family, category == slug(v))
    sums[f"{split_family}_{one}"] = total(split_family, category == one)
    sums[f"{split_family}_{rest}"] = total(split_family, category != one)
    return means.groupBy(location).agg(*[c.alias(n) for n, c in sums.items()])
