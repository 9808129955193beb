"""Number parsing and null-safe arithmetic. Missing is NULL; NaN and infinity are never produced."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from exposia.functions.columns import as_column
from exposia.functions.text import trim_ws

# Estimates for suppressed counts.
SUPPRESSED = {"**": 25.0, "*": 5.0, "(Blank)": 0.0}

# Checked before casting: a failed cast is slow, and a cast alone accepts suffixes such as '12d'.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_number(text: Column | str) -> Column:
    """Double value of a plain number text, NULL for anything else."""
    text = as_column(text)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_suppressed(text: Column | str, marks: Mapping[str, float] = SUPPRESSED) -> Column:
    """Count from published text: thousands commas, suppression marks; missing or unreadable is 0."""
    text = as_column(text)
    bare = F.replace(text, F.lit(","), F.lit(""))
    cell = trim_ws(bare)
    estimate = F.lit(None).cast("double")
    for mark, value in marks.items():
        estimate = F.when(cell == mark, F.lit(float(value))).otherwise(estimate)
    # Most cells are numbers and end at the first branch; the last one is for exotic spaces.
    return F.coalesce(parse_number(bare), estimate, parse_number(cell), F.lit(0.0))


def nan_to_null(value: Column | str) -> Column:
    return F.nanvl(as_column(value), F.lit(None).cast("double"))


def sentinel_to_null(value: Column | str, sentinel: float = -999) -> Column:
    return F.nullif(as_column(value), F.lit(sentinel))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is NULL when either side is missing or the denominator is 0."""
    return F.try_divide(
        as_column(numerator).cast("double"), as_column(denominator).cast("double")
    )


def share(count: Column | str, total: Column | str) -> Column:
    """Quotient where the total is positive, else 0; a missing count stays missing."""
    count, total = as_column(count), as_column(total)
    return F.when(total > 0, ratio(count, total)).otherwise(F.lit(0.0))


def clip(value: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound a value; unlike bare ``least``/``greatest`` a missing value stays missing."""
    value = as_column(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def floor_small(value: Column | str, threshold: float) -> Column:
    value = as_column(value)
    return F.when(value < threshold, F.lit(0.0)).otherwise(value)


def row_sum(values: Sequence[Column | str]) -> Column:
    """Sum over columns, skipping missing values; 0 when all are missing."""
    terms = [F.coalesce(nan_to_null(as_column(v).cast("double")), F.lit(0.0)) for v in values]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def row_mean(values: Sequence[Column | str]) -> Column:
    """Mean over columns, skipping missing values; NULL when all are missing."""
    present = [nan_to_null(as_column(v).cast("double")).isNotNull().cast("int") for v in values]
    return F.try_divide(row_sum(values), reduce(lambda a, b: a + b, present).cast("double"))


_HIDDEN = 1 << 52
_LEAST_EXPONENT, _MOST_EXPONENT = -1022, 1023


def ordered_image(value: Column | str) -> Column:
    """A 64-bit whole number for each double, in the same order; missing and NaN have none.

    It is the double's own bits, negated for negative values, taken apart by exact arithmetic: powers
    of two and divisions by them do not round. Both zeros are 0.
    """
    value = nan_to_null(as_column(value).cast("double"))
    size = F.abs(value)
    two = F.lit(2.0)
    low, high = F.lit(float(_LEAST_EXPONENT)), F.lit(float(_MOST_EXPONENT))
    guess = F.greatest(low, F.least(high, F.floor(F.log2(size)).cast("double")))
    # the logarithm may be off by one next to a power of two
    exponent = F.when(size < F.pow(two, guess), guess - 1).when(size / 2 >= F.pow(two, guess), guess + 1).otherwise(guess)
    exponent = F.greatest(low, exponent)
    digits = (size / F.pow(two, exponent) * float(_HIDDEN)).cast("long")
    image = (exponent - _LEAST_EXPONENT).cast("long") * _HIDDEN + digits
    image = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 * _HIDDEN)).otherwise(image)
    return F.when(value.isNotNull(), F.when(value < 0, -image).otherwise(image))


def from_ordered_image(image: int) -> float:
    """The double of an image."""
    size = struct.unpack("<d", abs(image).to_bytes(8, "little"))[0]
    return -size if image < 0 else size
