"""Text cleaning with the Unicode rules of the usual dataframe string methods."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from exposia.functions.columns import as_column

# The characters that Python's str.strip takes as space.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
# A noncharacter, so no text holds it.
_MARK = "\uffff "
_PAREN = r"\(([^)]+)\)"
_SPACED_PAREN = rf"[{_SPACES}]*\([^)]+\)"


def trim_ws(text: Column | str) -> Column:
    """Strip every kind of white space at both ends (plain ``trim`` only strips U+0020)."""
    return F.trim(as_column(text), F.lit(_SPACES))


def title_case(text: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter and lower-case the others.

    ``initcap`` alone restarts only after spaces, so each run of letters is first set off by a mark
    and a space: ``MEN'S`` gives ``Men'S`` and ``3RD`` gives ``3Rd``.
    """
    marked = F.regexp_replace(as_column(text), f"([{_CASED}]+)", f"{_MARK}$1")
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def contains_ignoring_case(text: Column | str, part: str) -> Column:
    """Substring test; missing text does not contain anything."""
    return F.coalesce(F.upper(as_column(text)).contains(part.upper()), F.lit(False))


def has_parenthesis(text: Column | str) -> Column:
    return F.coalesce(as_column(text).rlike(_PAREN), F.lit(False))


def parenthesised_code(text: Column | str) -> Column:
    """First non-empty text in parentheses, trimmed and upper-cased; NULL where there is none."""
    found = F.regexp_extract(as_column(text), _PAREN, 1)
    return F.nullif(F.upper(trim_ws(found)), F.lit(""))


def without_parentheses(text: Column | str) -> Column:
    """Remove every parenthesised group and the space before it, only where there is one."""
    text = as_column(text)
    cleaned = trim_ws(F.regexp_replace(text, _SPACED_PAREN, ""))
    return F.when(has_parenthesis(text), cleaned).otherwise(text)


def zero_pad(text: Column | str, width: int) -> Column:
    """Pad with zeros on the left, after a sign; longer text is kept whole (``lpad`` would cut it)."""
    text = as_column(text)
    signed = F.concat(
        F.substring(text, 1, 1), F.lpad(F.substring(text, 2, width), width - 1, "0")
    )
    padded = F.when(F.substring(text, 1, 1).isin("+", "-"), signed).otherwise(
        F.lpad(text, width, "0")
    )
    return F.when(F.length(text) < width, padded).otherwise(text)


def key_text(key: Column | str, kind: str = "string") -> Column:
    """Text form of an identifier whose Spark type is ``kind``.

    A floating-point id is written without exponent or decimals when it is whole.
    """
    key = as_column(key)
    if kind in ("double", "float"):
        whole = key.try_cast("bigint")
        return F.when(whole.cast("double") == key, whole.cast("string")).otherwise(
            key.cast("string")
        )
    return key.cast("string")


def slug(value: str) -> str:
    """Column-name form of a category: lower case, with space, slash and hyphen as underscore."""
    return re.sub("[ /-]", "_", value.lower())


def slug_column(value: Column | str) -> Column:
    return F.translate(F.lower(as_column(value)), " /-", "___")
